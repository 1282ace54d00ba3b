import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import test_decontaminate
import test_hostrules
import test_simhash
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm import pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_quality(docs):
    found = {d[0]: test_hostrules.brute(d[1]) for d in docs}
    lines = {d[0]: len([x for x in (d[1] or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]) for d in docs}
    base, failed = {}, {}
    for i, (n, chars, symbols, dup, again) in found.items():
        base[i] = n < 10 or 100 * again > 20 * n
        failed[i] = base[i] or 10 * symbols > n or 10 * dup > 3 * lines[i] or chars < 3 * n or chars > 12 * n
    hosts = defaultdict(list)
    for d in docs:
        hosts[d[3]].append(failed[d[0]])
    total = sum(map(len, hosts.values()))
    mean = sum(map(sum, hosts.values())) / total
    rates = {h: sum(x) / len(x) for h, x in hosts.items()}
    spread = (sum(len(x) * rates[h] ** 2 for h, x in hosts.items()) - sum(r * (1 - r) for r in rates.values())) / total - mean ** 2
    weight = min(max(mean * (1 - mean) / spread - 1, 2.0), 1000.0) if spread > 0 else 1000.0
    bad = {h for h, x in hosts.items() if (sum(x) + mean * weight) / (len(x) + weight) > 0.5}
    return [d for d in docs if not (base[d[0]] or (d[3] in bad and failed[d[0]]))]


def brute_single(docs):
    ids = [d[0] for d in docs]
    least, _ = test_simhash.brute_components(ids, [test_simhash.brute_print(d[1]) for d in docs])
    return [d for d, c in zip(docs, least, strict=True) if c == d[0]]


def test_stages_against_plain_python(spark, data):
    docs = duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM '{data}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{data}/benchmark.parquet'").fetchall()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = [brute_quality, brute_single,
              lambda rows: [d for d in rows if not test_decontaminate.brute(d[1], items)[3]],
              lambda rows: [(d[0], m, d[2], d[3], len(m) if m != d[1] else d[4]) for d in rows for m in [pii.masked(d[1])]]]
    now = spark.read.parquet(os.path.join(data, "documents.parquet"))
    kept = docs
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], wanted, strict=True):
        out = stage(spark, now, data)
        assert out.columns == COLUMNS
        rows = [tuple(r) for r in out.collect()]
        before, kept = kept, want(kept)
        assert sorted(rows) == sorted(kept)
        assert 0 < len(kept) <= len(before)
        now = spark.createDataFrame(rows, now.schema)
    ids = {d[0]: [*tokenizer.encode(d[1], add_special_tokens=False).ids, 0] for d in kept}
    seen = defaultdict(int)
    for r in corpus_pipeline.run(spark, data).collect():
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, dtype="<u4").tobytes())
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in ids.items()}


@pytest.mark.parametrize("rows", [[], [(1, None, "en", None, None)] * 3, [(None, "some words " * 9, None, "s", 1)] * 2])
def test_odd_tables(spark, data, rows):
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, data)
        now.collect()
