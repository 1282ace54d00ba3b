import random
import re

import pytest

from tallyloom.llm import decontaminate
from tallyloom.llm.decontaminate import WORD, Limits


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=13):
    own = words(text)
    hit, names = set(), set()
    for name, body in items:
        run = words(body)
        if not run:
            continue
        size = min(window, len(run))
        grams = {tuple(run[i:i + size]) for i in range(len(run) - size + 1)}
        for i in range(len(own) - size + 1):
            if tuple(own[i:i + size]) in grams:
                hit.update(range(i, i + size))
                names.add("null" if name is None else str(name))
    return len(own), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(own)


def cases():
    draw = random.Random(11)
    few = ["aa", "bb", "cc", "Dd", "é9", "x"]
    items = [(k, " ".join(draw.choice(few) for _ in range(draw.choice([2, 5, 12, 13, 14, 30])))) for k in range(40)]
    items += [(50, None), (51, " -- "), (None, "only null here"), (52, items[3][1].upper()), (52, "twice used id")]
    texts = [None, "", "!!!", "unrelated words only"]
    for _ in range(60):
        parts = []
        for _ in range(draw.randrange(1, 6)):
            pick = draw.choice(items)[1] or "zz"
            run = pick.split()
            a = draw.randrange(len(run) or 1)
            parts += [" ".join(draw.choice([*few, "yy"]) for _ in range(draw.randrange(0, 40))), " ".join(run[a:]), pick]
        texts.append(draw.choice([" ", ", ", "\n"]).join(parts))
    texts.append("word " * 2000 + items[0][1] + " Only, NULL-here")
    return items, texts


@pytest.mark.parametrize("block", [200_000, 60])
def test_against_brute_force(spark, block):
    items, texts = cases()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.measured(docs, bench, Limits(block_words=block)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == brute(texts[r.doc.doc_id], items)
    assert len(list(decontaminate.item_blocks(bench, Limits(block_words=block)))) == (1 if block > 1000 else 11)


def test_a_block_is_measured_before_the_next_is_read(spark, monkeypatch):
    items, texts = cases()
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    sizes, read, blocks = [], [], decontaminate.item_blocks
    scanner = decontaminate._scanner

    def counted(*args):
        for block in blocks(*args):
            read.append(block)
            yield block

    def noted(block, window):
        sizes.append(len(read))
        return scanner(block, window)

    monkeypatch.setattr(decontaminate, "item_blocks", counted)
    monkeypatch.setattr(decontaminate, "_scanner", noted)
    found = decontaminate.measured(docs, bench, Limits(block_words=100))
    assert len(read) > 2 and sizes == [max(2, k + 1) for k in range(len(read))]
    got = found.collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == brute(texts[r.doc.doc_id], items)


def test_stage_and_cut(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(1, "Clean text, it stays."), (2, f"before {passage.upper()}, after"), (2, f"before {passage.upper()}, after"),
            (3, None), (4, passage + " word" * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS hit", "1 AS n_words", "0 AS doc")
    bench = spark.createDataFrame([("q", passage)], "item_id string, text string")
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    cut = {r.doc_id: r.text for r in decontaminate.cut_spans(docs, bench).collect()}
    assert cut[2] == "before \n, after" and cut[1] == rows[0][1] and cut[3] is None
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.keep_clean(docs, none).count() == 5
    assert decontaminate.keep_clean(docs.limit(0), bench).count() == 0
