import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import packing


@pytest.fixture(scope="module")
def reference():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return lambda text: [*made.encode(text or "", add_special_tokens=False).ids, 0]


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "a\n \nb", "\n", "\t x", "x  y", "it's we'll",
       "x <|endoftext|> y", "é𝄞 ñ", "1234 5,6", "a\x1c b \x85 c", "end\n ", "end  ", "　  x", "a\r\n b"]


def test_ids_equal_the_tokenizer(reference, data):
    import duckdb
    texts = ODD + [r[0] for r in duckdb.sql(f"SELECT text FROM '{data}/documents.parquet'").fetchall()]
    draw = random.Random(4)
    texts += ["".join(draw.choice([" ", "\n", "a", "Zx", "é", ".", "\t", "7", "'s"]) for _ in range(12)) for _ in range(5000)]
    speller = packing.Speller("byte_bpe_50k.tiktoken")
    for text in texts:
        assert speller.ids(text).tolist() == reference(text), repr(text)


def test_added_tokens_are_one_id(spark):
    """Against the tokenizer as its file gives it, without any setting."""
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = lambda text: [*made.encode(text or "", add_special_tokens=False).ids, 0]
    assert own("one<|endoftext|>two") == [505, 50256, 11545, 0]
    draw = random.Random(5)
    texts = [*ODD, "<|endoftext|>", "<|endoftext|><|endoftext|>", "a <|endoftext|> <|endoftext|>\n", "<|endoftext", "<|ENDOFTEXT|>"]
    texts += ["".join(draw.choice(["<|endoftext|>", "<|endoftext|>", "<|", "|>", " ", "\n", "a", "Zx", "é", "'s"]) for _ in range(9)) for _ in range(2000)]
    speller = packing.Speller("byte_bpe_50k.tiktoken", "byte_bpe_50k.json")
    for text in texts:
        assert speller.ids(text).tolist() == own(text), repr(text)
    docs = spark.createDataFrame(list(enumerate(texts[:200])), "doc_id long, text string")
    for r in packing.pack(docs).collect():
        want = own(texts[r.doc_id])
        assert r.doc_tokens == len(want)
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.start:r.start + r.length], dtype="<u4").tobytes())


def test_plan_places_every_rest_once():
    draw = random.Random(9)
    for window, counts in [(16, {3: 7, 5: 4, 8: 9, 13: 2}), (16, {1: 1}), (16, {}), (64, {k: draw.randrange(9) for k in range(1, 64)}),
                           (1024, {100: 5000, 900: 3, 24: 1}), (16, {7: 11})]:
        plan = packing.planned({k: n for k, n in counts.items() if n}, window)
        used = defaultdict(list)
        for length, n in counts.items():
            for k in range(n):
                pieces = plan.place(length, k)
                assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:i]) for i in range(len(pieces))]
                assert sum(p[1] for p in pieces) == length
                for _, size, sequence, offset in pieces:
                    used[sequence].append((offset, size))
        assert set(used) == set(range(plan.sequences))
        sizes = [gapless(spans) for spans in used.values()]
        assert all(s == window or s & (s - 1) == 0 for s in sizes)


def gapless(spans):
    at = 0
    for offset, size in sorted(spans):
        assert offset == at and size > 0
        at += size
    return at


def test_least_squares_fits():
    counts = np.zeros(1025, dtype=np.int64)
    counts[[300, 724, 512, 200, 112, 712]] = [50, 50, 40, 9, 9, 9]
    combos = packing.combinations(np.flatnonzero(counts), 1024)
    x = packing.solved(combos, counts)
    made = np.zeros(1025)
    for combo, times in zip(combos, x, strict=True):
        for part in combo[combo > 0]:
            made[part] += times
    assert np.abs(made - counts)[counts > 0].max() < 0.6


@pytest.mark.parametrize("window", [1024, 64])
def test_pack(spark, reference, window):
    draw = random.Random(1)
    rows = [(k, " ".join(draw.choice(["alpha", "be", "gamma,", "Ño"]) for _ in range(draw.choice([0, 3, 60, 700])))) for k in range(60)]
    rows += [(100 + k, "the same text") for k in range(30)] + [(7, None), (None, "no id"), (9, "x " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS first", "'p' AS part").repartition(7)
    got = packing.pack(docs, packing.Packer(window=window)).collect()
    ids = defaultdict(list)
    for i, text in rows:
        ids[i].append(reference(text))
    filled, seen = defaultdict(list), defaultdict(int)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
        own = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens]
        sums = [zlib.crc32(np.array(x[r.start:r.start + r.length], dtype="<u4").tobytes()) for x in own]
        assert r.ids_crc32 in sums
        seen[r.doc_id] += r.length
    assert seen == {i: sum(map(len, x)) for i, x in ids.items()}
    assert all(s == window or s & (s - 1) == 0 for s in map(gapless, filled.values()))
    short = [s for s in map(gapless, filled.values()) if s < window]
    assert len(short) <= 10
    assert packing.pack(docs.limit(0)).count() == 0


def test_long_runs_of_white_space(spark):
    """Runs that the pattern cannot take whole, at the start, in the middle and at the end, against the tokenizer as its file gives it."""
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = packing.LONG_RUN
    texts = [" " * 1_000_000, "\n" * 1_000_000, "\t" * 1_000_000, " " * 1_000_000 + "a", "a b" + "\r\n" * 300_000 + "c", "x" + " \n\t" * 200_000,
             " " * (n - 1) + "é", " " * n, " " * n + "\n", "\n" * n + " a", "a" + "\u3000" * n + "b", "a\x1c" + " " * n + "\x1cb",
             "<|endoftext|>" + " " * n + "<|endoftext|> a", ("w" + " " * n) * 5 + "'s"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = defaultdict(list)
    for r in packing.pack(docs).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for k, text in enumerate(texts):
        want = [*made.encode(text, add_special_tokens=False).ids, 0]
        assert sum(length for _, length, _, _ in pieces[k]) == len(want)
        for start, length, checksum, tokens in pieces[k]:
            assert tokens == len(want) and checksum == zlib.crc32(np.array(want[start:start + length], dtype="<u4").tobytes())
