import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import simhash
from tallyloom.llm.components import roots


def brute_print(text, n=4):
    words = [w for w in _words(text)]
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _words(text):
    import re
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_components(ids, prints, distance=4):
    left = list(range(len(prints)))
    root = list(left)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in left:
        for j in left[i + 1:]:
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in left:
        least[find(i)] = min([x for x in (least.get(find(i)), ids[i]) if x is not None], default=None)
    return [least[find(i)] for i in left], len(least)


def texts():
    draw = random.Random(3)
    vocabulary = ["w%d" % k for k in range(300)]
    rows = []
    for k in range(25):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 40, 400]))]
        for _ in range(4):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 3])):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append(" ".join(copy))
    return rows + [None, "", " \t\n", "One", "one", "Ünder É x\x85y", "a b c d", "A b\x0bC D", "x " * 30_000]


@pytest.mark.parametrize("crowd", [100_000, 1])
def test_against_brute_force(spark, crowd):
    rows = list(enumerate(texts())) + [(3, "again and again and again"), (3, "again and again and again"), (None, "one"), (None, "lonely")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = simhash.groups(docs, simhash.Near(crowd=crowd)).collect()
    prints = [brute_print(t) for _, t in rows]
    least, pieces_found = brute_components([i for i, _ in rows], prints)
    want = sorted((str(i), p, str(c)) for (i, _), p, c in zip(rows, prints, least, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint % (1 << 64), str(r.component_id)) for r in got) == want
    kept = simhash.keep_one(docs, simhash.Near(crowd=crowd)).collect()
    assert len(kept) == pieces_found


def test_walk_finds_every_link():
    draw = np.random.default_rng(5)
    centres = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    keys = [int(c) for c in centres]
    for c in centres:
        for _ in range(12):
            x = int(c)
            for b in draw.integers(0, 64, draw.integers(1, 7)):
                x ^= 1 << int(b)
            keys.append(x)
    keys = sorted(set(keys))
    u, v = simhash.links(np.array(keys, dtype=np.uint64), 1, 4)
    near = [(i, j) for i in range(len(keys)) for j in range(i) if (keys[i] ^ keys[j]).bit_count() <= 4
            and keys[i] >> 63 == keys[j] >> 63]
    assert pieces(len(keys), near) == pieces(len(keys), zip(u.tolist(), v.tolist(), strict=True))
    assert len(u) < len(keys)


def pieces(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def test_roots(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(330)] + [(k, k + 1) for k in range(500, 560)] + [
        (7, k) for k in range(600, 700)] + [(9, 9), (7, 600)]
    got = {r.node: r.root for r in roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = pieces(700, edges)
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}
    assert roots(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, fingerprint string, root int, row_id int, doc int")
    assert simhash.groups(docs).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns
    full = spark.createDataFrame([(1, "a b", "f", 1, 1, 1), (2, "a b", "f", 1, 1, 1)], docs.schema)
    assert [tuple(r) for r in simhash.keep_one(full).collect()] == [(1, "a b", "f", 1, 1, 1)]
    assert full.select(F.col("doc")).count() == 2
