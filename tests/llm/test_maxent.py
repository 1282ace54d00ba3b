import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tallyloom.llm import maxent
from tallyloom.llm.maxent import Shape


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


def held(doc_id):
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % 7 == 2


def docs():
    """Text with a grammar: what comes next depends on the word before."""
    draw = random.Random(6)
    names = [f"n{k}" for k in range(30)]
    follow = {n: draw.sample(names, 3) for n in names}
    rows = []
    for k in range(300):
        now, out = draw.choice(names), []
        for _ in range(draw.randrange(40, 120)):
            out.append(now.upper() if draw.random() < 0.1 else now)
            now = draw.choice(follow[now])
        rows.append((k, " ".join([*out, f"rare{k % 60}"])))
    return rows + [(1000, None), (1001, ""), (1002, "Ünk  nown\x0bÜnk\x85x"), (None, "n1 n2"), (7, "n1 n2"), (7, "n1 n2"), (1003, "n1 " * 30_000)]


@pytest.mark.parametrize("head", [1, 20])
def test_scores(spark, head):
    rows = docs()
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row_id", "'w' AS word", "2 AS c", "3 AS m").repartition(6)
    shape = Shape(classes=4, slots=8, head=head, flush=10, splits_per_task=2)
    counts, known, weights = maxent.model(frame, shape)
    got = maxent.score(frame, counts, known, weights).collect()
    assert len(got) == len(rows)
    count = Counter(w for i, t in rows if not held(i) for w in words(t))
    total, distinct = sum(count.values()), len(count)
    assert (known.total, known.distinct, len(known.head)) == (total, distinct, head)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    base = model = 0.0
    for r in got:
        options = []
        for t in texts[r.doc_id]:
            own = words(t)
            want = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own)
            options.append((len(own), sum(count[w] > 0 for w in own), round(want, 6)))
        assert (r.n_tokens, r.n_known, round(r.base_score, 6)) in options
        assert r.held_out == held(r.doc_id) and r.train_tokens == total and math.isfinite(r.score)
        if r.held_out:
            base, model = base + r.base_score, model + r.score
    assert model > 0.8 * base, "the model must gain from the word before"
    text = rows[5][1]
    batch = maxent.Batch.of([text], known)
    alone = sum(p + math.log10((count[w] + 1) / known.mass[b]) for p, w, b in
                zip(maxent.log10_slots(weights, batch, shape), words(text), batch.bucket, strict=True))
    assert abs(alone - next(r.score for r in got if r.doc_id == 5)) < 1e-6


def test_probabilities_add_up(spark):
    rows = docs()[:40]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    shape = Shape(classes=4, slots=8, head=20)
    counts, known, weights = maxent.model(frame, shape)
    count = {r.word.encode(): r.c for r in counts.collect()}
    mass = np.ones(32)
    for w, c in count.items():
        mass[maxent.Batch.of([None], known).bucket[0] if w == b"" else known.bucket([w], np.array([zlib.crc32(w)]))[0]] += c + 1
    assert np.allclose(mass, known.mass)
    context = maxent.Batch.of([rows[0][1]], known).context[:, 3:4]
    every = 0.0
    for bucket in range(32):
        chances = [p[0, hit[0]] for p, _, hit in maxent.parts(weights, context, np.array([bucket]), shape)]
        every += chances[0] * chances[1]
    assert abs(every - 1) < 1e-4


def test_classes_and_slots_see_every_feature():
    shape = Shape(classes=4, slots=8)
    known = maxent.Vocabulary(10, 3, {b"": 3, b"n1": 4, b"n2": 3}, np.full(32, 2.0), shape)
    batch = maxent.Batch.of(["n1 n2 n1"], known)
    before = maxent.log10_slots(maxent.Weights.fresh(known), batch, shape)
    for k, table in enumerate(("by_class", "by_slot")):
        group, slot = batch.bucket % shape.classes, batch.bucket // shape.classes
        rows = maxent._rows(batch.context, group, shape)[k]
        assert len(rows) == len(batch.context) == 3, "the word before, the two words before, the skip"
        for feature in rows:
            weights = maxent.Weights.fresh(known)
            getattr(weights, table)[feature[2], (group, slot)[k][2]] += 1.0
            assert maxent.log10_slots(weights, batch, shape)[2] > before[2] + 0.1


def test_moves_of_a_row_add_up():
    draw = np.random.default_rng(3)
    up, rows = draw.normal(size=(50, 4)).astype(np.float32), draw.integers(0, 40, (3, 50)).astype(np.uint16)
    want = np.zeros((40, 4), np.float32)
    np.add.at(want, rows, up[None])
    at, got = maxent._summed(up, rows)
    assert at.tolist() == sorted(set(rows.ravel().tolist())) and np.allclose(got, want[at], atol=1e-5)


def test_batches_do_not_change_scores():
    known = maxent.Vocabulary(10, 3, {b"": 3, b"n1": 4, b"n2": 3}, np.full(32, 2.0), Shape(classes=4, slots=8))
    texts = pd.Series(["n1 n2 n1", None, "", "n2"])
    weights = maxent.Weights.fresh(known)
    weights.by_class += np.arange(weights.by_class.size, dtype=np.float32).reshape(weights.by_class.shape) % 7
    whole = maxent._scored(maxent.Batch.of(list(texts), known), known, weights, np.log10(known.mass))
    each = pd.concat([maxent._scored(b, known, weights, np.log10(known.mass)) for b in maxent._batches(texts, known, 1)])
    assert np.allclose(whole["slot_log"], each["slot_log"]) and whole["n_tokens"].tolist() == each["n_tokens"].tolist() == [4, 1, 1, 2]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    counts, known, weights = maxent.model(none, Shape(classes=4, slots=8))
    assert maxent.score(none, counts, known, weights).count() == 0
    one = spark.createDataFrame([(1, "a b")], none.schema)
    assert [r.base_score for r in maxent.score(one, counts, known, weights).collect()] == [0.0]
