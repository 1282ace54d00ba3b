"""A hashed maximum-entropy language model, trained and applied in Spark.

A word's probability is that of its class given the two words before, times that of its slot within the class given the
same, times the word's share of its slot. Class and slot are softmax distributions over sums of weight rows, one row for each
feature of the context: the word before, the two words before, and the word before that one (a skip). Features are
hashed into tables of fixed size. The most frequent words have a slot of their own; the others share slots by hash and
are told apart by their counts, over the whole training text and without any cap.

Training goes over every training document once, in rounds. In a round every task starts from the same weights, makes
gradient steps over its share of the round's documents and hands back by how much each block of rows has moved; the moves
are averaged by the number of tokens behind them. Scoring is one pass over the texts. Counts of frequent words go
along with it; those of all other words are joined in Spark.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast, SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tables import frozen

FOLDS, HELD_OUT = 7, 2
#: The end of a text, which no word can be.
END = b""
#: Hashes of contexts before the first word.
START = np.uint64(0x9E3779B97F4A7C15)
_MIX = [np.uint64(m) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
#: Rows of weights that travel as one piece.
BLOCK = 512


@dataclass(frozen=True)
class Shape:
    """``classes`` times ``slots`` slots. ``class_bits`` and ``slot_bits`` size the two weight tables (16 bits at most).
    ``head``: how many of the most frequent words travel to every task with their counts. ``flush``: distinct words a
    counting task holds. ``rounds``: averagings; each document is in one. ``chunk``: tokens of one gradient step.
    ``splits_per_task``: input splits that one training task takes, as far as every core still has one."""
    classes: int = 16
    slots: int = 32
    class_bits: int = 14
    slot_bits: int = 15
    head: int = 100_000
    flush: int = 300_000
    rounds: int = 2
    chunk: int = 2048
    rate: float = 0.1
    splits_per_task: int = 4


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased words and then the end. Null counts as empty."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def key_of(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the text null."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))


def is_held_out(doc_id: Column) -> Column:
    return key_of(doc_id) % FOLDS == HELD_OUT


def word_counts(docs: DataFrame, shape: Shape = Shape(), text: str = "text") -> DataFrame:
    """``word, c`` over all texts; the end is the empty word. Tasks add up their own words first."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for body in batch["text"]:
                held.update(tokens_of(body))
                if len(held) > shape.flush:
                    yield _counted(held)
                    held.clear()
        yield _counted(held)

    return docs.select(F.col(text).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _counted(held: Counter[bytes]) -> pd.DataFrame:
    return pd.DataFrame({"word": pd.Series([w.decode("utf-8", "surrogatepass") for w in held], dtype="object"),
                         "n": pd.Series(list(held.values()), dtype="int64")})


@dataclass
class Vocabulary:
    """What tasks need to know of the counts. ``head`` maps frequent words to their counts, most frequent first; the first
    ones have slots of their own. ``mass`` is the sum of count plus one over the words of a slot, plus one for all unknown."""
    total: int
    distinct: int
    head: dict[bytes, int]
    mass: np.ndarray
    shape: Shape

    def bucket(self, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        own = self.owned()
        size = self.shape.classes * self.shape.slots
        return np.fromiter((own.get(w, h % size) for w, h in zip(words, hashes.tolist(), strict=True)), dtype=np.int64, count=len(words))

    def owned(self) -> dict[bytes, int]:
        if not hasattr(self, "_owned"):
            size = self.shape.classes * self.shape.slots
            self._owned = {w: k for k, w in zip(range(size), self.head, strict=False)}
        return self._owned

    def shared(self, context: SparkContext) -> Broadcast[Vocabulary]:
        """The vocabulary on its way to the tasks, once for training and scoring."""
        if not hasattr(self, "_shared"):
            self._shared = context.broadcast(self)
        return self._shared

    def __getstate__(self) -> dict[str, object]:
        return {k: v for k, v in self.__dict__.items() if k not in ("_owned", "_shared")}


def vocabulary(counts: DataFrame, shape: Shape = Shape()) -> Vocabulary:
    """Reads totals per hash slot and the ``head`` most frequent words: both bounded by the shape."""
    size = shape.classes * shape.slots
    totals = counts.groupBy((F.crc32(F.col("word").cast("binary")) % size).alias("b")).agg(
        F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    mass = np.ones(size)
    for r in totals:
        mass[r["b"]] += r["c"] + r["v"]
    top = counts.orderBy(F.desc("c"), "word").limit(shape.head).select("word", "c").toArrow()
    head = {w.encode("utf-8", "surrogatepass"): c for w, c in zip(top["word"].to_pylist(), top["c"].to_pylist(), strict=True)}
    for k, w in zip(range(size), head, strict=False):
        mass[zlib.crc32(w) % size] -= head[w] + 1
        mass[k] += head[w] + 1
    return Vocabulary(sum(r["c"] for r in totals), sum(r["v"] for r in totals), head, mass, shape)


@dataclass
class Weights:
    by_class: np.ndarray
    by_slot: np.ndarray
    class_bias: np.ndarray
    slot_bias: np.ndarray

    @classmethod
    def fresh(cls, known: Vocabulary) -> Weights:
        """No context counts yet: classes and slots as frequent as in the counts."""
        shape = known.shape
        mass = known.mass.reshape(shape.slots, shape.classes).T
        return cls(np.zeros((1 << shape.class_bits, shape.classes), np.float32), np.zeros((1 << shape.slot_bits, shape.slots), np.float32),
                   np.log(mass.sum(axis=1) / mass.sum()).astype(np.float32), np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32))


@dataclass
class Batch:
    """Tokens of several texts laid end to end. ``kinds`` are the distinct words and ``ids`` points into them."""
    kinds: list[bytes]
    ids: np.ndarray
    lengths: np.ndarray
    context: np.ndarray
    bucket: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], known: Vocabulary) -> Batch:
        index: dict[bytes, int] = {}
        at, ids, lengths = index.setdefault, [], []
        for text in texts:
            words = tokens_of(text)
            lengths.append(len(words))
            ids += [at(w, len(index)) for w in words]
        kinds = list(index)
        hashes = np.fromiter(map(zlib.crc32, kinds), dtype=np.int64, count=len(kinds))
        ids, lengths = np.array(ids, dtype=np.int64), np.array(lengths, dtype=np.int64)
        spread = (hashes.astype(np.uint64) + np.uint64(1)) * _MIX[0]
        seq = spread[ids] if len(ids) else np.zeros(0, np.uint64)
        first = np.cumsum(lengths) - lengths
        one, two = np.roll(seq, 1), np.roll(seq, 2)
        one[first] = START
        two[first] = START
        two[(first + 1)[lengths > 1]] = START
        context = np.stack([_mixed(one, 1), _mixed(one * _MIX[1] + two, 2), _mixed(two, 3)])
        return cls(kinds, ids, lengths, context, known.bucket(kinds, hashes)[ids] if len(ids) else ids)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[k]
    return x ^ (x >> np.uint64(29))


def _rows(context: np.ndarray, group: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the class table, and of the slot table for the given classes; one line per feature."""
    slot = (context + (group.astype(np.uint64) + np.uint64(1)) * _MIX[3]) * _MIX[1]
    return ((context >> np.uint64(64 - shape.class_bits)).astype(np.uint16), (slot >> np.uint64(64 - shape.slot_bits)).astype(np.uint16))


def _softmax(table: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    x = table.take(rows[0], axis=0)
    for more in rows[1:]:
        x += table.take(more, axis=0)
    x += bias
    x -= np.ascontiguousarray(x.T).max(axis=0)[:, None]
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def parts(weights: Weights, context: np.ndarray, bucket: np.ndarray, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Probabilities of all classes, and of all slots within each token's class, with the rows and the column that is hit."""
    group, slot = bucket % shape.classes, bucket // shape.classes
    by_class, by_slot = _rows(context, group, shape)
    yield _softmax(weights.by_class, by_class, weights.class_bias), by_class, group
    yield _softmax(weights.by_slot, by_slot, weights.slot_bias[group]), by_slot, slot


def log10_slots(weights: Weights, batch: Batch, shape: Shape) -> np.ndarray:
    """log10 of class and slot probability of each token."""
    out = np.empty(len(batch.ids))
    for a in range(0, len(out), shape.chunk):
        part = slice(a, a + shape.chunk)
        chances = [p[np.arange(len(hit)), hit] for p, _, hit in parts(weights, batch.context[:, part], batch.bucket[part], shape)]
        out[part] = np.log10(chances[0]) + np.log10(chances[1])
    return out


def _summed(up: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and for each the sum of the lines of ``up`` that any feature has there. Most rows have one line,
    which is copied."""
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    ordered, line = flat[order], order % len(up)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    times = np.diff(starts, append=len(flat))
    several = times > 1
    summed = up.take(line[starts], axis=0)
    if several.any():
        edges = np.cumsum(times[several]) - times[several]
        summed[several] = np.add.reduceat(up.take(line[np.repeat(several, times)], axis=0), edges, axis=0)
    return ordered[starts], summed


class Trainer:
    """Gradient steps with a step size of its own for each weight."""

    def __init__(self, start: Weights, shape: Shape):
        self.start, self.shape = start, shape
        self.now = Weights(start.by_class.copy(), start.by_slot.copy(), start.class_bias, start.slot_bias)
        self.seen = [np.full_like(start.by_class, 1.0), np.full_like(start.by_slot, 1.0)]
        self.tokens = 0

    def learn(self, batch: Batch) -> None:
        shape = self.shape
        self.tokens += len(batch.ids)
        for a in range(0, len(batch.ids), shape.chunk):
            part = slice(a, a + shape.chunk)
            steps = list(parts(self.now, batch.context[:, part], batch.bucket[part], shape))
            for table, seen, (up, rows, hit) in zip((self.now.by_class, self.now.by_slot), self.seen, steps, strict=True):
                np.negative(up, out=up)
                up[np.arange(len(hit)), hit] += 1.0
                at, summed = _summed(up, rows)
                spread = seen.take(at, axis=0)
                spread += summed * summed
                seen[at] = spread
                summed *= shape.rate
                summed /= np.sqrt(spread)
                summed += table.take(at, axis=0)
                table[at] = summed

    def moves(self) -> Iterator[tuple[int, int, bytes]]:
        """(block, tokens, how far its rows have moved) of each block that has moved; blocks of the class table first."""
        block = 0
        for before, after in ((self.start.by_class, self.now.by_class), (self.start.by_slot, self.now.by_slot)):
            for a in range(0, len(before), BLOCK):
                move = after[a:a + BLOCK] - before[a:a + BLOCK]
                if move.any():
                    yield block, self.tokens, move.astype(np.float16).tobytes()
                block += 1


def _batches(texts: pd.Series, known: Vocabulary, size: int = 1 << 22) -> Iterator[Batch]:
    """Batches of some four million characters or a single text, in order."""
    held, chars = [], 0
    for text in texts:
        held.append(text)
        chars += len(text or "")
        if chars >= size:
            yield Batch.of(held, known)
            held, chars = [], 0
    if held:
        yield Batch.of(held, known)


def _added(moves: DataFrame, *keys: str) -> DataFrame:
    """Sums of moves weighted by tokens, per key; one running sum is all that a task holds of a key."""
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, ...], list] = {}
        for frame in frames:
            for row in frame.itertuples(index=False):
                kind = np.float16 if row.raw else np.float32
                move = np.frombuffer(row.move, kind).astype(np.float32) * (row.tokens if row.raw else 1.0)
                held = sums.setdefault((row.block, row.salt), [0, 0.0])
                held[0] += row.tokens
                held[1] = held[1] + move
        for (block, salt), (tokens, move) in sums.items():
            yield pd.DataFrame({"block": [block], "salt": [salt], "tokens": [tokens], "move": [move.astype(np.float32).tobytes()], "raw": [False]})
    return moves.repartition(*keys).mapInPandas(add, MOVES)


MOVES = "block int, salt int, tokens long, move binary, raw boolean"


def train(docs: DataFrame, known: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> Weights:
    """Weights after one pass over ``docs``. What comes back to the driver is the size of the weights, in each round."""
    shape, context = known.shape, docs.sparkSession.sparkContext
    rows = docs.select(F.col(text).alias("text"), (F.floor(key_of(F.col(doc_id)) / FOLDS) % shape.rounds).alias("turn"))
    splits = rows.rdd.getNumPartitions()
    tasks = min(splits, max(context.defaultParallelism, splits // shape.splits_per_task))
    weights, shared = Weights.fresh(known), known.shared(context)
    for turn in range(shape.rounds):
        sent = context.broadcast(weights)

        def step(frames: Iterator[pd.DataFrame], sent: Broadcast[Weights] = sent) -> Iterator[pd.DataFrame]:
            trainer = Trainer(sent.value, shape)
            for frame in frames:
                for batch in _batches(frame["text"], shared.value):
                    trainer.learn(batch)
            moves = list(trainer.moves())
            salt = trainer.tokens % 32
            yield pd.DataFrame({"block": [m[0] for m in moves], "salt": salt, "tokens": [m[1] for m in moves],
                                "move": pd.Series([m[2] for m in moves], dtype="object"), "raw": True})

        moves = rows.filter(F.col("turn") == turn).select("text").coalesce(tasks).mapInPandas(step, MOVES)
        moved = _added(_added(moves, "block", "salt").withColumn("salt", F.lit(0)), "block").collect()
        weights = _moved(weights, {r["block"]: (r["tokens"], bytes(r["move"])) for r in moved}, shape)
        sent.unpersist()
    return weights


def _moved(weights: Weights, moved: dict[int, tuple[int, bytes]], shape: Shape) -> Weights:
    every = max((tokens for tokens, _ in moved.values()), default=1)
    block, tables = 0, []
    for table in (weights.by_class, weights.by_slot):
        new = table.copy()
        for a in range(0, len(new), BLOCK):
            if block in moved:
                new[a:a + BLOCK] += np.frombuffer(moved[block][1], np.float32).reshape(-1, new.shape[1]) / every
            block += 1
        tables.append(new)
    return Weights(tables[0], tables[1], weights.class_bias, weights.slot_bias)


SCORED = ("struct<n_tokens: bigint, head_known: bigint, head_log: double, slot_log: double, "
          "tail: string, tail_n: array<int>>")


def _scored(batch: Batch, known: Vocabulary, weights: Weights, mass: np.ndarray) -> pd.DataFrame:
    """Per text: tokens, those in the head, and log10 sums of count plus one and of class, slot and share; words beyond the
    head, between blanks, and how often each comes."""
    count = np.fromiter((known.head.get(w, 0) for w in batch.kinds), dtype=np.float64, count=len(batch.kinds))
    ends = np.cumsum(batch.lengths)
    starts = ends - batch.lengths
    in_head = count > 0
    rare_at = ~in_head[batch.ids]
    tails, times = [], []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        rare, n = np.unique(batch.ids[a:b][rare_at[a:b]], return_counts=True)
        tails.append(b" ".join([batch.kinds[k] for k in rare.tolist()]).decode("utf-8", "surrogatepass"))
        times.append(n.astype(np.int32))
    return pd.DataFrame({
        "n_tokens": batch.lengths, "head_known": np.add.reduceat(in_head[batch.ids].astype(np.int64), starts),
        "head_log": np.add.reduceat(np.log10(count + 1.0)[batch.ids], starts),
        "slot_log": np.add.reduceat(log10_slots(weights, batch, known.shape) - mass[batch.bucket], starts),
        "tail": pd.Series(tails, dtype="object"), "tail_n": pd.Series(times, dtype="object")})


def score(docs: DataFrame, counts: DataFrame, known: Vocabulary, weights: Weights, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    A null text is the end alone. Repeated rows get a score each. Without training text every token has the
    same share, and the score comes from the untrained model.
    """
    context = docs.sparkSession.sparkContext
    shared, sent = known.shared(context), context.broadcast(weights)

    @F.pandas_udf(SCORED)
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, weights = shared.value, sent.value
        mass = np.log10(known.mass)
        for part in texts:
            yield pd.concat([_scored(batch, known, weights, mass) for batch in _batches(part, known)], ignore_index=True)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), scored(F.col(text)).alias("m"))
    whole = frozen(rows.select("doc_id", "row_id", "m.*"), "scored")
    pairs = F.arrays_zip(F.split("tail", " ").alias("w"), F.col("tail_n").alias("n"))
    tail = whole.filter(F.size("tail_n") > 0).select("row_id", F.explode(pairs).alias("t")).select("row_id", "t.w", "t.n")
    rare = tail.join(counts, F.col("w") == F.col("word")).groupBy(F.col("row_id").alias("r")).agg(
        F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("tail_log"))
    rows = whole.drop("tail", "tail_n").join(rare, F.col("row_id") == F.col("r"), "left")
    logs = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0))
    share = float(np.log10(known.total + known.distinct + 1))
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
                       (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
                       F.lit(known.total).cast("long").alias("train_tokens"),
                       (logs - F.col("n_tokens") * share).alias("base_score"), (logs + F.col("slot_log")).alias("score"))


def model(docs: DataFrame, shape: Shape = Shape(), doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Vocabulary, Weights]:
    """Counts, vocabulary and weights from the documents that are not held out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(~is_held_out(F.col("doc_id")))
    counts = frozen(word_counts(rows, shape), "word-counts")
    known = vocabulary(counts, shape)
    return counts, known, train(rows, known)
