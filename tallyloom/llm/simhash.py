"""Near-duplicate documents by simhash, joined through binary tries.

A fingerprint holds for each bit whether most shingle hashes of the document set it. Two fingerprints link if few of
their bits differ. Distinct fingerprints go into one trie for each of ``distance + 1`` bit blocks, with that block turned
to the front. At most ``distance`` bits differ, so every linked pair agrees on some whole block: in that trie the error
budget of the leading block is nought, which lets Spark deal the tries out by leading block. Below it, pairs of
nodes are walked together; a pair of nodes carries the bits that differ so far and is dropped once they are too
many. Only links that join two pieces come out of a walk, so a crowd of n copies costs n - 1 edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import roots
from tallyloom.llm.tables import frozen

BITS = 64
# Fixed value: the seed of the shingle hash.
SEED = 42
#: Pairs of nodes that one step of a walk holds.
FRONTIER = 1 << 20


@dataclass(frozen=True)
class Near:
    """Shingle length in words, the most bits that may differ, and how many fingerprints of one block value one task walks
    together."""
    shingle: int = 4
    distance: int = 4
    crowd: int = 100_000


def fingerprint_of(text: str | None, shingle: int) -> int:
    """The fingerprint as a signed 64-bit number; no words give nought."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        join = b" ".join
        grams = map(join, zip(*[words[k:] for k in range(shingle)], strict=False))
        hashes = np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64, count=len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")
    return of(text)


def blocks(first: int, distance: int) -> list[tuple[int, int]]:
    """(first bit, length) of ``distance + 1`` blocks that cover the bits from ``first`` on."""
    ends = [first + round((BITS - first) * k / (distance + 1)) for k in range(distance + 2)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


class _Pieces:
    """Union-find over positions, with whole ranges that are one piece found in one step."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hook the roots of all pairs on the least root around them until nothing changes."""
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up

    def breaks(self) -> np.ndarray:
        """Running number of places where neighbours belong to different pieces."""
        return np.concatenate([[0], np.cumsum(self.root[1:] != self.root[:-1])])


def _walk(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: int, budget: int, pieces: _Pieces) -> None:
    """Link all keys of a bucket within ``budget`` bits. ``keys`` are sorted inside each [start, end); the first
    ``lead`` bits are equal there. Node pairs that lie in one piece already are dropped too."""
    zero = np.zeros(len(starts), dtype=np.int64)
    stack = [(starts, ends, starts, ends, zero + lead, zero)]
    while stack:
        a0, a1, b0, b1, depth, spent = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack.append(tuple(x[half:] for x in (a0, a1, b0, b1, depth, spent)))
            a0, a1, b0, b1, depth, spent = (x[:half] for x in (a0, a1, b0, b1, depth, spent))
        runs = pieces.breaks()
        one = (runs[a1 - 1] == runs[a0]) & (runs[b1 - 1] == runs[b0]) & (pieces.root[a0] == pieces.root[b0])
        a0, a1, b0, b1, depth, spent = (x[~one] for x in (a0, a1, b0, b1, depth, spent))
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaves.any():
            x, y = a0[leaves], b0[leaves]
            near = np.bitwise_count(keys[x] ^ keys[y]) <= budget
            pieces.link(x[near], y[near])
        a0, a1, b0, b1, depth, spent = (x[~leaves] for x in (a0, a1, b0, b1, depth, spent))
        if not len(a0):
            continue
        am, bm = _split(keys, a0, a1, depth), _split(keys, b0, b1, depth)
        same, depth = (a0 == b0) & (a1 == b1), depth + 1
        parts = [(a0, am, b0, bm, depth, spent), (am, a1, bm, b1, depth, spent), (a0, am, bm, b1, depth, spent + 1)]
        other = ~same
        parts.append(tuple(x[other] for x in (am, a1, b0, bm, depth, spent + 1)))
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        live = (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[5] <= budget)
        stack.append(tuple(x[live] for x in joined))


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where in [lo, hi) the bit at ``depth`` turns to one."""
    shift = (BITS - 1 - depth).astype(np.uint64)
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        one = (keys[np.minimum(mid, len(keys) - 1)] >> shift) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def links(keys: np.ndarray, lead: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges as positions in ``keys``: they join all keys which agree on the first ``lead`` bits and link within the
    budget, through any number of steps. ``keys`` are distinct and sorted."""
    none = np.zeros(0, dtype=np.int64)
    if not len(keys):
        return none, none
    head = keys >> np.uint64(BITS - lead)
    starts = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    ends = np.append(starts[1:], len(keys))
    many = ends - starts > 1
    pieces = _Pieces(len(keys))
    # One bit first: it ties most of a crowd together cheaply, and the full walk skips what is tied.
    for step in sorted({min(1, budget), budget}):
        _walk(keys, starts[many], ends[many], lead, step, pieces)
    hung = np.flatnonzero(pieces.root != np.arange(len(keys)))
    return hung, pieces.root[hung]


def _turn(values: np.ndarray, first: int, by: int) -> np.ndarray:
    """Rotate the bits from ``first`` on to the left; the bits before it stay."""
    size = np.uint64(BITS - first)
    mask = np.uint64((1 << (BITS - first)) - 1)
    low = values & mask
    turned = values.copy() if by == 0 else (low << np.uint64(by)) & mask | (low >> (size - np.uint64(by)))
    return (values & ~mask) | (turned & mask)


def _bits(value: Column, first: int, length: int) -> Column:
    return F.shiftrightunsigned(F.shiftleft(value, first), BITS - length)


def near_edges(prints: DataFrame, near: Near) -> DataFrame:
    """Distinct ``fingerprint`` values to edges ``u, v`` that connect whatever links within the distance.

    A trie node under a whole block that holds more than ``near.crowd`` fingerprints is dealt out once more, by blocks
    of the bits that are left: the same argument holds for them.
    """
    cut = blocks(0, near.distance)
    inner = [blocks(length, near.distance) for _, length in cut]

    def walk(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        if not parts:
            return
        for (trie, sub), own in pd.concat(parts).groupby(["trie", "sub"]):
            first, lead = cut[trie]
            values = own["fingerprint"].to_numpy().view(np.uint64)
            keys = _turn(values, 0, first)
            if sub >= 0:
                start, length = inner[trie][sub]
                keys, lead = _turn(keys, lead, start - lead), lead + length
            order = np.argsort(keys)
            u, v = links(keys[order], lead, near.distance)
            held = values.view(np.int64)[order]
            yield pd.DataFrame({"u": held[u], "v": held[v]})

    tries = [F.struct(F.lit(k).alias("trie"), _bits(F.col("fingerprint"), first, length).alias("head"))
             for k, (first, length) in enumerate(cut)]
    dealt = prints.select("fingerprint", F.explode(F.array(*tries)).alias("t")).select("fingerprint", "t.trie", "t.head")
    crowded = dealt.groupBy("trie", "head").count().filter(F.col("count") > near.crowd).select(
        F.col("trie").alias("t"), F.col("head").alias("h"), F.lit(True).alias("crowded"))
    marked = dealt.join(frozen(crowded, "crowded"), (F.col("trie") == F.col("t")) & (F.col("head") == F.col("h")), "left")

    def within(first: int, rest: list[tuple[int, int]]) -> Column:
        """The inner blocks of a fingerprint whose block at ``first`` is turned to the front."""
        size = rest[0][0]
        subs = []
        for k, (start, length) in enumerate(rest):
            at = (first + start) % BITS
            over = at + length - BITS
            value = _bits(F.col("fingerprint"), at, length) if over <= 0 else F.shiftleft(
                _bits(F.col("fingerprint"), at, length - over), over).bitwiseOR(_bits(F.col("fingerprint"), 0, over))
            subs.append(F.struct(F.lit(k).alias("sub"), value.alias("part")))
        assert size + sum(n for _, n in rest) == BITS
        return F.array(*subs)

    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("part")))
    again = F.lit(None)
    for k, (first, _) in enumerate(cut):
        again = F.when(F.col("trie") == k, within(first, inner[k])).otherwise(again)
    parts = marked.select("fingerprint", "trie", "head", F.explode(F.when(F.col("crowded"), again).otherwise(whole)).alias("p"))
    parts = parts.select("fingerprint", "trie", "head", "p.sub", "p.part")
    return parts.repartition("trie", "head", "sub", "part").mapInPandas(walk, "u long, v long")


def with_components(rows: DataFrame, near: Near) -> DataFrame:
    """``rows`` with ``fingerprint`` and ``doc_id``, and of each the ``root`` of its component, a fingerprint, and its
    ``component_id``, the least doc_id reachable.

    Null ids count only where a component has no other; its component_id is null then. An empty table stays empty.
    """
    prints = frozen(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "prints")
    found = frozen(roots(frozen(near_edges(prints.select("fingerprint"), near), "links")), "roots")
    rooted = prints.join(found, prints["fingerprint"] == found["node"], "left").select(
        F.col("fingerprint").alias("print"), "least", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = rooted.join(least, F.col("root") == F.col("r")).select("print", "root", "component_id")
    return rows.join(frozen(named, "named"), F.col("fingerprint") == F.col("print")).drop("print")


def groups(docs: DataFrame, near: Near = Near(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document. Null text has no words and fingerprint nought."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), near.shingle).alias("fingerprint"))
    return with_components(frozen(rows, "fingerprints"), near).drop("root")


def keep_one(docs: DataFrame, near: Near = Near(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with its own columns: the least doc_id (null last), and one row if that id repeats."""
    rows = frozen(docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("doc_id"),
                              F.monotonically_increasing_id().alias("row_id"),
                              fingerprint(F.col(text), near.shingle).alias("fingerprint")), "fingerprinted")
    named = with_components(rows.select("doc_id", "row_id", "fingerprint"), near)
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("best"))
    # The list grows with the documents, so it is never broadcast, however short it is here.
    keepers = frozen(first.select(F.col("best.row_id").alias("kept_row")), "keepers").hint("merge")
    return rows.join(keepers, F.col("row_id") == F.col("kept_row"), "left_semi").select("doc.*")
