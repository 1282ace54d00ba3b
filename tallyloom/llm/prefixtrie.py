"""The trie of conversations that share their first turns, from sorted sequences and a sparse table over their common lengths.

Conversations become sequences of turn digests, which Spark sorts by range (with the conversation id behind, so copies of one
sequence are spread too) and cuts into blocks of bounded size. Inside a block every prefix of every sequence searches by
halving how far left and how far right the common lengths stay at least as long as itself, on a sparse table of their minima.
The prefix whose left end is its own row stands for the node, so each node is found once and no stack is kept. Sums over
a node's rows are differences of running sums. Only nodes that reach over the edge of a block are summed up between blocks;
there are two paths of them a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.tables import frozen

# Fixed value: a word, as a pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a block, but for its last conversation.
BLOCK_TURNS = 16_384

PARTS = ("block long, open binary, above binary, last binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, ends_sha256 string, ends string")


def mark(role: str = "role", text: str = "text") -> Column:
    """128 bits of the role and text of a turn; nulls count as empty."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256), 1, 32))


def marked(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, position, mark, n_words``, one narrow row a turn, by ``order`` (null first), equal turns by their marks.

    Turns without a conversation id are left out.
    """
    narrow = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(order).alias("at"), mark(role, text).alias("mark"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    line = Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "mark")
    return narrow.select("conv_id", (F.row_number().over(line) - 1).cast("long").alias("position"), "mark", "n_words")


def _common(a: str, b: str) -> Column:
    """Length of the common start of two arrays."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a))


def sorted_blocks(sequences: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``sequences`` (conv_id, marks, words) in sorted order, with ``block``, ``at`` and the length that each has in common with the
    sequence before it (``before``) and after it (``after``), -1 at the two ends of the table."""
    order = ["marks", "conv_id"]
    placed = frozen(sequences.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "at", F.monotonically_increasing_id()), "sorted-sequences").withColumn("part", F.shiftright("at", 33))
    line = Window.partitionBy("part").orderBy("at")
    near = placed.withColumn("left", F.lag("marks").over(line)).withColumn("right", F.lead("marks").over(line)).withColumn(
        "load", F.sum(F.size("marks") + 1).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    # One row for each partition of the sorted table.
    ends = placed.groupBy("part").agg(F.min_by("marks", "at").alias("first"), F.max_by("marks", "at").alias("last"))
    parts = Window.orderBy("part")
    ends = ends.select(F.col("part").alias("p"), F.lag("last").over(parts).alias("ends_left"), F.lead("first").over(parts).alias("ends_right"))
    joined = near.join(ends, F.col("part") == F.col("p")).withColumn("left", F.coalesce("left", "ends_left")).withColumn(
        "right", F.coalesce("right", "ends_right"))
    block = F.shiftleft("part", 33) + F.floor(F.coalesce(F.col("load"), F.lit(0)) / block_turns)
    common = {n: F.coalesce(F.when(F.col(s).isNotNull(), _common("marks", s)), F.lit(-1)).cast("long")
              for n, s in (("before", "left"), ("after", "right"))}
    return joined.select(block.alias("block"), "at", "conv_id", "marks", "words", *[c.alias(n) for n, c in common.items()])


class SparseTable:
    """Minima of all stretches whose length is a power of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value of low .. high, both included."""
        level = np.log2(high - low + 1).astype(np.int64)
        out = np.empty(len(low), dtype=self.rows[0].dtype)
        for k, row in enumerate(self.rows):
            here = level == k
            out[here] = np.minimum(row[low[here]], row[high[here] - (1 << k) + 1])
        return out

    def reach_right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How far a stretch that begins at ``at`` goes on with values of at least ``bound``: the first place beyond it."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            fits = at < len(row)
            fits[fits] = row[at[fits]] >= bound[fits]
            at[fits] += 1 << k
        return at

    def reach_left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The same to the left: the first place of a stretch that ends just before ``at``."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row, start = self.rows[k], at - (1 << k)
            fits = start >= 0
            fits[fits] = row[start[fits]] >= bound[fits]
            at[fits] -= 1 << k
        return at


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def block_nodes(block: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one block: whole ones, and the parts of those that reach over its edges (``open`` has their digest)."""
    block = block.sort_values("at", ignore_index=True)
    conv = block["conv_id"].to_numpy(dtype=np.int64)
    marks, before, after = list(block["marks"]), block["before"].to_numpy(), block["after"].to_numpy()
    size = np.array([len(m) for m in marks], dtype=np.int64)
    words = np.concatenate([np.concatenate([[0], np.cumsum(w, dtype=np.int64)]) for w in block["words"]]).astype(np.int64)
    at = _sums(size + 1)[:-1]  # where a row's running words begin
    n, common = len(conv), SparseTable(before[1:])

    row = np.repeat(np.arange(n), size + 1)
    depth = np.arange(len(row)) - np.repeat(at, size + 1)
    left = common.reach_left(row, depth)
    right = common.reach_right(row, depth)
    own = left == row
    row, depth, right = row[own], depth[own], right[own]

    begins = before[row] < depth
    ends_here = ~((right == n - 1) & (after[-1] >= depth))
    whole_row = words[at + size]
    shared = np.maximum(before, 0)
    new_words, all_words = _sums(whole_row - words[at + shared]), _sums(whole_row)
    above = np.where(depth > 0, words[at[row] + np.maximum(depth - 1, 0)], 0)
    here = right - row + 1
    distinct = new_words[right + 1] - new_words[row] + np.where(begins, words[at[row] + shared[row]] - above, 0)
    saved = all_words[right + 1] - all_words[row] - here * above - distinct
    leaves = _sums(after < size)
    starts = np.sort((depth * n + row)[begins])
    children = np.searchsorted(starts, (depth + 1) * n + right, "right") - np.searchsorted(starts, (depth + 1) * n + row, "left")
    least = SparseTable(conv)

    parent_left = common.reach_left(row, depth - 1)
    parent_right = common.reach_right(row, depth - 1)
    parent_whole = (before[parent_left] < depth - 1) & ~((parent_right == n - 1) & (after[-1] >= depth - 1)) & (depth > 0)
    parent = least.least(parent_left, parent_right)
    spelled = [str(c) for c in conv.tolist()]

    def digest(k: int, d: int) -> bytes:
        return hashlib.sha256(b"".join(marks[k][:d])).digest()[:16]

    ends = []
    for k, d, r in zip(row.tolist(), depth.tolist(), right.tolist()):
        e = k
        while e <= r and size[e] == d:
            e += 1
        ends.append(",".join(spelled[k:e]))
    whole = begins & ends_here
    return pd.DataFrame({
        "block": block["block"].iloc[0],
        "open": [None if w else digest(k, d) for w, k, d in zip(whole, row, depth)],
        "above": [None if w or d == 0 else digest(k, d - 1) for w, k, d in zip(parent_whole, row, depth)],
        "last": [marks[k][d - 1] if d else None for k, d in zip(row, depth)],
        "conv_id": least.least(row, right), "depth": depth,
        "parent_conv_id": pd.arrays.IntegerArray(parent, ~parent_whole),
        "n_convs": here, "n_children": children, "n_leaves": leaves[right + 1] - leaves[row], "saved_tokens": saved,
        "ends_sha256": [hashlib.sha256(e.encode()).hexdigest() if w else None for w, e in zip(whole, ends)],
        "ends": [None if w else e for w, e in zip(whole, ends)]})


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the joined lists of each node, which come one after another in order; no list is put together."""
    node = state = None
    for frame in frames:
        done = []
        for key, ends in zip(frame["open"], frame["ends"]):
            if key != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield pd.DataFrame(done, columns=["key", "digest"])
    if state is not None:
        yield pd.DataFrame([(node, state.hexdigest())], columns=["key", "digest"])


#: Numbers that add up over the parts of a node.
ADDED = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def nodes(turns: DataFrame, ids: DataFrame | None = None, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row a node: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256`` and ``last``, the mark of its last turn (null for the root).

    ``turns`` comes from ``marked``; ``ids`` (conv_id) names conversations that may have no turn. Equal conversations are members
    of the same nodes and end in the same one. Tables without any conversation give no row, not even a root. A conversation
    is one array of 16 bytes a turn.
    """
    named = turns if ids is None else turns.unionByName(ids.select("conv_id"), allowMissingColumns=True)
    turn = F.when(F.col("position").isNotNull(), F.struct("position", "mark", "n_words"))
    whole = named.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t")).select(
        "conv_id", F.col("t.mark").alias("marks"), F.col("t.n_words").alias("words"))
    parts = frozen(sorted_blocks(whole, block_turns).groupBy("block").applyInPandas(block_nodes, PARTS), "trie-parts")
    crossing = parts.filter(F.col("open").isNotNull())
    lists = crossing.filter(F.col("ends") != "").select("open", "block", "ends").repartition("open").sortWithinPartitions(
        "open", "block").mapInPandas(_digests, "key binary, digest string")
    joined = frozen(crossing.groupBy("open").agg(
        *[F.min(n).alias(n) for n in ("above", "last", "conv_id", "depth")], *[F.sum(n).alias(n) for n in ADDED]).join(
            lists, F.col("open") == F.col("key"), "left").withColumn(
                "ends_sha256", F.coalesce("digest", F.sha2(F.lit(""), 256))).drop("key", "digest"), "trie-crossing")
    least = joined.select(F.col("open").alias("key"), F.col("conv_id").alias("least"))
    # Two paths a block: a node that lies whole in a block finds a parent that does not among these.
    near = crossing.select(F.col("block").alias("b"), "open").join(least, F.col("open") == F.col("key")).select("b", "key", "least")
    inside = parts.filter(F.col("open").isNull()).join(
        near, (F.col("block") == F.col("b")) & (F.col("above") == F.col("key")), "left")
    over = joined.withColumn("parent_conv_id", F.lit(None).cast("long")).join(least, F.col("above") == F.col("key"), "left")
    columns = ["conv_id", "depth", F.coalesce("parent_conv_id", "least").alias("parent_conv_id"), *ADDED, "ends_sha256", "last"]
    return inside.select(*columns).unionByName(over.select(*columns))


def with_texts(found: DataFrame, turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """The nodes with the ``role`` and ``text`` of their last turn, looked up by mark in the turns they came from."""
    said = turns.groupBy(mark(role, text).alias("m")).agg(
        *[F.coalesce(F.any_value(c), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    return found.join(said, F.col("last") == F.col("m"), "left").drop("m")
