"""A comparison join of two large sides, as an equality join on cells.

Sampled cut points of the right column make places: one for each cut value and one for what lies between two of them. Counts of
both sides by place, summed up along the places, number all rows in the order of the compared value, and every ``CELL_ROWS`` of these
numbers are a block. A row goes to its own block and, by the numbers alone, to all blocks of the other side that can hold a
partner; a cell is one left and one right block. So copies of a row follow the size of the answer, and the rows of a value that
fills a side are dealt over as many blocks as they ask for. Rows that are equal in all columns are dealt by input partition,
so a cell is a block at most, or what equal rows a few input partitions hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordering import is_small, kept, prefix_scan, scan_keys

#: Rows of a block, and of the values between two cut points.
CELL_ROWS = 20_000
#: Sampled values for each cut point.
PICKED = 20
#: Cut points of a branch of the lookup, and salts of a lookup that is too large to broadcast.
FAN = 1024
SALTS = 16
#: What a comparison says when its sides are exchanged.
FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "!=": "!=", "LIKE": "LIKE"}


@dataclass(frozen=True)
class Places:
    """Where the rows of two sides lie: a row for each branch of cut points, with the row numbers of its places."""

    trunk: Column
    branches: DataFrame
    left_rows: int
    right_rows: int


def _summed(df: DataFrame, order: str, sums: dict[str, Column]) -> DataFrame:
    """Running sums of a written table: in one task while it is measured small, in ranges beyond."""
    return (scan_keys if is_small(df) else prefix_scan)(df, [], [order], sums=sums)


def cut_points(values: DataFrame, ranges: int | None = None, rows: int = CELL_ROWS) -> DataFrame:
    """``point, number``: distinct values of the column ``point`` that cut it into pieces of about ``rows`` rows, numbered from 1.

    The points come from a sample that grows with the table. A value that many rows share is a point of its own.
    """
    total = values.count()
    each = rows if ranges is None else max(1, total // ranges)
    share = min(1.0, PICKED / each)
    step = max(1, round(share * each))
    sample = kept(values.filter("point IS NOT NULL").sample(False, share, 11).groupBy("point").agg(F.count(F.lit(1)).alias("n")), "points")
    upto = _summed(sample, "point", {"upto": F.col("n")})
    cuts = kept(upto.filter(F.floor(F.col("upto") / step) > F.floor((F.col("upto") - F.col("n")) / step)).select("point"), "cut-points")
    return _summed(cuts, "point", {"number": F.lit(1).cast("long")})


def _upto(value: Column, cuts: Column) -> Column:
    """How many of the sorted cut points are at or below a value, by halving; 0 where there are none."""
    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        open_, right = at["low"] < at["high"], F.coalesce(F.get(cuts, middle) <= at["v"], F.lit(False))
        return F.struct(at["v"].alias("v"), F.when(open_ & right, middle + 1).otherwise(at["low"]).alias("low"),
                        F.when(open_ & ~right, middle).otherwise(at["high"]).alias("high"))

    size = F.coalesce(F.size(cuts), F.lit(0))
    size = F.when(size > 0, size).otherwise(F.lit(0))
    # The value goes in with the start: an optimizer rule that carries conditions across a join overlooks columns in a lambda body.
    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(size.cast("long")))),
                       F.struct(value.alias("v"), F.lit(0).alias("low"), size.alias("high")), halve, lambda at: at["low"])


def _with_branch(frame: DataFrame, value: Column, trunk: Column, branches: DataFrame) -> DataFrame:
    """The frame with ``_branch`` and the other columns of its branch, and ``_place``: null for a null value.

    Place 2r lies after r cut points and place 2r - 1 is the r-th cut point itself.
    """
    # Equal rows of different partitions are dealt apart; a task that runs again deals its rows alike.
    dealt = frame.withColumn("_deal", F.xxhash64("*", F.spark_partition_id()))
    dealt = dealt.withColumn("_trunk", trunk)
    dealt = dealt.withColumn("_branch", F.when(value.isNotNull(), _upto(value, F.col("_trunk")).cast("long") - 1)).drop("_trunk")
    held = branches.select(*[F.col(c).alias(f"_of_{c}") for c in branches.columns])
    if is_small(branches):
        joined = dealt.join(F.broadcast(held), F.col("_branch") == F.col("_of_branch"), "left")
    else:
        salted = held.withColumn("_of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(salted, (F.col("_branch") == F.col("_of_branch")) & (F.pmod("_deal", F.lit(SALTS)) == F.col("_of_salt")),
                            "left").drop("_of_salt")
    rank = _upto(value, F.col("_of_leaf"))
    cut = F.coalesce(F.get(F.col("_of_leaf"), rank - 1) == value, F.lit(False))
    first = F.greatest(F.col("_branch"), F.lit(0)) * FAN
    return joined.withColumn("_place", F.when(value.isNotNull(), 2 * (first + rank) - cut.cast("long"))).drop("_of_branch", "_of_leaf")


def _branch_of(place: Column) -> Column:
    return F.when(place == 0, F.lit(-1)).otherwise(F.floor((F.floor((place + 1) / 2) - 1) / FAN)).cast("long")


def _lookup(cuts: DataFrame) -> tuple[Column, DataFrame]:
    """The first cut points of all branches, and the cut points of each branch."""
    leaves = kept(cuts.groupBy(_branch_of(F.col("number") * 2).alias("branch")).agg(
        F.array_sort(F.collect_list("point")).alias("leaf")), "leaves")
    return leaves.select(F.array_sort(F.collect_list(F.get("leaf", F.lit(0)))).alias("firsts")).scalar(), leaves


def with_pieces(df: DataFrame, order: list[str], name: str, rows: int, ranges: int | None = None) -> DataFrame:
    """``df`` with the number of the piece, of about ``rows`` rows, that a row lies in along ``order``; nulls come first."""
    point = F.struct(*order)
    trunk, leaves = _lookup(kept(cut_points(df.select(point.alias("point")), ranges, rows), "cuts"))
    placed = _with_branch(df, point, trunk, leaves)
    return placed.select(*df.columns, F.floor(F.col("_place") / 2).alias(name))


def lay_out(left: DataFrame, left_value: Column, right: DataFrame, right_value: Column, ranges: int | None = None) -> Places:
    """Cut points of the right values, and for each place the numbers of the rows that lie in it."""
    cuts = kept(cut_points(right.select(right_value.alias("point")), ranges), "cuts")
    trunk, leaves = _lookup(cuts)

    def counted(frame: DataFrame, value: Column, name: str) -> DataFrame:
        # Only the compared value is read; rows are counted by place before they move.
        placed = _with_branch(frame.select(value.alias("_v")), F.col("_v"), trunk, leaves)
        return placed.filter("_place IS NOT NULL").groupBy("_place").agg(F.count(F.lit(1)).alias(name))

    counts = counted(left, left_value, "l").join(counted(right, right_value, "r"), "_place", "full")
    every = left.sparkSession.range(2 * cuts.count() + 1).select(F.col("id").alias("_place")).join(counts, "_place", "left")
    every = kept(every.fillna(0, ["l", "r"]), "places")
    numbered = _summed(every, "_place", {"l_to": F.col("l"), "r_to": F.col("r")})
    span = F.struct("_place", (F.col("l_to") - F.col("l")).alias("l_from"), "l_to", (F.col("r_to") - F.col("r")).alias("r_from"), "r_to")
    spans = numbered.groupBy(_branch_of(F.col("_place")).alias("branch")).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    branches = kept(spans.join(leaves, "branch", "left"), "branches")
    rows = every.agg(F.sum("l"), F.sum("r")).first()
    return Places(trunk, branches, rows[0], rows[1])


def _blocks(start: Column, end: Column, block: int) -> Column:
    """The blocks of rows number ``start`` to ``end``, the end left out."""
    some = F.sequence(F.floor(start / block).cast("long"), F.floor((end - 1) / block).cast("long"))
    return F.when(start < end, some).otherwise(F.array().cast("array<bigint>"))


def _visited(op: str, start: Column, end: Column, is_cut: Column, total: int, block: int) -> Column:
    """Blocks of the other side with a possible partner of a row whose place holds that side's rows ``start`` to ``end``.

    All rows in the place of a cut point have one value, which is left out where equals are no partners.
    """
    zero, last = F.lit(0).cast("long"), F.lit(total).cast("long")
    if op == "<":
        return _blocks(F.when(is_cut, end).otherwise(start), last, block)
    if op == "<=":
        return _blocks(start, last, block)
    if op == ">":
        return _blocks(zero, F.when(is_cut, start).otherwise(end), block)
    if op == ">=":
        return _blocks(zero, end, block)
    if op == "!=":
        others = F.array_union(_blocks(zero, start, block), _blocks(end, last, block))
        return F.when(is_cut, others).otherwise(_blocks(zero, last, block))
    return _blocks(zero, last, block)


def with_cells(frame: DataFrame, value: Column, side: str, op: str, places: Places, matched: Column | None, block: int = CELL_ROWS) -> DataFrame:
    """A copy of each row for every cell it belongs to, named by ``_<side>_l`` and ``_<side>_r``.

    ``matched`` tells which rows have a partner at all; the others are kept once, in a cell of their own. Without it rows that no
    cell can match are left out.
    """
    own, other = ("l", "r") if side == "l" else ("r", "l")
    rows = places.right_rows if side == "l" else places.left_rows
    placed = _with_branch(frame, value, places.trunk, places.branches)
    at = F.when(F.col("_branch") < 0, F.lit(0)).otherwise(F.col("_place") - 1 - 2 * FAN * F.col("_branch")).cast("int")
    placed = placed.withColumn("_span", F.get(F.col("_of_spans"), at)).drop("_of_spans")
    lowest, highest = (F.floor(n / block) for n in (F.col(f"_span.{own}_from"), F.col(f"_span.{own}_to") - 1))
    mine = (lowest + F.pmod(F.col("_deal"), highest - lowest + 1)).cast("long")
    visited = _visited(op if side == "l" else FLIPPED[op], F.col(f"_span.{other}_from"), F.col(f"_span.{other}_to"),
                       F.col("_place") % 2 == 1, rows, block)
    alone = F.array(F.lit(None).cast("bigint"))
    meets = F.coalesce(visited, F.array().cast("array<bigint>"))
    if matched is not None:
        meets = F.when(matched, meets).otherwise(alone)
    spread = placed.withColumn("_mine", mine).withColumn("_meets", F.explode(meets))
    single = F.col("_meets").isNull()
    # No cell has a negative number; rows without partner are dealt over all tasks.
    mark = -1 if side == "l" else -2
    named = {own: F.when(single, F.lit(mark)).otherwise(F.col("_mine")), other: F.when(single, F.col("_deal")).otherwise(F.col("_meets"))}
    return spread.withColumn(f"_{side}_l", named["l"].cast("long")).withColumn(f"_{side}_r", named["r"].cast("long")).drop(
        "_deal", "_branch", "_place", "_span", "_mine", "_meets")
