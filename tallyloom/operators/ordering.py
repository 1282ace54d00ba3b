"""Ordered work that stays parallel when one key holds much of the data.

A window puts a whole key into one task. For the few keys too large for that, the rows of a
key are cut into ranges of the order column; each range is worked on by itself and what comes before
it arrives as one summary row. Range bounds only decide who works on what: the results do not depend on them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import work_path

HOT_ROWS = 2_000_000
RANGE_ROWS = 500_000
#: Sampled rows for each range.
PICKED = 100
#: What one side of a broadcast join may measure.
SMALL_BYTES = 32 << 20


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more rows than one task should hold, as a table in the shared folder, or None."""
    counts = df.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*keys)
    return None if counts.isEmpty() else kept(counts, "hot-keys")


def kept(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table: sampling and counting are done once, and its size tells Spark how to join it."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS,
              sized: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys or None).

    ``sized`` is a frame that is cheap to read and has at least as many rows for each key; it is counted instead.
    """
    hot = hot_keys(df if sized is None else sized, keys, hot_rows)
    if hot is None:
        return df, None
    named = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    return df.join(named, same, "left_anti"), df.join(named, same, "left_semi")


def _rank_in(point: Column, cuts: Column) -> Column:
    """Number of cut points at or below a point, by halving an array of the row."""
    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        right = (at["low"] < at["high"]) & F.coalesce(F.get(cuts, middle) <= point, F.lit(False))
        return F.struct(F.when(right, middle + 1).otherwise(at["low"]).alias("low"),
                        F.when(right | (at["low"] == at["high"]), at["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(cuts).cast("long"))))
    start = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))
    return F.aggregate(steps, start, halve, lambda at: at["low"])


def with_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``: each key is cut at points of its own, taken from a sample over all order columns.

    A range has about ``RANGE_ROWS`` rows, so there are the more of them the more rows a key has; tests ask for a number
    of ranges instead. Nulls come first, as in a window.
    """
    point = F.struct(*[F.col(c) for c in order])
    share = min(1.0, PICKED / RANGE_ROWS if ranges is None else 1.5 * PICKED * ranges / max(df.count(), 1))
    picked = df.select(*keys, point.alias("_point")).sample(False, share, 11).groupBy(*keys).agg(
        F.sort_array(F.collect_list("_point")).alias("_sorted"))
    step = F.lit(PICKED) if ranges is None else F.greatest(F.floor(F.size("_sorted") / ranges).cast("int"), F.lit(1))
    each = F.filter("_sorted", lambda _, i: i % step == step - 1)
    cuts = kept(picked.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.array_distinct(each).alias("_cuts")), "cuts")
    if keys:
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys])
        cut = df.join(cuts, same, "left")
    else:
        cut = df.withColumn("_cuts", cuts.select("_cuts").scalar())
    return cut.withColumn("_range", F.when(F.size("_cuts") > 0, _rank_in(point, F.col("_cuts"))).otherwise(F.lit(0))).select(
        *[F.col(c) for c in df.columns], "_range")


def prefix_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None,
                maxes: Mapping[str, Column] | None = None, hot_rows: int = HOT_ROWS, ranges: int | None = None,
                sized: DataFrame | None = None) -> DataFrame:
    """Running sums and running maxima along ``order`` inside each key, the row itself included.

    ``order`` must be unique inside a key. Without keys the whole table is one sequence.
    """
    if not keys:
        return scan_ranges(df, keys, order, sums, maxes, ranges=ranges)
    cold, hot = split_hot(df, keys, hot_rows, sized)
    plain = scan_keys(cold, keys, order, sums, maxes)
    return plain if hot is None else plain.unionByName(scan_ranges(hot, keys, order, sums, maxes, ranges=ranges))


def _so_far(keys: Sequence[str], order: Sequence[str], inclusive: bool):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def scan_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None,
              maxes: Mapping[str, Column] | None = None, inclusive: bool = True) -> DataFrame:
    """The scan with one window per key, for keys of ordinary size."""
    line = _so_far(keys, order, inclusive)
    return df.select("*", *[F.coalesce(F.sum(c).over(line), F.lit(0)).alias(n) for n, c in (sums or {}).items()],
                     *[F.max(c).over(line).alias(n) for n, c in (maxes or {}).items()])


def scan_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None,
                maxes: Mapping[str, Column] | None = None, inclusive: bool = True, ranges: int | None = None) -> DataFrame:
    """The scan with each key cut into ranges, for keys of any size."""
    sums, maxes = dict(sums or {}), dict(maxes or {})
    cut = with_ranges(df, keys, order, ranges)
    totals = cut.groupBy(*keys, "_range").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_max_{n}") for n, c in maxes.items()],
    )
    # One row per key and range.
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_k_range"),
        *[F.sum(f"_sum_{n}").over(before).alias(f"_sum_{n}") for n in sums],
        *[F.max(f"_max_{n}").over(before).alias(f"_max_{n}") for n in maxes],
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
                  F.col("_range") == F.col("_k_range"))
    joined = cut.join(heads, same)
    line = _so_far([*keys, "_range"], order, inclusive)
    zero = F.lit(0)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.coalesce(F.col(f"_sum_{n}"), zero) + F.coalesce(F.sum(c).over(line), zero)).alias(n) for n, c in sums.items()],
        *[F.greatest(F.col(f"_max_{n}"), F.max(c).over(line)).alias(n) for n, c in maxes.items()],
    )


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position",
                hot_rows: int = HOT_ROWS, ranges: int | None = None) -> DataFrame:
    """Positions 1, 2, 3 ... inside each key, or over the whole table when there are no keys."""
    return prefix_scan(df, keys, order, sums={name: F.lit(1).cast("long")}, hot_rows=hot_rows, ranges=ranges)


def page(df: DataFrame, order: Sequence[str], offset: int, limit: int, near: int = 100_000,
         ranges: int | None = None) -> DataFrame:
    """Rows offset+1 .. offset+limit of the ordered table.

    A page near the top is a top-k. A deep one is found by position, so no task sorts all that lies before it.
    """
    if offset + limit <= near:
        return df.orderBy(*order).offset(offset).limit(limit)
    placed = number_rows(df, [], order, "_position", ranges=ranges)
    inside = (F.col("_position") > offset) & (F.col("_position") <= offset + limit)
    return placed.filter(inside).orderBy("_position").drop("_position")


def first_and_last(value: str, order: str) -> tuple[Column, Column]:
    """First and last non-null value along a unique order column."""
    at = F.when(F.col(value).isNotNull(), F.col(order))
    return F.min_by(F.col(value), at), F.max_by(F.col(value), at)


def is_small(df: DataFrame, rows: int = 50_000, size: int = SMALL_BYTES) -> bool:
    """Whether the frame has at most ``rows`` rows and ``size`` bytes, measured; reads no more than one row beyond that."""
    width = F.octet_length(F.to_json(F.struct("*")))
    found = df.toDF(*[f"c{k}" for k in range(len(df.columns))]).limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()
    return found["n"] <= rows and found["b"] <= size
