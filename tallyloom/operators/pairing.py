"""Joins on a comparison between columns, and on a comparison with a literal.

A comparison join is run against a broadcast side only when its rows and bytes have been measured and
are few. Beyond that both sides are dealt into cells (``operators/cells.py``) that can hold partners, so the work follows the size
of the answer and no task sees a whole side.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.cells import CELL_ROWS, FLIPPED, lay_out, with_cells
from tallyloom.operators.ordering import is_small, kept

COMPARE = {
    "=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
}
JOIN_TYPES = {
    "INNER JOIN": "inner", "LEFT JOIN": "left", "RIGHT JOIN": "right", "FULL OUTER JOIN": "full",
    "inner": "inner", "left": "left", "right": "right", "full": "full",
}
SMALL_ROWS = 50_000
BLOCK_ROWS = 20_000


@dataclass(frozen=True)
class Side:
    """An aliased frame and the column of it that takes part in the comparison."""

    frame: DataFrame
    alias: str
    column: str

    @property
    def value(self) -> Column:
        return F.col(f"{self.alias}.{self.column}")


def compare(op: str, left: Column, right: Column) -> Column:
    return F.like(left, right) if op == "LIKE" else COMPARE[op](left, right)


def comparison_join(left: Side, right: Side, op: str, how: str, small_rows: int = SMALL_ROWS,
                    ranges: int | None = None) -> DataFrame:
    """Join of two aliased frames on ``left.column op right.column``."""
    test = compare(op, left.value, right.value)
    if op == "=":
        return left.frame.join(right.frame, test, how)
    if is_small(right.frame, small_rows):
        return left.frame.join(F.broadcast(right.frame), test, how)
    if is_small(left.frame, small_rows):
        return F.broadcast(left.frame).join(right.frame, test, how)
    return _join_in_cells(left, right, op, how, ranges)


def _join_in_cells(left: Side, right: Side, op: str, how: str, ranges: int | None = None) -> DataFrame:
    kind = left.frame.select(left.value.alias("v")).union(right.frame.select(right.value)).schema["v"].dataType
    values = left.value.cast(kind), right.value.cast(kind)
    places = lay_out(left.frame, values[0], right.frame, values[1], ranges)
    block = CELL_ROWS if ranges is None else max(1, places.right_rows // ranges)
    has_left = _has_partner(values[0], right.frame, values[1], op) if how in ("left", "full") else None
    has_right = _has_partner(values[1], left.frame, values[0], FLIPPED[op]) if how in ("right", "full") else None
    spread = with_cells(left.frame, values[0], "l", op, places, has_left, block)
    dealt = with_cells(right.frame, values[1], "r", op, places, has_right, block)
    together = (F.col("_l_l") == F.col("_r_l")) & (F.col("_l_r") == F.col("_r_r")) & compare(op, left.value, right.value)
    joined = spread.join(dealt, together, how)
    if how != "inner":
        # A row is in many cells; those where it finds nobody count only if it has no partner at all.
        joined = joined.filter((F.col("_l_l").isNotNull() & F.col("_r_l").isNotNull()) | (F.col("_l_l") == -1) | (F.col("_r_r") == -2))
    return joined.drop("_l_l", "_l_r", "_r_l", "_r_r")


def _has_partner(value: Column, others: DataFrame, other: Column, op: str) -> Column:
    """Whether a row meets any row of the other side: the extremes of that side tell. Both values have one type."""
    low, high = others.agg(F.min(other), F.max(other)).first()
    if low is None:
        return F.lit(False)
    if op in ("<", "<="):
        test = compare(op, value, F.lit(high))
    elif op in (">", ">="):
        test = compare(op, value, F.lit(low))
    else:
        test = (value != F.lit(low)) | (value != F.lit(high))
    return F.coalesce(test, F.lit(False))


def pattern_join(left: Side, right: Side, how: str, small_rows: int = SMALL_ROWS, ranges: int | None = None) -> DataFrame:
    """Join on ``left.column LIKE right.column``, whatever the sizes.

    With two large sides the distinct texts and patterns are matched first, by the rarest piece of each pattern; the rows then
    follow by equality.
    """
    test = F.like(left.value, right.value)
    if is_small(right.frame, small_rows):
        return left.frame.join(F.broadcast(right.frame), test, how)
    if is_small(left.frame, small_rows):
        return F.broadcast(left.frame).join(right.frame, test, how)
    matches = like_matches(left.frame.select(left.value.alias("_text")), right.frame.select(right.value.alias("_pattern")), ranges)
    if how == "inner":
        return left.frame.join(matches, left.value == F.col("_text")).join(right.frame, F.col("_pattern") == right.value)
    if how == "left":
        with_partner = left.frame.join(matches, left.value == F.col("_text"), "left")
        return with_partner.join(right.frame, F.col("_pattern") == right.value, "left")
    with_partner = right.frame.join(matches, F.col("_pattern") == right.value, "left")
    if how == "right":
        return left.frame.join(with_partner, left.value == F.col("_text"), "right")
    return left.frame.join(with_partner, left.value == F.col("_text"), "full")


# What stands for an escaped sign while a pattern is cut at its wildcards, and for the two ends of a text.
ESCAPED = {"\\\\": "\ue000", "\\%": "\ue001", "\\_": "\ue002"}
START, END = "\x02", "\x03"
#: Signs of a piece; a literal with fewer gives a shorter one.
PIECE = 4


def _ends(value: Column) -> Column:
    return F.concat(F.lit(START), value, F.lit(END))


def _pieces(text: Column, size: Column) -> Column:
    """All pieces of a text that have a length."""
    last = F.char_length(text) - size + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda at: F.substring(text, at, size))).otherwise(
        F.array().cast("array<string>"))


def _literal_pieces(pattern: Column) -> Column:
    """The pieces of everything between the wildcards of a pattern; a text that matches has each of them."""
    plain = pattern
    for sign, stand_in in ESCAPED.items():
        plain = F.replace(plain, F.lit(sign), F.lit(stand_in))
    runs = F.transform(F.split(_ends(plain), "[%_]"), lambda r: F.translate(r, "".join(ESCAPED.values()), "\\%_"))
    told = F.filter(runs, lambda r: ~r.isin("", START, END))
    return F.flatten(F.transform(told, lambda r: _pieces(r, F.least(F.char_length(r), F.lit(PIECE)))))


def like_candidates(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``_text, _pattern``: for each pattern the texts that have its rarest piece, each pair once. Patterns without any literal
    are left out.

    The texts give up their pieces as (digest, piece) and only those that some pattern chose go on, so what is compared follows
    the number of texts with the rarest piece, and a text moves once for each pattern it is compared with.
    """
    spelled = patterns.select("_pattern", F.explode(F.array_distinct(_literal_pieces(F.col("_pattern")))).alias("piece"))
    wanted = kept(spelled.groupBy("piece").agg(F.min(F.char_length("piece")).alias("size")), "pattern-pieces")
    sizes = [r[0] for r in wanted.select("size").distinct().collect()]  # 1 to PIECE
    keyed = texts.select(F.unhex(F.md5("_text")).alias("digest"), "_text")
    each = F.flatten(F.array(*[_pieces(_ends(F.col("_text")), F.lit(n)) for n in sizes])) if sizes else F.array().cast("array<string>")
    held = kept(keyed.select("digest", F.explode(F.array_distinct(each)).alias("p")).join(wanted, F.col("p") == F.col("piece")).select(
        "digest", "piece"), "text-pieces")
    counts = held.groupBy(F.col("piece").alias("counted")).count()
    rarest = spelled.join(counts, F.col("piece") == F.col("counted"), "left").groupBy("_pattern").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "piece")).alias("rarest")).filter("rarest.n > 0").select(
            "_pattern", F.col("rarest.piece").alias("chosen"))
    pairs = held.join(rarest, F.col("piece") == F.col("chosen")).select(F.col("digest").alias("d"), "_pattern")
    return pairs.join(keyed, F.col("d") == F.col("digest")).select("_text", "_pattern")


def like_matches(texts: DataFrame, patterns: DataFrame, ranges: int | None = None) -> DataFrame:
    """The distinct (``_text``, ``_pattern``) with ``_text LIKE _pattern``. Only patterns of nothing but wildcards, or with a sign that
    stands for an escaped one here, meet all texts, in ranges."""
    texts, patterns = (df.filter(F.col(c).isNotNull()).distinct() for df, c in ((texts, "_text"), (patterns, "_pattern")))
    odd = F.col("_pattern").rlike(f"[{''.join(ESCAPED.values())}]") | (F.size(_literal_pieces(F.col("_pattern"))) == 0)
    found = like_candidates(texts, patterns.filter(~odd)).filter(F.like("_text", F.col("_pattern")))
    bare = kept(patterns.filter(odd), "bare-patterns")
    if bare.isEmpty():
        return found
    left, right = Side(texts.alias("_texts"), "_texts", "_text"), Side(bare.alias("_patterns"), "_patterns", "_pattern")
    if is_small(bare):
        return found.unionByName(left.frame.join(F.broadcast(right.frame), F.like(left.value, right.value)))
    return found.unionByName(_join_in_cells(left, right, "LIKE", "inner", ranges).select("_text", "_pattern"))


def literal_join(left: DataFrame, right: DataFrame, test: Column, how: str, small_rows: int = SMALL_ROWS,
                 blocks: int | None = None) -> DataFrame:
    """ON names a left column and a literal only, so a left row that passes meets every right row.

    The answer has that many rows by definition. The right side is broadcast when measured small; else it is
    dealt by hash into blocks, the more the larger it is, and every passing left row visits each block.
    """
    passing = F.coalesce(test, F.lit(False))
    if is_small(right, small_rows):
        marked = F.broadcast(right.withColumn("_place", F.lit(0)))
        return left.withColumn("_visit", F.when(passing, 0)).join(marked, F.col("_visit") == F.col("_place"), how)
    blocks = blocks or max(64, right.count() // BLOCK_ROWS)
    dealt = right.withColumn("_place", F.pmod(F.xxhash64(*[F.col(c) for c in right.columns]), F.lit(blocks)).cast("int"))
    visits = F.when(passing, F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(F.array(F.lit(None).cast("int")))
    joined = left.withColumn("_visit", F.explode(visits)).join(dealt, F.col("_visit") == F.col("_place"), how)
    if how in ("left", "full"):
        # The right side has rows, so a left row that passes always finds some.
        joined = joined.filter(F.col("_place").isNotNull() | F.col("_visit").isNull())
    return joined
