"""A structured query request turned into DataFrame calls.

A request names a base table, columns, custom expressions, joins, filters, aggregates, a sort and
a limit. Names are checked against the schema and literals are read as values that compare with their column before
anything runs; what is wrong raises ``RequestError``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators import pairing
from tallyloom.operators.ordering import HOT_ROWS, kept, prefix_scan

# The words a request is written in.
FILTER_OPS = ("=", "<", ">", ">=", "<=", "!=", "LIKE", "IN")
MEASURES = ("COUNT", "MIN", "MAX", "SUM", "FIRST", "LAST", "AVG", "CONCAT_WS")
DEFAULT_LIMIT = 100
#: Values that one task spells at a time on the way to a whole text.
PART_SIZE = 1000
#: Bytes that a text may have; Spark cannot hold a cell beyond two gigabytes.
CELL_BYTES = 1 << 30
#: Values of a group that one cell may collect; a larger group is spelled in parts.
GROUP_BYTES = 256 << 20


class RequestError(ValueError):
    pass


@dataclass(frozen=True)
class Filter:
    """A base column against a value, or against another base column."""

    column: str
    op: str
    value: str | None = None
    other: str | None = None


@dataclass(frozen=True)
class Join:
    """One more table. ``literal`` compares the base column with a value and leaves ``column`` out."""

    table: str
    how: str
    base_column: str
    op: str = "="
    column: str | None = None
    literal: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Measure:
    """An aggregate. FIRST and LAST need ``order_by``; CONCAT_WS takes a separator."""

    kind: str
    column: str = "*"
    order_by: str | None = None
    separator: str = ","

    @property
    def alias(self) -> str:
        return f"{self.kind.lower()}_{'all' if self.column == '*' else self.column}"


@dataclass(frozen=True)
class Request:
    table: str
    columns: tuple[str, ...] = ()
    expressions: tuple[tuple[str, str], ...] = ()
    joins: tuple[Join, ...] = ()
    filters: tuple[Filter, ...] = ()
    group_by: tuple[str, ...] = ()
    measures: tuple[Measure, ...] = ()
    order_by: tuple[str, ...] = ()
    limit: int = DEFAULT_LIMIT


def typed_literal(df: DataFrame, column: str, text: str) -> Column:
    """The text as a value that compares with the column; a text that is none raises."""
    return typed_literals(df, column, [text])[0]


def typed_literals(df: DataFrame, column: str, texts: list[str]) -> list[Column]:
    """The texts as values that compare with the column; a text that is none raises.

    A number keeps all its digits and a date its time of day, so nothing is rounded to the type of the column. Texts that Spark
    has to read are read together.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return [F.lit(t) for t in texts]
    if isinstance(kind, T.NumericType):
        return [_number(column, kind, t) for t in texts]
    name = "timestamp_ntz" if isinstance(kind, T.DateType) else kind.simpleString()
    read = df.sparkSession.sql(f"SELECT transform(:texts, t -> try_cast(t AS {name}) IS NOT NULL)",
                               args={"texts": F.array(*[F.lit(t) for t in texts])}).first()[0]
    for text, good in zip(texts, read):
        if not good:
            raise RequestError(f"{text!r} is not a {name}, as {column} needs")
    return [F.lit(t).cast(name) for t in texts]


def _number(column: str, kind: T.NumericType, text: str) -> Column:
    try:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.lit(float(text))
        value = Decimal(text)
        if not value.is_finite() or len(value.as_tuple().digits) > 38 or abs(value.adjusted()) > 37:
            raise InvalidOperation
        return F.lit(value)
    except (ValueError, InvalidOperation):
        raise RequestError(f"{text!r} is not a number, as {column} is") from None


def split_list(text: str) -> list[str]:
    return [v.strip() for v in text.split(",") if v.strip()]


def filter_column(df: DataFrame, alias: str, spec: Filter) -> Column | None:
    """The condition of one filter, or None when it has nothing to compare with."""
    _check(df, spec.column)
    if spec.op not in FILTER_OPS:
        raise RequestError(f"unknown operator {spec.op}")
    here = F.col(f"{alias}.{spec.column}")
    if spec.other:
        _check(df, spec.other)
        there = F.col(f"{alias}.{spec.other}")
        # Membership in one other column is equality with it.
        return pairing.compare("=" if spec.op == "IN" else spec.op, here, there)
    if spec.value is None or not spec.value.strip():
        return None
    value = spec.value.strip()
    if spec.op == "LIKE":
        return here.like(value)
    if spec.op == "IN":
        values = split_list(value)
        return here.isin(*typed_literals(df, spec.column, values)) if values else None
    return pairing.compare(spec.op, here, typed_literal(df, spec.column, value))


def _check(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise RequestError(f"no column {name}; there are {', '.join(df.columns)}")


def run_request(request: Request, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The rows a request asks for."""
    if request.table not in tables:
        raise RequestError(f"no table {request.table}")
    base = tables[request.table]
    frame = base.alias(request.table)
    shown = [(request.table, base.columns)]
    for step in request.joins:
        frame, added = _join(frame, base, request.table, step, tables)
        if added:
            shown.append(added)
    conditions = [c for f in request.filters if (c := filter_column(base, request.table, f)) is not None]
    if conditions:
        frame = frame.filter(reduce(lambda a, b: a & b, conditions))
    if request.group_by or request.measures:
        out = _aggregate(frame, base, request)
        if request.order_by:
            out = out.orderBy(*[_sort_key(out, text) for text in request.order_by])
    else:
        out = _projected(frame, base, request, shown)
    return out.limit(request.limit) if request.limit and request.limit > 0 else out


def _projected(frame: DataFrame, base: DataFrame, request: Request, shown) -> DataFrame:
    """The chosen columns in order. A sort column of the base that was not chosen is carried along for the sort only."""
    picked = _projection(base, request, shown)
    out = frame.select(*picked)
    if not request.order_by:
        return out
    names, hidden, keys = out.columns, [], []
    for k, text in enumerate(request.order_by):
        name, _, way = text.partition(" ")
        if name not in names:
            _check(base, name)
            hidden.append(F.col(f"{request.table}.{name}").alias(f"_sort_{k}"))
            text = f"_sort_{k} {way}"
        keys.append(text)
    wide = frame.select(*picked, *hidden)
    return wide.orderBy(*[_sort_key(wide, text) for text in keys]).drop(*[f"_sort_{k}" for k in range(len(keys))])


def _join(frame: DataFrame, base: DataFrame, base_alias: str, step: Join, tables: Mapping[str, DataFrame]):
    if step.table not in tables:
        raise RequestError(f"no table {step.table}")
    if step.how not in pairing.JOIN_TYPES:
        raise RequestError(f"unknown join {step.how}")
    _check(base, step.base_column)
    how = pairing.JOIN_TYPES[step.how]
    alias = step.alias or step.table
    other = tables[step.table]
    right = other.alias(alias)
    if step.literal is not None:
        here = F.col(f"{base_alias}.{step.base_column}")
        if step.op == "LIKE":
            test = here.like(step.literal)
        else:
            test = pairing.compare(step.op, here, typed_literal(base, step.base_column, step.literal))
        return pairing.literal_join(frame, right, test, how), (alias, other.columns)
    if step.column is None:
        raise RequestError("a join needs a column of the joined table or a literal")
    _check(other, step.column)
    left_side = pairing.Side(frame, base_alias, step.base_column)
    right_side = pairing.Side(right, alias, step.column)
    if step.op == "IN":
        if how != "inner":
            raise RequestError("membership is an inner join")
        # Distinct first: a value that fills the right side would end up in one task of the semi-join.
        listed = other.select(F.col(step.column).alias("_listed")).distinct()
        return frame.join(listed, left_side.value == F.col("_listed"), "left_semi"), None
    if step.op == "LIKE":
        return pairing.pattern_join(left_side, right_side, how), (alias, other.columns)
    if step.op not in pairing.COMPARE:
        raise RequestError(f"unknown operator {step.op}")
    return pairing.comparison_join(left_side, right_side, step.op, how), (alias, other.columns)


def _projection(base: DataFrame, request: Request, shown) -> list[Column]:
    if request.columns:
        _check(base, *request.columns)
        picked = [F.col(f"{request.table}.{c}") for c in request.columns]
    else:
        picked, seen = [], set()
        for alias, columns in shown:
            for c in columns:
                name = c if c not in seen else f"{alias}_{c}"
                seen.add(name)
                picked.append(F.col(f"{alias}.{c}").alias(name))
    return picked + [F.expr(text).alias(alias) for alias, text in request.expressions]


def _sort_key(out: DataFrame, text: str) -> Column:
    name, _, way = text.partition(" ")
    _check(out, name)
    return F.col(name).desc() if way.strip().upper() == "DESC" else F.col(name).asc()


def _measure(measure: Measure, base: DataFrame, alias: str) -> Column:
    if measure.column == "*":
        if measure.kind != "COUNT":
            raise RequestError(f"{measure.kind} needs a column")
        return F.count(F.lit(1))
    _check(base, measure.column)
    value = F.col(f"{alias}.{measure.column}")
    if measure.kind in ("FIRST", "LAST"):
        if not measure.order_by:
            raise RequestError(f"{measure.kind} needs an order column: rows of a table have no order")
        _check(base, measure.order_by)
        at = F.when(value.isNotNull(), F.col(f"{alias}.{measure.order_by}"))
        return F.min_by(value, at) if measure.kind == "FIRST" else F.max_by(value, at)
    plain = {"COUNT": F.count, "MIN": F.min, "MAX": F.max, "SUM": F.sum, "AVG": F.avg}
    return plain[measure.kind](value)


def _aggregate(frame: DataFrame, base: DataFrame, request: Request) -> DataFrame:
    """One row per group: its columns, the figures, the expressions (of grouped columns or with aggregates of their own)
    and the texts, of which there may be any number."""
    keys = list(dict.fromkeys(request.group_by))
    _check(base, *keys)
    for m in request.measures:
        if m.kind not in MEASURES:
            raise RequestError(f"unknown aggregate {m.kind}")
    for c in request.columns:
        if c not in keys:
            raise RequestError(f"column {c} is neither grouped nor aggregated")
    names = [*keys, *(m.alias for m in request.measures), *(name for name, _ in request.expressions)]
    if len(set(names)) < len(names):
        raise RequestError("two results of one name")
    groups = [F.col(f"{request.table}.{k}").alias(k) for k in keys]
    plain = [_measure(m, base, request.table).alias(m.alias) for m in request.measures if m.kind != "CONCAT_WS"]
    texts = [m for m in request.measures if m.kind == "CONCAT_WS"]
    _check(base, *[m.column for m in texts])
    values = {m.alias: F.col(f"{request.table}.{m.column}").cast("string") for m in texts}
    try:
        plain += [F.expr(text).alias(name) for name, text in request.expressions]
        if not texts:
            return frame.groupBy(*groups).agg(*plain) if plain else frame.select(*groups).distinct()
        hot = _hot_groups(frame, groups, list(values.values()))
        whole = [_text(values[m.alias], m.separator).alias(m.alias) for m in texts]
        if hot is None:
            return frame.groupBy(*groups).agg(*plain, *whole)
        same = reduce(lambda a, b: a & b, [F.col(f"{request.table}.{k}").eqNullSafe(F.col(f"_hot_{k}")) for k in keys], F.lit(True))
        large = frame.join(hot, same, "left_semi") if keys else frame
        out = large.groupBy(*groups).agg(*plain) if plain else large.select(*groups).distinct() if keys else None
        for m in texts:
            out = _beside(out, concat_texts(large.select(*groups, values[m.alias].alias(m.alias)), keys, m.alias, m.separator), keys, m.alias)
        if not keys:
            return out
        rest = frame.join(hot, same, "left_anti").groupBy(*groups).agg(*plain, *whole)
        return rest.unionByName(out)
    except (AnalysisException, ParseException) as error:
        raise RequestError(f"an expression is neither grouped nor aggregated, or is no expression: {error}") from error


def _text(value: Column, separator: str) -> Column:
    """The values of a group of ordinary size in order, joined to one text; null for no value."""
    return F.when(F.count(value) > 0, F.array_join(F.array_sort(F.collect_list(value)), separator))


def _hot_groups(frame: DataFrame, groups: list[Column], values: list[Column]) -> DataFrame | None:
    """Groups whose values one cell should not collect, as a table in the shared folder, or None. Counted with map-side sums."""
    size = reduce(lambda a, b: F.greatest(a, b), [F.lit(0), *[F.sum(F.octet_length(v).cast("long")) for v in values]])
    counts = frame.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"), size.alias("_bytes"))
    found = counts.filter((F.col("_rows") > HOT_ROWS) | (F.col("_bytes") > GROUP_BYTES))
    if found.isEmpty():
        return None
    names = [c for c in found.columns if c not in ("_rows", "_bytes")]
    return kept(found.select(*[F.col(c).alias(f"_hot_{c}") for c in names]), "hot-groups") if names else found


def _beside(out: DataFrame | None, texts: DataFrame, keys: list[str], name: str) -> DataFrame:
    if out is None:
        return texts
    if not keys:
        return out.withColumn(name, texts.scalar())
    named = texts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], name)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return out.join(named, same, "left").drop(*[f"_k_{k}" for k in keys])


def concat_texts(df: DataFrame, keys: list[str], value: str, separator: str = ",", part_size: int = PART_SIZE,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """The values of each group in order, joined to one text; null for no value. Without keys there is one row.

    Tasks spell parts in parallel, and only the parts are put in order within a group. A text that no cell can hold
    raises an error that says so.
    """
    parts = concat_parts(df, keys, value, separator, part_size, hot_rows)
    in_order = F.array_sort(F.collect_list(F.struct("part", F.col(value).alias("t"))))
    whole = F.array_join(F.transform(in_order, lambda p: p["t"]), separator)
    size = F.coalesce(F.sum(F.octet_length(value).cast("long")), F.lit(0))
    too_long = F.raise_error(F.lit(f"a text of {value} is beyond {CELL_BYTES} bytes; ask for concat_parts")).cast("string")
    return parts.groupBy(*keys).agg(F.when(size > CELL_BYTES, too_long).when(F.count(F.lit(1)) > 0, whole).alias(value))


def concat_parts(df: DataFrame, keys: list[str], value: str, separator: str = ",", part_size: int = PART_SIZE,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """The values of each group in order, joined to texts of at most ``part_size`` values each.

    An ordinary group is one row with part 0. A larger group goes on in part 1, 2, ...; the parts laid end to end
    with the separator are the whole text, so no cell and no task has to hold a group of any size. Equal
    values are counted before they are moved.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("string").alias(value))
        .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_times"))
    )
    placed = prefix_scan(counted, keys, [value], sums={"_end": F.col("_times")}, hot_rows=hot_rows, sized=df)
    size = F.lit(part_size)
    start = F.col("_end") - F.col("_times")
    first_part = F.floor(start / size).cast("long")
    last_part = F.floor((F.col("_end") - 1) / size).cast("long")
    split = placed.withColumn("_start", start).withColumn("part", F.explode(F.sequence(first_part, last_part)))
    inside = (
        F.least(F.col("_end"), (F.col("part") + 1) * size) - F.greatest(F.col("_start"), F.col("part") * size)
    ).cast("int")
    items = F.collect_list(F.struct(F.col(value).alias("v"), inside.alias("n")))
    spelled = F.flatten(F.transform(F.array_sort(items), lambda item: F.array_repeat(item["v"], item["n"])))
    return split.groupBy(*keys, "part").agg(F.array_join(spelled, separator).alias(value))
