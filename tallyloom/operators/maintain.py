"""Table maintenance: a table and its changes in, the next state of the table out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordering import number_rows
from tallyloom.sources import buckets, versions


class DuplicateChange(ValueError):
    pass


def require_unique(changes: DataFrame, key: str) -> None:
    """One change per key; more than one has no defined outcome."""
    twice = changes.groupBy(key).count().filter(F.col("count") > 1).head(1)
    if twice:
        raise DuplicateChange(f"{key} {twice[0][0]!r} has {twice[0][1]} changes")


def insert(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows added; a key may occur twice. Columns that are not given are null."""
    return base.unionByName(rows, allowMissingColumns=True).select(*base.columns)


def assign_keys(base: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The batch with keys that follow the highest key of the table, in the order of the batch."""
    top = base.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    kind = base.schema[key].dataType
    placed = number_rows(batch, [], order, "_position")
    return placed.withColumn(key, (top + F.col("_position")).cast(kind)).drop("_position")


def insert_keyed(base: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return insert(base, assign_keys(base, batch, key, order).select(
        *[c for c in base.columns if c in batch.columns or c == key]))


def update(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of ``changes`` set where the key occurs; a null in a change sets null, a missing key changes nothing."""
    require_unique(changes, key)
    named = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key])
    joined = base.join(named, F.col(key) == F.col("_key"), "left")
    changed = F.col("_key").isNotNull()
    return joined.select(*[
        F.when(changed, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c)
        for c in base.columns
    ])


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed are gone; a missing key is no error."""
    listed = keys.select(F.col(key).alias("_key")).distinct()
    return base.join(listed, F.col(key) == F.col("_key"), "left_anti")


def replace(base: DataFrame, changes: DataFrame, key: str, old_key: str = "old_key") -> DataFrame:
    """Rows under the old keys are taken out and the new rows put in, also when the old key was missing."""
    rest = delete(base, changes.select(F.col(old_key).alias(key)), key)
    return insert(rest, changes.drop(old_key))


def apply_changes(base: DataFrame, changes: DataFrame, key: str, op: str = "op", seq: str = "seq",
                  old_key: str = "old_key") -> DataFrame:
    """A sequence of inserts, updates, replacements and deletions, as if done one after the other.

    ``old_key`` is the key a change is about. The outcome for a key follows from three figures: the last deletion,
    the last update and its place. They are aggregates, so a key with very many changes is reduced before it moves.
    An update may change the key; later changes in the same set still name the old one.
    """
    columns = base.columns
    kind = base.schema[key].dataType
    about = F.col(old_key).cast(kind)
    row = F.struct(*[F.col(c) for c in columns])
    gone = F.col(op).isin("delete", "replace")
    changed = F.col(op) == "update"
    per_key = changes.groupBy(about.alias("_key")).agg(
        F.max(F.when(gone, F.col(seq))).alias("_cut"),
        F.max(F.when(changed, F.col(seq))).alias("_set_at"),
        F.max_by(row, F.when(changed, F.col(seq))).alias("_set"),
    )
    # The new row of a replacement stands under its own key from that moment on.
    added = changes.filter(F.col(op).isin("insert", "replace")).select(
        *columns, F.col(key).alias("_own"), F.col(seq).cast("long").alias("_seq"))
    there = base.select(*columns, F.col(key).alias("_own"), F.lit(None).cast("long").alias("_seq"))
    joined = there.unionByName(added).join(per_key, F.col("_own") == F.col("_key"), "left")
    since = F.coalesce(F.col("_seq"), F.lit(-(2**62)))
    alive = joined.filter(F.col("_cut").isNull() | (since >= F.col("_cut")))
    newer = F.coalesce(F.col("_set_at") > since, F.lit(False))
    return alive.select(*[F.when(newer, F.col(f"_set.{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def commit(spark, root: str, change: Callable[[DataFrame], DataFrame], label: str | None = None,
           keep: int | None = None) -> str:
    """Next version of a table; an error on the way leaves the current version in place."""
    if label is not None and versions.current_version(spark, root) == label:
        return label
    return versions.write_version(change(versions.read_version(spark, root)), root, label, keep)


def commit_changes(spark, root: str, changes: DataFrame, key: str, label: str | None = None, keep: int | None = None,
                   old_key: str = "old_key") -> str:
    """Next version of a bucketed table after a change set (see ``apply_changes``). Only the buckets of the keys it names, the old
    ones and those of its rows, are read, and only the rows of those keys are written."""
    kind = buckets.manifest(spark, root).fields[key].dataType
    named = changes.select(F.col(old_key).cast(kind).alias(key)).unionByName(changes.select(F.col(key).cast(kind).alias(key)))
    return buckets.commit(spark, root, named, lambda base: apply_changes(base, changes, key, old_key=old_key), label, keep)
