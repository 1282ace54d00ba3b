"""Keyed tables of which a commit writes only the rows of the keys it changes.

A table is cut into hash buckets of its key. A version is a folder of its own that holds, for each bucket it touches, a layer: the
rows that the changed keys have from now on, and a mark for each changed key. A manifest in the folder names the layers of
every bucket, most of them in folders of earlier versions. What a key has is what its newest layer says. A bucket whose layers
have outgrown its base is written anew by the commit that touches it next, and small buckets always are, so a change costs a constant number of rows
in the long run; a table that has outgrown its buckets gets twice as many. A pointer file names the current version and moves
when all is written, so a failed commit leaves the table as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.sources.versions import MARK, _files, _switch, current_version

MANIFEST = "_manifest"
BUCKET, LAYER, GONE = "_bucket", "_layer", "_gone"
#: A bucket with this many layers is written anew even if they are small.
MAX_LAYERS = 16
#: Bytes of a bucket, on the average, beyond which a table gets twice as many.
BUCKET_BYTES = 32 << 20
#: A bucket with no more bytes is written anew by every commit that touches it, which costs less than layers would.
SMALL_BYTES = 512 << 10


@dataclass(frozen=True)
class Manifest:
    """``layers``: for each bucket that has any, (version, bytes) of its base and of the layers after it."""
    name: str
    number: int
    parent: str | None
    key: list[str]
    buckets: int
    bucket_bytes: int
    small_bytes: int
    schema: str
    layers: dict[str, list[tuple[str, int]]]

    @property
    def fields(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


def _read_text(spark: SparkSession, path: str) -> str | None:
    _, target, fs = _files(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def manifest(spark: SparkSession, root: str, version: str | None = None) -> Manifest:
    """What the current version, or the one named, consists of."""
    name = version or current_version(spark, root)
    text = name and _read_text(spark, f"{root}/{name}/{MANIFEST}")
    if not text:
        raise ValueError(f"no version {name or ''} has been written to {root}")
    return Manifest(**json.loads(text))


def is_table(spark: SparkSession, root: str) -> bool:
    """Whether the current version at ``root`` is one of a bucketed table."""
    name = current_version(spark, root)
    return name is not None and _read_text(spark, f"{root}/{name}/{MANIFEST}") is not None


def _close(spark: SparkSession, root: str, done: Manifest) -> str:
    _, target, fs = _files(spark, f"{root}/{done.name}/{MANIFEST}")
    stream = fs.create(target, True)
    stream.write(bytearray(json.dumps(asdict(done)).encode()))
    stream.close()
    _, mark, fs = _files(spark, f"{root}/{done.name}/{MARK}")
    fs.create(mark, True).close()
    _switch(spark, root, done.name)
    return done.name


def _same(key: Sequence[str], other: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in key])


def _under(df: DataFrame, key: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{prefix}{k}") for k in key], *[c for c in df.columns if c not in key])


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _layers(spark: SparkSession, root: str, table: Manifest, places: Sequence[tuple[str, str]]) -> DataFrame:
    kept = StructType(table.fields.fields).add(LAYER, "long").add(GONE, "boolean")
    if not places:
        return spark.createDataFrame([], kept)
    return spark.read.schema(kept).parquet(*[f"{root}/{version}/{BUCKET}={bucket}" for bucket, version in places])


def _rows(spark: SparkSession, root: str, table: Manifest, buckets: set[str] | None = None) -> DataFrame:
    """The rows of some buckets, or all. Bases are read as they are, but for the keys that a later layer names."""
    wanted = {b: layers for b, layers in table.layers.items() if buckets is None or b in buckets}
    columns = table.fields.names
    plain = _layers(spark, root, table, [(b, held[0][0]) for b, held in wanted.items() if len(held) == 1])
    plain = plain.filter(~F.col(GONE)).select(*columns)
    piled = {b: held for b, held in wanted.items() if len(held) > 1}
    if not piled:
        return plain
    base = _layers(spark, root, table, [(b, held[0][0]) for b, held in piled.items()])
    later = _layers(spark, root, table, [(b, version) for b, held in piled.items() for version, _ in held[1:]])
    newest = _under(later.groupBy(*table.key).agg(F.max(LAYER).alias("_newest")), table.key, "_k_")
    same = _same(table.key, "_k_")
    old = base.filter(~F.col(GONE)).join(newest, same, "left_anti").select(*columns)
    new = later.join(newest, same & (F.col(LAYER) == F.col("_newest"))).filter(~F.col(GONE)).select(*columns)
    return plain.unionByName(old).unionByName(new)


def read(spark: SparkSession, root: str, version: str | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The current version, or the one named; with ``keys`` only the rows of those keys, from their buckets alone."""
    table = manifest(spark, root, version)
    if keys is None:
        return _rows(spark, root, table)
    return _of_keys(_rows(spark, root, table, _touched(keys, table)), keys, table)


def _touched(keys: DataFrame, table: Manifest) -> set[str]:
    if table.buckets == 1:
        return {"0"}
    return {str(r[0]) for r in keys.select(_bucket(table.key, table.buckets)).distinct().collect()}


def _of_keys(rows: DataFrame, keys: DataFrame, table: Manifest, how: str = "left_semi") -> DataFrame:
    return rows.join(_under(keys.select(*table.key).distinct(), table.key, "_k_"), _same(table.key, "_k_"), how)


def _write(rows: DataFrame, root: str, name: str, key: Sequence[str], buckets: int) -> dict[str, int]:
    """Rows in a folder for each bucket; a large bucket may be written by several tasks. Bytes by bucket come back."""
    spark = rows.sparkSession
    rows.withColumn(BUCKET, _bucket(key, buckets)).hint("rebalance", F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(
        f"{root}/{name}")
    _, folder, fs = _files(spark, f"{root}/{name}")
    found = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory()]
    return {p.getName().removeprefix(f"{BUCKET}="): int(fs.getContentSummary(p).getLength()) for p in found}


def _layered(rows: DataFrame, number: int, gone: bool = False) -> DataFrame:
    return rows.withColumn(LAYER, F.lit(number).cast("long")).withColumn(GONE, F.lit(gone))


def create(df: DataFrame, root: str, key: Sequence[str], buckets: int = 1, bucket_bytes: int = BUCKET_BYTES,
           small_bytes: int = SMALL_BYTES, label: str | None = None) -> str:
    """The first version of a table, or a new one with nothing taken from earlier ones. Keys may be null or repeated. A table that is
    too large for its buckets gets more by the next commit."""
    name = label or f"v-{uuid.uuid4().hex[:12]}"
    held = _write(_layered(df, 0), root, name, key, buckets)
    return _close(df.sparkSession, root, Manifest(
        name, 0, current_version(df.sparkSession, root), list(key), buckets, bucket_bytes, small_bytes, df.schema.json(),
        {b: [(name, n)] for b, n in held.items()}))


def commit(spark: SparkSession, root: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame], label: str | None = None,
           keep: int | None = None) -> str:
    """Next version: ``change`` gets the rows that the table has under ``keys`` and gives those that it has from now on.

    ``keys`` names every key whose rows change or that a new row stands under; repeats do no harm. Only their buckets are
    read, and only their rows are written, but for buckets that are due to be written anew: of those ``change`` gets all rows,
    and has to give back the rows of other keys as they are. A label that is current is left alone;
    one that was written on the current version, but then rolled back, only becomes current again.
    """
    table = manifest(spark, root)
    if label is not None and table.name == label:
        return label
    name = label or f"v-{uuid.uuid4().hex[:12]}"
    if label is not None and _read_text(spark, f"{root}/{label}/{MARK}") is not None:
        if manifest(spark, root, label).parent == table.name:
            _switch(spark, root, label)
            return label
        name = f"{label}-{uuid.uuid4().hex[:12]}"
    named = keys.select(*table.key).distinct()
    number, columns, buckets = table.number + 1, table.fields.names, table.buckets
    while sum(n for held in table.layers.values() for _, n in held) > buckets * table.bucket_bytes:
        buckets *= 2
    if buckets > table.buckets:
        touched, anew, old = set(), set(table.layers), {}
    else:
        touched, old = _touched(named, table), table.layers
        anew = {b for b in touched if _is_due(old.get(b, []), table.small_bytes)}
    base, piled = _rows(spark, root, table, anew), touched - anew
    if piled:
        base = base.unionByName(_of_keys(_rows(spark, root, table, piled), named, table))
    rows = _layered(change(base).select(*[F.col(c).cast(table.fields[c].dataType) for c in columns]), number)
    if piled:
        marks = named.filter(_bucket(table.key, buckets).isin(*map(int, piled))).select(
            *[F.col(k) if k in table.key else F.lit(None).cast(table.fields[k].dataType).alias(k) for k in columns])
        rows = rows.unionByName(_layered(marks, number, True))
    written = _write(rows, root, name, table.key, buckets)
    layers = {b: held for b, held in old.items() if b not in anew}
    for b, n in written.items():
        layers[b] = [*layers.get(b, []), (name, n)]
    done = _close(spark, root, Manifest(name, number, table.name, table.key, buckets, table.bucket_bytes, table.small_bytes,
                                        table.schema, layers))
    if keep is not None:
        drop_old(spark, root, keep)
    return done


def written(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(old, new) rows of what the current version has written: all keys that it changed, and unchanged ones beside them in buckets
    that were written anew. Reads the layers of this version and the same keys of the one before."""
    now = manifest(spark, root)
    was = manifest(spark, root, now.parent)
    if now.buckets != was.buckets:
        return _rows(spark, root, was), _rows(spark, root, now)
    changed = {b for b in {*now.layers, *was.layers} if now.layers.get(b) != was.layers.get(b)}
    anew = {b for b in changed if b not in now.layers or now.layers[b][0][0] == now.name}
    old, new = _rows(spark, root, was, anew), _rows(spark, root, now, anew)
    if piled := changed - anew:
        top = _layers(spark, root, now, [(b, now.name) for b in piled])
        old = old.unionByName(_of_keys(_rows(spark, root, was, piled), top.filter(GONE), now))
        new = new.unionByName(top.filter(~F.col(GONE)).select(*now.fields.names))
    return old, new


def _is_due(layers: list[tuple[str, int]], small: int) -> bool:
    """Whether a bucket is written anew: a small one always, others when what lies on the base has more rows or too many layers."""
    sizes = [n for _, n in layers]
    return sum(sizes) <= small or sum(sizes[1:]) > sizes[0] or len(sizes) >= MAX_LAYERS


def roll_back(spark: SparkSession, root: str, version: str) -> None:
    """An earlier version becomes the current one."""
    _switch(spark, root, manifest(spark, root, version).name)


def drop_old(spark: SparkSession, root: str, keep: int) -> None:
    """Forget all but the newest versions, two at least, and delete the layers that none of those needs."""
    kept, name = [], current_version(spark, root)
    while name is not None and len(kept) < max(keep, 2) and _read_text(spark, f"{root}/{name}/{MARK}") is not None:
        kept.append(manifest(spark, root, name))
        name = kept[-1].parent
    needed = {(version, b) for m in kept for b, held in m.layers.items() for version, _ in held}
    versions, names = {v for v, _ in needed}, {m.name for m in kept}
    jvm, folder, fs = _files(spark, root)
    child = jvm.org.apache.hadoop.fs.Path
    for status in fs.listStatus(folder):
        path, version = status.getPath(), status.getPath().getName()
        if not status.isDirectory() or version in names or not fs.exists(child(path, MANIFEST)):
            continue
        if version not in versions:
            fs.delete(path, True)
            continue
        for inner in fs.listStatus(path):
            bucket = inner.getPath().getName().removeprefix(f"{BUCKET}=")
            if inner.isDirectory() and (version, bucket) not in needed:
                fs.delete(inner.getPath(), True)
