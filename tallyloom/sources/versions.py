"""Append sinks and versioned parquet tables.

A versioned table is a folder of immutable snapshots plus a small pointer file. A
write goes to a snapshot folder of its own and only a finished write moves the pointer, so a
failed job leaves the old table as it was and nothing ever overwrites a path that it reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"
#: An empty file in each snapshot: only folders that have it are ever removed.
MARK = "_snapshot"


def append_rows(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """Add rows to a parquet folder."""
    writer = df.write.mode("append")
    parts = list(partition_by)
    if parts:
        writer = writer.partitionBy(*parts)
    writer.parquet(path)


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def is_folder(spark: SparkSession, path: str) -> bool:
    _, target, fs = _files(spark, path)
    return bool(fs.exists(target) and fs.getFileStatus(target).isDirectory())


def folder_bytes(spark: SparkSession, path: str) -> int:
    _, target, fs = _files(spark, path)
    return int(fs.getContentSummary(target).getLength()) if fs.exists(target) else 0


def entries(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder."""
    _, folder, fs = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that its caller made; one that is missing is no error."""
    _, target, fs = _files(spark, path)
    fs.delete(target, True)


def put_in_order(spark: SparkSession, path: str) -> None:
    """Give the files of a folder ages that follow their names, a second apart and in the past."""
    _, folder, fs = _files(spark, path)
    files = sorted((s for s in fs.listStatus(folder) if s.isFile() and not s.getPath().getName().startswith("_")), key=lambda s: s.getPath().getName())
    for back, status in enumerate(reversed(files), 1):
        fs.setTimes(status.getPath(), status.getModificationTime() - 1000 * back, -1)


def current_version(spark: SparkSession, root: str) -> str | None:
    """The snapshot the pointer names, or None for a table never written."""
    _, target, fs = _files(spark, f"{root}/{POINTER}")
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The current snapshot, or the one named."""
    name = version or current_version(spark, root)
    if name is None:
        raise ValueError(f"no version has been written to {root}")
    return spark.read.parquet(f"{root}/{name}")


def write_version(df: DataFrame, root: str, label: str | None = None, keep: int | None = None) -> str:
    """Replace the table: write a new snapshot, then switch the pointer to it.

    A label that is current already is left alone, which makes a replayed batch harmless. With ``keep`` only that many
    of the newest snapshots stay.
    """
    spark = df.sparkSession
    name = label or f"v-{uuid.uuid4().hex[:12]}"
    if label is not None and current_version(spark, root) == label:
        return name
    df.write.mode("overwrite").parquet(f"{root}/{name}")
    _, mark, fs = _files(spark, f"{root}/{name}/{MARK}")
    fs.create(mark, True).close()
    _switch(spark, root, name)
    if keep is not None:
        drop_old_versions(spark, root, keep)
    return name


def drop_old_versions(spark: SparkSession, root: str, keep: int) -> None:
    """Delete all but the newest snapshots of this table. The current one and folders of others always stay."""
    jvm, folder, fs = _files(spark, root)
    current = current_version(spark, root)
    found = [s for s in fs.listStatus(folder) if s.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), MARK))]
    newest = sorted(found, key=lambda s: (s.getPath().getName() == current, s.getModificationTime()), reverse=True)
    for old in newest[max(keep, 1):]:
        fs.delete(old.getPath(), True)


def _switch(spark: SparkSession, root: str, name: str) -> None:
    jvm, staged, fs = _files(spark, f"{root}/_next-{uuid.uuid4().hex[:12]}")
    stream = fs.create(staged, True)
    stream.write(bytearray(name.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(staged), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")), options)
