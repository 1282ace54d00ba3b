"""Reading tables as streams and running a stream over all that is there.

Checkpoints and sinks live under the shared folder. The number of state partitions is fixed at the first run of a
stream, so it is taken from the size of the input rather than from a default.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tallyloom.session import work_path
from tallyloom.sources import buckets
from tallyloom.sources.versions import folder_bytes, is_folder

STATE_BYTES = 64 * 1024 * 1024
BYTES_PER_TRIGGER = 1 << 30
#: Versions that stay of a table between batches: the current one, and the one that a batch run again starts from.
KEPT = 2


def stream_table(spark: SparkSession, path: str, schema: StructType | None = None,
                 bytes_per_trigger: int = BYTES_PER_TRIGGER, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table, one file or a folder of files, as a stream.

    A batch takes files up to a size, or a set number of them.
    """
    kind = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(kind)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    if is_folder(spark, path):
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def state_partitions(spark: SparkSession, path: str) -> int:
    """One partition for each 64 MB of input, no fewer than the cores at hand and no more than the session allows."""
    wanted = -(-folder_bytes(spark, path) // STATE_BYTES)
    allowed = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(allowed, max(wanted, spark.sparkContext.defaultParallelism)))


def kept_beside(spark: SparkSession, name: str, checkpoint: str | None, sink: str | None, label: str, state: str, key: list[str],
                rows: str) -> tuple[str, str]:
    """(table, sink) of a stream that keeps rows for each key between batches: a bucketed table beside its checkpoint, and a folder
    with one folder of rows a batch. Both are there before the first batch, so that a stream without any reads as empty."""
    table = f"{checkpoint}-{name}" if checkpoint else work_path(spark, name)
    path = sink or f"{work_path(spark, label)}/rows"
    if not buckets.is_table(spark, table):
        buckets.create(spark.createDataFrame([], state), table, key)
    if not is_folder(spark, path):
        spark.createDataFrame([], rows).write.parquet(f"{path}/batch=none")
    return table, path


def version_before(spark: SparkSession, table: str, label: str) -> str | None:
    """The version that a batch starts from, also when the batch has been committed already and is run again."""
    now = buckets.manifest(spark, table)
    return now.parent if now.name == label else now.name


@contextmanager
def partitions(spark: SparkSession, n: int):
    """Shuffle partitions for the stream that starts inside."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def drain(stream: DataFrame, label: str, n: int, sink: str | None = None, mode: str = "append",
          each: Callable[[DataFrame, str, int], None] | None = None, partition_by: tuple[str, ...] = (),
          checkpoint: str | None = None) -> str:
    """Run a stream until it has caught up, into a parquet sink or a function; the path of the sink comes back.

    The function gets each batch with a label and its number. The label holds the id that the checkpoint keeps, so a
    replayed batch has the label it had before, and a stream from a fresh checkpoint has labels of its own.
    """
    spark = stream.sparkSession
    root = work_path(spark, label)
    path = sink or f"{root}/rows"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{root}/checkpoint")
    writer = writer.trigger(availableNow=True)
    started, names = Event(), []
    if each is not None:
        def labelled(batch: DataFrame, number: int) -> None:
            started.wait()
            each(batch, f"{names[0]}-batch-{number}", number)
        writer = writer.foreachBatch(labelled)
    else:
        writer = writer.format("parquet").option("path", path)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
    with partitions(spark, n):
        query = writer.start()
        names.append(query.id)
        started.set()
        query.awaitTermination()
    return path
