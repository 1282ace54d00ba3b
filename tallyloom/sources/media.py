"""Listing of media files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """Path, modification time and size of the files with one of the extensions.

    The content column is never selected, so the reader lists files without opening them.
    """
    glob = "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"
    found = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    )
    return found.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"))
