"""Pages of a versioned table by a kept index.

The first page of a version lays its rows out in pieces along the order, one folder each, and writes beside them which rows a
piece holds. Every further page reads the index and the folders it lies in. A new version gets an index of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.cells import with_pieces
from tallyloom.operators.ordering import page, prefix_scan
from tallyloom.sources.versions import _switch, current_version, read_version

#: Rows of a piece, and the least number of pieces.
PIECE_ROWS = 100_000
PIECES = 64


def index_pages(spark: SparkSession, root: str, order: Sequence[str], version: str | None = None, rows: int = PIECE_ROWS) -> str:
    """The folder with the pieces and the index of a version, made where there is none. ``order`` must be unique.

    A folder counts once its pointer names it, so a build that dies half way, or beside another one, does no harm.
    """
    name = version or current_version(spark, root)
    home = f"{root}/_pages/{name}/{'+'.join(order)}"
    made = current_version(spark, home)
    if made is not None:
        return f"{home}/{made}"
    table = read_version(spark, root, name)
    label = f"p-{uuid.uuid4().hex[:12]}"
    path = f"{home}/{label}"
    pieces = None if table.count() >= PIECES * rows else PIECES
    laid = with_pieces(table, list(order), "_piece", rows, pieces)
    laid.repartition("_piece").write.partitionBy("_piece").parquet(f"{path}/rows")
    counts = spark.read.schema(laid.schema).parquet(f"{path}/rows").groupBy("_piece").agg(F.count(F.lit(1)).alias("n"))
    prefix_scan(counts, [], ["_piece"], sums={"upto": F.col("n")}).write.parquet(f"{path}/index")
    _switch(spark, home, label)
    return path


def read_page(spark: SparkSession, root: str, order: Sequence[str], offset: int, limit: int, version: str | None = None,
              rows: int = PIECE_ROWS) -> DataFrame:
    """Rows offset+1 .. offset+limit of a version of a table; none beyond its end."""
    name = version or current_version(spark, root)
    path = index_pages(spark, root, order, name, rows)
    inside = (F.col("upto") > offset) & (F.col("upto") - F.col("n") < offset + limit)
    found = spark.read.parquet(f"{path}/index").filter(inside).select("_piece", (F.col("upto") - F.col("n")).alias("before")).orderBy("_piece").collect()
    table = read_version(spark, root, name)
    if not found:
        return table.limit(0)
    # A page of ordinary size lies in one or two pieces.
    part = spark.read.schema(table.schema).parquet(*[f"{path}/rows/_piece={r['_piece']}" for r in found])
    return page(part, list(order), offset - found[0]["before"], limit)
