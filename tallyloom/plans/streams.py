"""Streams over the given tables, each run until it has caught up and read back as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.plans import bindings as b
from tallyloom.plans.book import BOOK
from tallyloom.plans.chats import GAME_TURNS_SQL
from tallyloom.plans.vehicles import SPEED_SQL, SUMMARY_SQL
from tallyloom.session import work_path
from tallyloom.sources import buckets
from tallyloom.sources.tables import TRAFFIC_EVENTS
from tallyloom.sources.versions import folder_bytes, put_in_order, read_version
from tallyloom.streaming import changes, runs, vehicles

TRAFFIC = "WITH " + b.TRAFFIC_SQL


#: What one file of a stream may hold, and the least number of batches, so that a small table has several too.
FILE_BYTES = 128 << 20
BATCHES = 3


def _in_turn(spark, folder, name, order):
    """A given table as a stream of files that follow each other in ``order``, in one pass over the table.

    There are as many ranges as its size asks for. A stream takes files by age, so the files get theirs in the order of the ranges.
    """
    rows = b.table(spark, folder, name)
    path, size = work_path(spark, f"{name}-files"), folder_bytes(spark, f"{folder}/{name}.parquet")
    batches = max(BATCHES, -(-size // runs.BYTES_PER_TRIGGER))
    files = max(batches, -(-size // FILE_BYTES))
    rows.repartitionByRange(files, *order).write.parquet(path)
    put_in_order(spark, path)
    return (runs.stream_table(spark, path, rows.schema, files_per_trigger=-(-files // batches)),
            runs.state_partitions(spark, f"{folder}/{name}.parquet"))


def _events(spark, folder):
    stream, n = _in_turn(spark, folder, "events", ["event_id"])
    return b.traffic_rows(stream), n


@BOOK.add("stream_ingest", TRAFFIC + """
SELECT video_id, frame_id, "timestamp", car_id, position_x, position_y, estimated_speed_kmh, vehicle_type, direction,
       processing_datetime FROM traffic""")
def stream_ingest(spark, folder):
    events, n = _events(spark, folder)
    names = [f.name for f in TRAFFIC_EVENTS.fields]
    rows = events.select(*names)
    return spark.read.schema(rows.schema).parquet(vehicles.ingest(rows, n)).select(*names)


@BOOK.add("stream_summary", SUMMARY_SQL)
def stream_summary(spark, folder):
    events, n = _events(spark, folder)
    root = work_path(spark, "running-stats")
    vehicles.running_summary(events, root, n)
    return read_version(spark, root)


@BOOK.add("stream_refresh_stats", SUMMARY_SQL)
def stream_refresh_stats(spark, folder):
    events, n = _events(spark, folder)
    root = work_path(spark, "refreshed-stats")
    vehicles.refresh_stats(events, root, n)
    return read_version(spark, f"{root}/stats")


@BOOK.add("stream_vehicle_speed", TRAFFIC + " " + SPEED_SQL)
def stream_vehicle_speed(spark, folder):
    events, n = _events(spark, folder)
    return spark.read.parquet(vehicles.vehicle_speed(events, n)).drop("position_y", "batch")


@BOOK.add("stream_window_counts", TRAFFIC + """
SELECT date_trunc('hour', processing_datetime) AS window_start, date_trunc('hour', processing_datetime) + INTERVAL 1 HOUR AS window_end,
       direction, count(*) AS "count" FROM traffic GROUP BY ALL""")
def stream_window_counts(spark, folder):
    events, n = _events(spark, folder)
    root = work_path(spark, "window-counts")
    vehicles.keep_windows(events, root, n, "processing_datetime")
    return buckets.read(spark, root)


CHANGES_SQL = """
WITH changes AS (SELECT c_custkey AS seq, CASE c_mktsegment WHEN 'BUILDING' THEN 'delete' WHEN 'MACHINERY' THEN 'replace' ELSE 'update' END AS op,
                        c_nationkey AS n_nationkey, c_name AS n_name FROM customer),
cuts AS (SELECT n_nationkey, max(seq) AS cut FROM changes WHERE op <> 'update' GROUP BY 1),
sets AS (SELECT n_nationkey, max(seq) AS set_at, arg_max(n_name, seq) AS set_name FROM changes WHERE op = 'update' GROUP BY 1),
rows AS (SELECT n_nationkey, n_name, -1 AS seq FROM nation
         UNION ALL SELECT n_nationkey, n_name, seq FROM changes WHERE op = 'replace')
SELECT r.n_nationkey, CASE WHEN s.set_at > r.seq THEN s.set_name ELSE r.n_name END AS n_name
FROM rows r LEFT JOIN cuts c ON r.n_nationkey = c.n_nationkey LEFT JOIN sets s ON r.n_nationkey = s.n_nationkey
WHERE c.cut IS NULL OR r.seq >= c.cut"""


@BOOK.add("stream_apply_changes", CHANGES_SQL)
def stream_apply_changes(spark, folder):
    """Customers as changes to their nation: a deletion, a replacement or an update of its name."""
    root = work_path(spark, "nation")
    buckets.create(b.table(spark, folder, "nation").select("n_nationkey", "n_name"), root, ["n_nationkey"])
    stream, n = _in_turn(spark, folder, "customer", ["c_custkey"])
    op = (F.when(F.col("c_mktsegment") == "BUILDING", F.lit("delete")).when(F.col("c_mktsegment") == "MACHINERY", F.lit("replace"))
          .otherwise(F.lit("update")))
    stream = stream.select(
        F.col("c_custkey").alias("seq"), op.alias("op"), F.col("c_nationkey").alias("old_key"),
        F.col("c_nationkey").alias("n_nationkey"), F.col("c_name").alias("n_name"))
    changes.apply_stream(stream, root, "n_nationkey", n)
    return buckets.read(spark, root)


@BOOK.add("stream_games", "WITH " + GAME_TURNS_SQL + " SELECT conv_id, game_no, messages, first_turn, last_turn, outcome FROM games")
def stream_games(spark, folder):
    turns, n = _in_turn(spark, folder, "conversations", ["turn", "conv_id"])
    moves = changes.game_moves(turns.select("conv_id", "turn", "role", "text"), n, b.WON_MARK, b.LOST_MARK)
    return changes.games(spark.read.parquet(moves))
