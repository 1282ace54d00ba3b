"""Traffic streams: events appended, statistics kept, speed from positions, counts per window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators import traffic
from tallyloom.operators.ordering import HOT_ROWS, first_and_last
from tallyloom.session import work_path
from tallyloom.sources import buckets
from tallyloom.sources.versions import current_version, write_version
from tallyloom.streaming.runs import KEPT, drain, kept_beside, version_before


def ingest(events: DataFrame, n: int, sink: str | None = None, checkpoint: str | None = None) -> str:
    """Event rows appended to a table partitioned by video."""
    return drain(events, "ingest", n, sink, partition_by=("video_id",), checkpoint=checkpoint)


def _partials(events: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Vehicle figures of one batch by type and direction, in a form that can be merged with those of other batches."""
    return events.groupBy(*keys, "vehicle_type", "direction").agg(
        F.max("estimated_speed_kmh").alias("max_speed"), F.count(F.lit(1)).alias("sightings"),
        F.min(order).alias("from"), F.max(order).alias("to"),
        F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"))


def _added_up(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    return partials.groupBy(*keys, "vehicle_type", "direction").agg(
        F.max("max_speed").alias("max_speed"), F.sum("sightings").alias("sightings"),
        F.min("from").alias("from"), F.max("to").alias("to"),
        F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"))


def _vehicles(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    return partials.groupBy(*keys).agg(
        F.max("max_speed").alias("max_speed"), F.sum("sightings").alias("sightings"),
        first_and_last("vehicle_type", "from")[0].alias("vehicle_type"),
        first_and_last("direction", "to")[1].alias("direction"),
        F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"))


#: What vehicles are counted by: all figures follow from these counts.
COUNTED = ("vehicle_type", "direction", "max_speed")


def _counted(vehicles: DataFrame, sign: int) -> DataFrame:
    return vehicles.select(*COUNTED, F.lit(sign).cast("long").alias("n"), (F.col("sightings") * sign).alias("sightings"),
                           "first_frame", "last_frame")


def _moved(rows: DataFrame) -> DataFrame:
    """Counts added up, what went out being negative. The frames may be older than the vehicles that are left, but every vehicle's own are among them and all
    are frames of some sighting, so the first and the last of all rows stay exact."""
    return rows.groupBy(*COUNTED).agg(F.sum("n").alias("n"), F.sum("sightings").alias("sightings"), F.min("first_frame").alias("first_frame"),
                                      F.max("last_frame").alias("last_frame"))


def _keep_stats(events: DataFrame, root: str, stats: str, n: int, keys: Sequence[str], order: str, checkpoint: str | None,
                keep: int | None, label: str) -> None:
    """The 22 figures at ``stats`` after each batch, from two tables under ``root``.

    ``vehicles`` has the merged figures of each vehicle, ``counts`` the vehicles by type, direction and maximum speed. A batch
    reads and writes the vehicles it has seen; in the counts their old figures go out and the new ones come in. So what a
    batch writes follows from its own vehicles. A batch that is run again finds what it wrote and goes on from there.
    """
    spark = events.sparkSession
    vehicles, counts = f"{root}/vehicles", f"{root}/counts"

    def publish(name: str | None) -> None:
        write_version(traffic.long_form(traffic.figures_of_counts(buckets.read(spark, counts))), stats, name, keep)

    if not buckets.is_table(spark, vehicles):
        none = _partials(spark.createDataFrame([], events.schema), keys, order)
        buckets.create(none, vehicles, keys)
        buckets.create(_counted(_vehicles(none, keys), 1), counts, COUNTED)
        publish(None)

    def write(batch: DataFrame, name: str, number: int) -> None:
        if current_version(spark, vehicles) != name:
            own = _partials(batch, keys, order)
            buckets.commit(spark, vehicles, own, lambda base: _added_up(base.unionByName(own), keys), name, KEPT)
        old, new = buckets.written(spark, vehicles)
        moved = _moved(_counted(_vehicles(new, keys), 1).unionByName(_counted(_vehicles(old, keys), -1)))
        buckets.commit(spark, counts, moved, lambda base: _moved(base.unionByName(moved)).filter(F.col("n") > 0), name, KEPT)
        publish(name)

    drain(events, label, n, each=write, checkpoint=checkpoint)


def running_summary(events: DataFrame, root: str, n: int, keys: Sequence[str] = traffic.KEYS, order: str = "event_id",
                    checkpoint: str | None = None, keep: int | None = None) -> None:
    """The 22 figures after each batch, over all events so far, as versions at ``root``; all stay unless ``keep`` says how many."""
    _keep_stats(events, f"{root}-kept", root, n, keys, order, checkpoint, keep, "summary")


def refresh_stats(events: DataFrame, root: str, n: int, keys: Sequence[str] = traffic.KEYS, order: str = "event_id",
                  checkpoint: str | None = None, keep: int | None = None) -> None:
    """The statistics table at ``root/stats`` replaced after each batch. All versions stay unless ``keep`` says how many."""
    _keep_stats(events, root, f"{root}/stats", n, keys, order, checkpoint, keep, "refresh")


def vehicle_speed(events: DataFrame, n: int, keys: Sequence[str] = ("video_id", "car_id"), order: str = "event_id",
                  position: str = "position_y", carry: Sequence[str] = ("frame_id",), buffer: int = traffic.BUFFER,
                  fps: int = traffic.FPS, least: int = traffic.MIN_SIGHTINGS, idle_ms: int | None = None,
                  sink: str | None = None, checkpoint: str | None = None, hot_rows: int = HOT_ROWS, ranges: int | None = None) -> str:
    """Trailing speed with the last positions of each vehicle kept between batches; the same rows as the batch window.

    A batch is scored by the batch operator, led in by the positions that are kept, so a vehicle with very many rows in a batch is
    cut into ranges there too. With ``idle_ms`` a vehicle that stays away is forgotten and starts anew when it returns.
    A replayed batch writes the same rows again, under its own label.
    """
    spark = events.sparkSession
    narrow = events.select(*keys, order, position, *carry)
    names = narrow.columns
    rows = T.StructType([*narrow.schema.fields, T.StructField("speed", T.LongType())])
    last = T.StructType([*[f for f in narrow.schema.fields if f.name in (*keys, order, position)], T.StructField("seen_ms", T.LongType())])
    state, path = kept_beside(spark, "last-positions", checkpoint, sink, "speed", last, list(keys), rows)
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())

    def write(batch: DataFrame, label: str, number: int) -> None:
        now = F.unix_millis(F.current_timestamp())
        lead = buckets.read(spark, state, version_before(spark, state, label), batch.select(*keys))
        if idle_ms is not None:
            lead = lead.filter(F.col("seen_ms") >= now - idle_ms)
        both = lead.drop("seen_ms").withColumn("_new", F.lit(False)).unionByName(batch.withColumn("_new", F.lit(True)), allowMissingColumns=True)
        scored = traffic.trailing_speed(both, keys, [order], position, buffer, fps, least, hot_rows, ranges)
        scored.filter("_new").select(*names, "speed").write.mode("overwrite").parquet(f"{path}/batch={label}")

        def newer(base: DataFrame) -> DataFrame:
            """The newest positions; of a vehicle with many rows each task keeps a few before they meet."""
            kept = base if idle_ms is None else base.filter(F.col("seen_ms") >= now - idle_ms)
            both = kept.unionByName(batch.select(*keys, order, position).withColumn("seen_ms", now))
            return both.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") < buffer).drop("_back")

        buckets.commit(spark, state, batch.select(*keys), newer, label, KEPT)

    drain(narrow, "speed", n, each=write, checkpoint=checkpoint)
    return path


def _windowed(events: DataFrame, moment: str, size: str, late: str, by: Sequence[str]) -> DataFrame:
    timed = events.withColumn("_at", F.col(moment).cast("timestamp")).withWatermark("_at", late)
    counted = timed.groupBy(F.window("_at", size).alias("_window"), *by).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        F.col("_window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("_window.end").cast("timestamp_ntz").alias("window_end"), *by, "count")


def keep_windows(events: DataFrame, root: str, n: int, moment: str, size: str = "1 hour", late: str = "10 minutes",
                 by: Sequence[str] = ("direction",), checkpoint: str | None = None) -> None:
    """Counts per tumbling window in a bucketed table at ``root``, one row a window, open ones too; rows later than the watermark
    are left out. A batch replaces the windows it has changed, so the table has the size of its windows however many batches there
    are, and a closed window is not written again but with its bucket."""
    spark, flat = events.sparkSession, _windowed(events, moment, size, late, by)
    names = [c for c in flat.columns if c != "count"]
    if not buckets.is_table(spark, root):
        buckets.create(spark.createDataFrame([], flat.schema), root, ["window_start", *by])

    def write(batch: DataFrame, label: str, number: int) -> None:
        # The count of a window only grows.
        buckets.commit(spark, root, batch, lambda base: base.unionByName(batch).groupBy(*names).agg(F.max("count").alias("count")), label, KEPT)

    drain(flat, "windows", n, mode="update", each=write, checkpoint=checkpoint)


def window_counts(events: DataFrame, n: int, moment: str, size: str = "1 hour", late: str = "10 minutes",
                  by: Sequence[str] = ("direction",), sink: str | None = None, checkpoint: str | None = None) -> str:
    """Counts per tumbling window; rows later than the watermark are left out.

    Each batch writes the windows it has changed under its number, open ones too; ``latest_windows`` reads the sink.
    """
    flat = _windowed(events, moment, size, late, by)
    path = sink or work_path(events.sparkSession, "windows")

    def write(batch: DataFrame, label: str, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    drain(flat, "window-counts", n, mode="update", each=write, checkpoint=checkpoint)
    return path


def latest_windows(written: DataFrame) -> DataFrame:
    """The last count of each window, closed or open."""
    names = [c for c in written.columns if c not in ("batch", "count")]
    return written.groupBy(*names).agg(F.max_by("count", "batch").alias("count"))
