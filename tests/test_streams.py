"""Streams in several batches, with a restart from the checkpoint, against their batch twins."""

import pytest
from pyspark.sql import functions as F

import tallyloom.plans.all  # noqa: F401
from tallyloom.operators import conversations, maintain, traffic
from tallyloom.plans import bindings as b
from tallyloom.plans.book import BOOK
from tallyloom.sources import buckets
from tallyloom.sources.versions import current_version, entries, read_version, write_version
from tallyloom.streaming import changes, runs, vehicles


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def parts(spark, data, tmp_path_factory):
    """The events in four files, as four folders that are added one after the other."""
    events = spark.read.parquet(f"{data}/events.parquet").filter("event_id < 400").withColumn("event_id", F.col("event_id") * 1999 + F.col("event_id") % 23)
    return [events.filter(F.col("event_id").between(lo * 1999, (lo + 100) * 1999 - 1)) for lo in range(0, 400, 100)]


def feed(parts, path, upto):
    for part in parts[upto[0]:upto[1]]:
        part.coalesce(1).write.mode("append").parquet(path)


def whole(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return b.traffic_rows(out)


def stream(spark, path):
    return b.traffic_rows(runs.stream_table(spark, path, files_per_trigger=1))


def test_speed_equals_the_window(spark, parts, tmp_path):
    path, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for upto in ((0, 2), (2, 4)):
        feed(parts, path, upto)
        vehicles.vehicle_speed(stream(spark, path), 2, buffer=6, sink=sink, checkpoint=check)
    got = spark.read.parquet(sink).select("event_id", "speed")
    want = traffic.trailing_speed(whole(parts), buffer=6).select("event_id", "speed")
    assert rows_of(got) == rows_of(want) and got.filter("speed > 0").count() > 0


def test_running_summary_equals_the_summary(spark, parts, tmp_path):
    path, root, check = (str(tmp_path / n) for n in ("in", "root", "check"))
    for upto in ((0, 1), (1, 4)):
        feed(parts, path, upto)
        vehicles.running_summary(stream(spark, path), root, 2, checkpoint=check)
    assert rows_of(read_version(spark, root)) == rows_of(traffic.summary(whole(parts)))
    assert current_version(spark, root).endswith("-batch-3")


def test_refreshed_stats_equal_the_summary(spark, parts, tmp_path):
    path, root, check = (str(tmp_path / n) for n in ("in", "root", "check"))
    for upto in ((0, 3), (3, 4)):
        feed(parts, path, upto)
        vehicles.refresh_stats(stream(spark, path), root, 2, checkpoint=check)
    assert rows_of(read_version(spark, f"{root}/stats")) == rows_of(traffic.summary(whole(parts)))


def test_ingest_appends_each_row_once(spark, parts, tmp_path):
    path, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for upto in ((0, 2), (2, 4), (4, 4)):
        feed(parts, path, upto)
        vehicles.ingest(stream(spark, path), 2, sink, check)
    got = spark.read.parquet(sink)
    assert rows_of(got.select("event_id", "video_id")) == rows_of(whole(parts).select("event_id", "video_id"))


def test_late_rows_are_left_out(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [["2024-01-01 00:10:00", "2024-01-01 05:00:00"], ["2024-01-01 06:00:00"], ["2024-01-01 00:20:00", "2024-01-01 09:00:00"]]
    for n, moments in enumerate(rows):
        frame = spark.createDataFrame([(m, "in") for m in moments], "m string, direction string")
        frame.select(F.col("m").cast("timestamp_ntz").alias("at"), "direction").coalesce(1).write.mode("append").parquet(path)
    sink = vehicles.window_counts(runs.stream_table(spark, path, files_per_trigger=1), 2, "at")
    got = {r["window_start"].hour: r["count"] for r in vehicles.latest_windows(spark.read.parquet(sink)).collect()}
    assert got == {0: 1, 5: 1, 6: 1, 9: 1}


def test_windows_are_kept_once(spark, tmp_path):
    path, root, check = (str(tmp_path / n) for n in ("in", "root", "check"))
    rows = [["2024-01-01 00:10:00", "2024-01-01 05:00:00"], ["2024-01-01 05:30:00", None], ["2024-01-01 00:20:00", "2024-01-01 05:40:00"]] * 3
    for moments in rows:
        frame = spark.createDataFrame([(m, None if m and m.endswith("40:00") else "in") for m in moments], "m string, direction string")
        frame.select(F.col("m").cast("timestamp_ntz").alias("at"), "direction").coalesce(1).write.mode("append").parquet(path)
        vehicles.keep_windows(runs.stream_table(spark, path, files_per_trigger=1), root, 2, "at", checkpoint=check)
    got = {(r["window_start"].hour, r["direction"]): r["count"] for r in buckets.read(spark, root).collect()}
    assert got == {(0, "in"): 1, (5, "in"): 6, (5, None): 3}
    assert len([n for n in entries(spark, root) if not n.startswith("_")]) <= 3


def test_change_stream_equals_one_application(spark, tmp_path):
    path, root, check = (str(tmp_path / n) for n in ("in", "root", "check"))
    base = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "id long, name string")
    write_version(base, root)
    sent = spark.createDataFrame([
        (0, "update", 1, 1, "u"), (1, "delete", 2, 2, None), (2, "update", 2, 2, "lost"), (3, "insert", 9, 9, "i"),
        (4, "replace", 3, 3, "r"), (5, "update", 9, 9, "v"), (6, "delete", 1, 1, None), (7, "insert", 1, 1, "again"),
    ], "seq long, op string, old_key long, id long, name string").coalesce(1).cache()
    for low in (0, 3, 6):
        sent.filter(F.col("seq").between(low, low + 2)).write.mode("append").parquet(path)
        changes.apply_stream(runs.stream_table(spark, path, files_per_trigger=1), root, "id", 2, check)
    assert rows_of(read_version(spark, root)) == rows_of(maintain.apply_changes(base, sent, "id"))
    assert rows_of(read_version(spark, root)) == [(0, "s0"), (1, "again"), (3, "r"), (4, "s4"), (9, "v")]


def test_streams_from_fresh_checkpoints_all_apply(spark, tmp_path):
    root = str(tmp_path / "root")
    write_version(spark.createDataFrame([(1, "a")], "id long, name string"), root)
    spark.range(1).write.parquet(f"{root}/archive")
    for n, name in enumerate(("b", "c")):
        path = str(tmp_path / f"in{n}")
        spark.createDataFrame([(n, "update", 1, 1, name)], "seq long, op string, old_key long, id long, name string").coalesce(1).write.parquet(path)
        changes.apply_stream(runs.stream_table(spark, path), root, "id", 2, keep=1)
        assert rows_of(read_version(spark, root)) == [(1, name)]
    assert spark.read.parquet(f"{root}/archive").count() == 1


def test_partitions_follow_the_input(spark, data):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert 1 <= runs.state_partitions(spark, f"{data}/events.parquet") <= int(before)
    with runs.partitions(spark, 3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_change_stream_on_a_bucketed_table(spark, tmp_path):
    path, root, check = (str(tmp_path / n) for n in ("in", "root", "check"))
    base = spark.createDataFrame([(i, f"s{i}") for i in range(50)], "id long, name string")
    buckets.create(base, root, ["id"], 8, small_bytes=0)
    sent = spark.createDataFrame([(k, ("update", "delete", "insert", "replace")[k % 4], k * 7 % 60, k * 7 % 60, f"n{k}") for k in range(12)],
                                 "seq long, op string, old_key long, id long, name string").coalesce(1).cache()
    for low in (0, 4, 8):
        sent.filter(F.col("seq").between(low, low + 3)).write.mode("append").parquet(path)
        changes.apply_stream(runs.stream_table(spark, path, files_per_trigger=1), root, "id", 2, check)
    assert rows_of(buckets.read(spark, root)) == rows_of(maintain.apply_changes(base, sent, "id"))


def test_a_batch_of_statistics_writes_its_own_vehicles(spark, parts, tmp_path):
    path, root, check = (str(tmp_path / n) for n in ("in", "root", "check"))
    feed(parts, path, (0, 3))
    vehicles.refresh_stats(stream(spark, path), root, 2, checkpoint=check)
    few = parts[3].limit(5)
    few.coalesce(1).write.mode("append").parquet(path)
    held = buckets.manifest(spark, f"{root}/vehicles")
    seen = {name: buckets.read(spark, f"{root}/{name}") for name in ("vehicles", "counts")}
    for name, rows in seen.items():  # the same rows in tables without small buckets
        key = buckets.manifest(spark, f"{root}/{name}").key
        buckets.create(rows, f"{root}/{name}", key, 4, small_bytes=0)
    assert held.number > 0
    vehicles.refresh_stats(stream(spark, path), root, 2, checkpoint=check)
    cars = b.traffic_rows(few).select("car_id").distinct().count()
    for name, most in (("vehicles", 60), ("counts", 4 * cars)):
        version = buckets.manifest(spark, f"{root}/{name}").name
        assert spark.read.parquet(f"{root}/{name}/{version}").count() <= most
    assert spark.read.parquet(f"{root}/vehicles/{buckets.manifest(spark, f'{root}/vehicles').name}").select("car_id").distinct().count() == cars
    want = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(spark.read.parquet(path).join(few.select("event_id"), "event_id", "left_semi"))
    assert rows_of(read_version(spark, f"{root}/stats")) == rows_of(traffic.summary(b.traffic_rows(want)))


def test_a_hot_vehicle_is_cut_into_ranges_in_a_batch(spark, tmp_path):
    path, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = spark.range(9000).select(F.col("id").alias("event_id"), F.lit("v").alias("video_id"), F.when(F.col("id") % 10 == 0, F.col("id") % 70).otherwise(
        1).cast("int").alias("car_id"), F.col("id").alias("frame_id"), (F.col("id") * F.col("id") % 997).alias("position_y"))
    for low in range(0, 9000, 3000):
        rows.filter(F.col("event_id").between(low, low + 2999)).coalesce(1).write.mode("append").parquet(path)
        vehicles.vehicle_speed(runs.stream_table(spark, path, files_per_trigger=1), 2, sink=sink, checkpoint=check, hot_rows=500, ranges=5)
    assert rows_of(spark.read.parquet(sink).select("event_id", "speed")) == rows_of(traffic.trailing_speed(rows).select("event_id", "speed"))


def test_a_vehicle_that_stays_away_is_forgotten(spark, tmp_path):
    path, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = spark.range(12).select(F.col("id").alias("event_id"), F.lit("v").alias("video_id"), F.lit(1).alias("car_id"), F.col("id").alias("frame_id"),
                                  (F.col("id") * 50).alias("position_y"))
    for low in (0, 6):
        rows.filter(F.col("event_id").between(low, low + 5)).coalesce(1).write.mode("append").parquet(path)
        vehicles.vehicle_speed(runs.stream_table(spark, path, files_per_trigger=1), 2, idle_ms=0 if low else None, sink=sink, checkpoint=check)
    got = {r.event_id: r.speed for r in spark.read.parquet(sink).collect()}
    assert [k for k, v in sorted(got.items()) if v == 0] == [0, 1, 2, 3, 6, 7, 8, 9]


def test_games_in_batches_equal_the_batch_operator(spark, tmp_path):
    import random

    rng = random.Random(2)
    said = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["go on", "you have won", "you have lost", "hm"])) for c in range(9)
            for t in range(rng.randint(1, 40) if c else 400)]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").cache()
    path, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for low in (0, 3, 4, 10, 17, 200):
        high = {0: 2, 3: 3, 4: 9, 10: 16, 17: 199, 200: 400}[low]
        turns.filter(F.col("turn").between(low, high)).coalesce(1).write.mode("append").parquet(path)
        changes.game_moves(runs.stream_table(spark, path, files_per_trigger=1), 2, sink=sink, checkpoint=check, hot_rows=60, ranges=3)
    got = changes.games(spark.read.parquet(sink))
    want = conversations.games(conversations.game_turns(turns))
    names = ["conv_id", "game_no", "messages", "first_turn", "last_turn", "outcome"]
    assert rows_of(got.select(*names)) == rows_of(want.select(*names)) and want.filter("outcome <> 'open'").count() > 20


@pytest.mark.parametrize("name", [n for n in BOOK.queries if n.startswith("stream_")])
def test_streams_over_empty_tables(spark, data, tmp_path, name):
    for kind in ("events", "customer", "nation", "conversations"):
        spark.read.parquet(f"{data}/{kind}.parquet").limit(0).write.parquet(f"{tmp_path}/{kind}.parquet")
    assert BOOK.queries[name](spark, str(tmp_path)).count() == (22 if name in ("stream_summary", "stream_refresh_stats") else 0)
