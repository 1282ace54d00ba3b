"""Scans, numbers, pages and speeds on hot keys against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import ordering, traffic


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, "c"])
        rows.append((key, i, rng.randint(0, 500)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, at long, v long").repartition(5).cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_hot_keys_finds_only_large_ones(skewed):
    assert [r[0] for r in ordering.hot_keys(skewed, ["k"], 800).collect()] == ["hot"]
    assert ordering.hot_keys(skewed, ["k"], 5000) is None


def test_null_can_be_hot(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("x", i) for i in range(5)], "k string, at long")
    got = ordering.number_rows(df, ["k"], ["at"], hot_rows=20, ranges=4)
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy("at")).cast("long"))
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("hot_rows", [10, 800, 10**6])
def test_prefix_scan(skewed, hot_rows):
    got = ordering.prefix_scan(skewed, ["k"], ["at"], {"total": F.col("v")}, {"top": F.col("v")}, hot_rows=hot_rows, ranges=7)
    line = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select("*", F.sum("v").over(line).alias("total"), F.max("v").over(line).alias("top"))
    assert rows_of(got) == rows_of(want)


def test_exclusive_scan_is_the_same_both_ways(skewed):
    sums, maxes = {"before": F.col("v")}, {"top": F.when(F.col("v") % 2 == 0, F.col("v"))}
    plain = ordering.scan_keys(skewed, ["k"], ["at"], sums, maxes, inclusive=False)
    cut = ordering.scan_ranges(skewed, ["k"], ["at"], sums, maxes, inclusive=False, ranges=9)
    assert rows_of(plain) == rows_of(cut)


def test_global_numbers_have_no_gaps(skewed):
    got = ordering.number_rows(skewed, [], ["at"], ranges=6).orderBy("at").select("position").collect()
    assert [r[0] for r in got] == list(range(1, 3001))


def test_numbers_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "k string, at long")
    assert ordering.number_rows(empty, [], ["at"]).count() == 0


def test_order_by_text_and_time(spark):
    df = spark.range(500).select(
        F.concat(F.lit("n"), (F.col("id") * 7919 % 503).cast("string")).alias("name"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id % 10 as int))").alias("ts"), "id")
    got = ordering.number_rows(df, [], ["ts", "name"], ranges=5)
    want = df.withColumn("position", F.row_number().over(Window.orderBy("ts", "name")).cast("long"))
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("offset", [0, 17, 2990, 4000])
def test_deep_page_equals_near_page(skewed, offset):
    near = ordering.page(skewed, ["at"], offset, 25)
    deep = ordering.page(skewed, ["at"], offset, 25, near=0, ranges=6)
    assert [tuple(r) for r in near.collect()] == [tuple(r) for r in deep.collect()]


@pytest.mark.parametrize("ranges", [1, 3, 40, 400])
def test_trailing_speed_of_a_hot_vehicle(skewed, ranges):
    events = skewed.select(F.coalesce("k", F.lit("n")).alias("car_id"), F.lit("v").alias("video_id"),
                           F.col("at").alias("event_id"), F.col("v").alias("position_y"))
    plain = traffic.trailing_speed(events)
    cut = traffic.trailing_speed(events, hot_rows=100, ranges=ranges)
    assert rows_of(plain) == rows_of(cut)


def test_speed_needs_five_sightings(spark):
    rows = [("v", 1, i, 10 * i) for i in range(7)] + [("v", 2, 100, 50)]
    events = spark.createDataFrame(rows, "video_id string, car_id long, event_id long, position_y long")
    got = [r["speed"] for r in traffic.trailing_speed(events).filter("car_id = 1").orderBy("event_id").collect()]
    assert got == [0, 0, 0, 0] + [int(10 * (n - 1) / (n / 30) * 3.6) for n in (5, 6, 7)]


def test_speed_buffer_moves_on(spark):
    rows = [("v", 1, i, i * i) for i in range(40)]
    events = spark.createDataFrame(rows, "video_id string, car_id long, event_id long, position_y long")
    got = {r["event_id"]: r["speed"] for r in traffic.trailing_speed(events, buffer=10).collect()}
    assert got[39] == int((39 * 39 - 30 * 30) / (10 / 30) * 3.6)


@pytest.mark.parametrize("kind", ["double", "int", "decimal(20,3)", "string"])
@pytest.mark.parametrize("ranges", [2, 13, 300])
def test_ranges_of_odd_values_stay_in_order(spark, kind, ranges):
    rng = random.Random(8)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(1e6, 1), -(2.0 ** 30), 2.0 ** 30]) for _ in range(900)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").withColumn("v", F.col("v").cast(kind))
    if kind == "double":
        odd = spark.createDataFrame([(-1, None), (-2, float("nan")), (-3, float("inf")), (-4, float("-inf"))], df.schema)
        df = df.union(odd)
    got = ordering.number_rows(df, [], ["v", "i"], ranges=ranges)
    want = df.withColumn("position", F.row_number().over(Window.orderBy("v", "i")).cast("long"))
    assert rows_of(got.select("i", "position")) == rows_of(want.select("i", "position"))


@pytest.mark.parametrize("order", [["at"], ["f", "at"]])
def test_skewed_order_still_splits(spark, order):
    """Half of the rows of a hot key lie close together, or share the first order column."""
    df = spark.range(40_000).select(
        F.when(F.col("id") % 4 == 0, "other").otherwise("hot").alias("k"),
        F.when(F.col("id") % 2 == 0, F.col("id") / 1e9).otherwise(F.col("id") * 1e3).alias("at"), (F.col("id") % 3).alias("f"))
    ranges = ordering.with_ranges(df, ["k"], order, ranges=50).groupBy("k", "_range").count().collect()
    for key in ("hot", "other"):
        sizes = [r["count"] for r in ranges if r["k"] == key]
        assert len(sizes) >= 40 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_code_travels_with_the_functions():
    from pyspark import cloudpickle

    from tallyloom.operators import detections

    assert len(cloudpickle.dumps(detections._greedy)) > 300
