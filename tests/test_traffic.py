"""Traffic figures on small frames, against plain pandas."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import traffic as t
from tallyloom.sources.tables import empty_table

SCHEMA = ("event_id long, video_id string, frame_id long, timestamp double, car_id long, estimated_speed_kmh long, "
          "vehicle_type string, direction string")


def frame(spark, rows):
    """Rows of (car, frame, speed, type, direction)."""
    full = [(i, "v0", f, f / 30.0, c, s, k, d) for i, (c, f, s, k, d) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def stats(events):
    return {r["metric"]: r["value"] for r in t.summary(events).collect()}


def test_no_events(spark):
    got = stats(empty_table(spark, "traffic_events").withColumn("event_id", F.lit(1)))
    assert len(got) == 22
    assert got.pop("Fastest Vehicle Type") == got.pop("Slowest Vehicle Type") == got.pop("Direction Balance") == "N/A"
    assert set(got.values()) == {"0"}


def test_labels_and_their_order(spark):
    rows = t.summary(frame(spark, [(1, 0, 10, "car", "in")])).collect()
    assert [r["metric"] for r in rows] == list(t.METRICS.values())
    assert len(t.METRICS) == 22


def test_one_vehicle(spark):
    got = stats(frame(spark, [(1, 0, 10, "car", "in"), (1, 1, 90, "car", "in")]))
    assert got["Speed Standard Deviation"] == "nan"
    assert got["IN/OUT Ratio"] == "inf"
    assert got["Avg Events per Vehicle"] == "2.0"
    assert got["Cars Percentage (%)"] == "100.0"
    assert got["Fastest Vehicle Type"] == "car"
    assert got["Direction Balance"] == "More vehicles going IN"


def test_large_ratio_is_not_written_with_an_exponent(spark):
    got = stats(frame(spark, [(c, 0, 10, "car", "in") for c in range(1, 40)] + [(99, 1, 10, "car", "out")]))
    assert got["IN/OUT Ratio"] == "39.0"
    assert got["Vehicles per Minute"] == "36000.0"


def test_equal_extremes_go_to_the_truck(spark):
    got = stats(frame(spark, [(1, 0, 50, "car", "in"), (2, 0, 50, "truck", "out")]))
    assert got["Fastest Vehicle Type"] == got["Slowest Vehicle Type"] == "truck"
    assert got["Direction Balance"] == "Balanced traffic flow"


def test_first_and_last_skip_nulls(spark):
    rows = t.vehicle_table(frame(spark, [(1, 0, 1, None, "in"), (1, 1, 1, "truck", "out"), (1, 2, 1, "car", None)])).first()
    assert (rows["vehicle_type"], rows["direction"]) == ("truck", "out")


def test_same_number_in_two_videos(spark):
    events = frame(spark, [(1, 0, 1, "car", "in"), (1, 1, 1, "car", "in")]).withColumn(
        "video_id", F.concat(F.lit("v"), F.col("event_id").cast("string")))
    assert t.vehicle_table(events).count() == 1
    assert t.vehicle_table(events, ["video_id", "car_id"]).count() == 2


def test_bands_at_their_edges(spark):
    vehicles = spark.createDataFrame([(v, "car") for v in (0.0, 80.0, 80.5, 100.0, 130.0, 131.0)], "max_speed double, vehicle_type string")
    got = {r["speed_category"]: r["count"] for r in t.speed_bands(vehicles).collect()}
    assert got == {"Slow (0-80)": 1, "Normal (80-100)": 2, "Fast (100-130)": 1, "Speeding (>130)": 1}


def test_buckets_round_half_to_even(spark):
    df = spark.createDataFrame([(f,) for f in (14, 15, 16, 44, 45, 46, 75)], "f long")
    assert [r[0] for r in df.select(t.frame_bucket(F.col("f"))).collect()] == [0, 0, 30, 30, 60, 60, 60]


def test_histogram_of_one_value_and_of_a_range(spark):
    one = t.speed_histogram(spark.createDataFrame([(5,), (5,)], "max_speed long")).collect()
    assert [(r["bin"], r["count"]) for r in one] == [(0, 2)]
    many = t.speed_histogram(spark.createDataFrame([(v,) for v in range(101)], "max_speed long"))
    assert sum(r["count"] for r in many.collect()) == 101 and many.count() == 20
    assert many.filter("bin = 19").first()["count"] == 6


def test_trend_needs_three_points(spark):
    flow = spark.createDataFrame([(0, 4), (1, 6)], "frame_id long, vehicle_count long")
    assert t.trend(flow).count() == 0
    line = t.trend(flow.union(spark.createDataFrame([(2, 8)], flow.schema))).first()
    assert (line["slope"], line["intercept"], line["r2"]) == pytest.approx((2.0, 4.0, 1.0))


def test_constant_series_fits_perfectly(spark):
    flow = spark.createDataFrame([(i, 3) for i in range(5)], "frame_id long, vehicle_count long")
    line = t.trend(flow).first()
    assert (line["slope"], line["r2"]) == (0.0, 1.0)


@pytest.mark.parametrize("stride", [1, 3, 1000])
def test_forecast_goes_on_for_a_quarter(spark, stride):
    events = frame(spark, [(c, f, 10, "car", "in") for f in range(1, 42) for c in range(f % 3 + 1)])
    got = t.forecast(events, stride=stride)
    future = sorted(r["frame_id"] for r in got.filter("type = 'Forecast'").collect())
    assert future == list(range(42, 52))
    assert got.filter("type = 'Historical'").count() == 41


def test_forecast_without_times_is_empty(spark):
    events = frame(spark, [(1, f, 10, "car", "in") for f in range(5)]).withColumn("timestamp", F.lit(0.0))
    assert t.forecast(events).count() == 0


def test_directions_need_one_that_is_usable(spark):
    unknown = frame(spark, [(1, f, 10, "car", "unknown") for f in range(5)])
    assert t.direction_over_time(unknown).count() == 0
    mixed = unknown.union(frame(spark, [(2, 1, 10, "car", "in")]))
    assert {r["direction"] for r in t.direction_over_time(mixed).collect()} == {"unknown", "in"}


def test_metric_difference(spark):
    make = lambda names: spark.createDataFrame([(n,) for n in names], "metric string")
    got = t.metric_difference(make(["a", "b"]), make(["b", "c", "c"]))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "missing"), ("c", "unexpected")]


def by_hand(pdf):
    """The figures in plain pandas, written from their definitions."""
    cars = pdf.sort_values("event_id").groupby("car_id")
    top, size = cars["estimated_speed_kmh"].max(), cars.size()
    kind, way = cars["vehicle_type"].first(), cars["direction"].last()
    n, total = len(top), len(pdf)
    minutes = (pdf["frame_id"].max() - pdf["frame_id"].min() + 1) / 30 / 60
    came, went = int((way == "in").sum()), int((way == "out").sum())
    fast = "car" if top[kind == "car"].max() > top[kind == "truck"].max() else "truck"
    slow = "car" if top[kind == "car"].mean() < top[kind == "truck"].mean() else "truck"
    over = int((top > 130).sum())
    values = [
        n, int((kind == "car").sum()), int((kind == "truck").sum()), total, round(total / n, 1),
        round((kind == "car").sum() / n * 100, 1), round((kind == "truck").sum() / n * 100, 1),
        round(top.mean(), 1), int(top.max()), int(top.min()), round(top.std(), 1), round(n / minutes, 1),
        round(size.mean() / 30, 1), over, round(over / n * 100, 1), fast, slow, came, went,
        int((way == "stationary").sum()), round(came / went, 2),
        "More vehicles going IN" if came > went else "More vehicles going OUT" if went > came else "Balanced traffic flow",
    ]
    return dict(zip(t.METRICS.values(), (str(v) for v in values)))


@pytest.mark.parametrize("seed", range(4))
def test_summary_equals_pandas(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 30), f, rng.randint(0, 180), rng.choice(["car", "truck", "bus", None]),
             rng.choice(["in", "out", "stationary", None])) for f in range(300)]
    events = frame(spark, rows)
    want, got = by_hand(events.toPandas()), stats(events)
    for metric, value in want.items():
        try:
            assert math.isclose(float(got[metric]), float(value), abs_tol=1e-9), metric
        except ValueError:
            assert got[metric] == value, metric


def test_counts_of_types_add_up(spark):
    rng = random.Random(9)
    events = frame(spark, [(rng.randint(1, 50), f, rng.randint(0, 200), rng.choice("abc"), "in") for f in range(400)])
    vehicles = t.vehicle_table(events)
    assert t.value_counts(vehicles, "vehicle_type").agg(F.sum("count")).first()[0] == vehicles.count()
    banded = t.speed_bands(vehicles).agg(F.sum("count")).first()[0]
    assert banded + vehicles.filter("max_speed = 0").count() == vehicles.count()
    boxes = t.speed_box(vehicles).toPandas().set_index("vehicle_type")
    pdf = vehicles.toPandas()
    for kind, part in pdf.groupby("vehicle_type"):
        assert boxes.loc[kind, "median"] == pytest.approx(part["max_speed"].quantile(0.5))
        assert boxes.loc[kind, "q1"] == pytest.approx(part["max_speed"].quantile(0.25))
    assert isinstance(pdf, pd.DataFrame)


@pytest.mark.parametrize("ranges", [1, 7])
def test_quartiles_of_a_type_with_many_speeds(spark, ranges):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 5 == 0, "truck").when(F.col("id") < 9, "bike").otherwise("car").alias("vehicle_type"),
        F.when(F.col("id") % 11 == 0, 50).otherwise(F.col("id") * F.col("id") % 1009).cast("long").alias("max_speed"))
    one = spark.createDataFrame([("bus", 7), ("van", None)], "vehicle_type string, max_speed long")
    rows = rows.unionByName(one)
    want = {r.vehicle_type: r for r in t.speed_box(rows).collect()}
    got = {r.vehicle_type: r for r in t.speed_box(rows, hot_rows=4, ranges=ranges).collect()}
    assert got == want and set(got) == {"car", "truck", "bike", "bus"}
