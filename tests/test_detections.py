"""Suppression against a plain loop, zones and the perspective."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import geometry
from tallyloom.operators import detections as d

SCHEMA = ("event_id long, video_id string, frame_id long, timestamp double, x1 double, y1 double, x2 double, y2 double, "
          "confidence double, class_id int, tracker_id long, processing_datetime timestamp_ntz")


def boxes_of(spark, rows):
    full = [(i, v, f, f / 30.0, x, y, x + w, y + h, c, k, i % 17, None) for i, (v, f, x, y, w, h, c, k) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def iou(a, b):
    w = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])
    h = min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return w * h / (area(a) + area(b) - w * h)


def greedy(rows, threshold):
    kept = []
    for row in sorted(rows, key=lambda r: (-r["confidence"], r["event_id"])):
        same = [k for k in kept if (k["video_id"], k["frame_id"], k["class_id"]) == (row["video_id"], row["frame_id"], row["class_id"])]
        if all(iou(k, row) <= threshold for k in same):
            kept.append(row)
    return sorted(r["event_id"] for r in kept)


def crowd(seed, n, spread, sizes, frames=1):
    rng = random.Random(seed)
    return [("v", rng.randrange(frames), rng.uniform(0, spread), rng.uniform(0, spread), rng.choice(sizes), rng.choice(sizes),
             rng.randrange(20) / 20, rng.choice([2, 7])) for _ in range(n)]


@pytest.mark.parametrize("rows, threshold", [
    (crowd(1, 120, 60, [40, 45, 50]), 0.3), (crowd(2, 100, 5, [40]), 0.7), (crowd(3, 100, 80, [10, 20, 40, 80]), 0.7),
    (crowd(4, 160, 80, [30, 33], 5), 0.7),
], ids=["dense", "almost copies", "mixed sizes", "frames"])
def test_fold_and_grid_equal_a_plain_loop(spark, rows, threshold):
    boxes = boxes_of(spark, rows).cache()
    want = greedy(boxes.collect(), threshold)
    for few, many in ((10**6, 10**6), (0, 10**6), (0, 0)):
        got = sorted(r["event_id"] for r in d.suppress(boxes, threshold, frame_boxes=few, crowd_boxes=many).collect())
        assert got == want, (few, many)


def test_each_frame_goes_its_own_way(spark):
    rows = [(v, *rest) for v, n in (("few", 8), ("some", 40), ("many", 90)) for (_, *rest) in crowd(n, n, 30, [20])]
    boxes = boxes_of(spark, rows).withColumn("class_id", F.lit(2))
    want = greedy(boxes.collect(), 0.7)
    assert sorted(r["event_id"] for r in d.suppress(boxes, frame_boxes=10, crowd_boxes=50).collect()) == want


def test_copies_leave_one(spark):
    boxes = boxes_of(spark, [("v", 1, 5.0, 5.0, 10.0, 10.0, 0.5, 2)] * 40)
    assert [r["event_id"] for r in d.suppress(boxes, frame_boxes=0, crowd_boxes=0).collect()] == [0]


def test_middle_box_falls_and_the_outer_two_stay(spark):
    rows = [("v", 1, 0.0, 0.0, 10.0, 10.0, 0.9, 2), ("v", 1, 1.0, 0.0, 10.0, 10.0, 0.8, 2), ("v", 1, 2.0, 0.0, 10.0, 10.0, 0.7, 2)]
    boxes = boxes_of(spark, rows)
    for few, many in ((100, 100), (0, 100), (0, 0)):
        assert sorted(r["event_id"] for r in d.suppress(boxes, 0.7, frame_boxes=few, crowd_boxes=many).collect()) == [0, 2]


def test_a_giant_box_does_not_slow_the_others(spark, monkeypatch):
    small = [("v", 1, 100.0 * k, 0.0, 20.0, 20.0, 0.5, 2) for k in range(12)]
    rounds = []
    frame = type(boxes_of(spark, []))
    plain = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a: (rounds[-1].append(1), plain(self, *a))[1])
    for rows in (small, [*small, ("v", 1, 0.0, 0.0, 5000.0, 5000.0, 0.9, 2)]):
        rounds.append([])
        assert len(d.suppress(boxes_of(spark, rows), frame_boxes=0, crowd_boxes=0).collect()) == len(rows)
    assert len(rounds[0]) == len(rounds[1])


def test_no_boxes(spark):
    assert d.suppress(boxes_of(spark, [])).count() == 0


def test_confidence_is_strict(spark):
    boxes = boxes_of(spark, [("v", 1, 0.0, 0.0, 1.0, 1.0, c, 2) for c in (0.3, 0.31)])
    assert [r["event_id"] for r in d.confident(boxes).collect()] == [1]


def test_zone(spark):
    points = spark.createDataFrame([(1700.0, 1000.0), (1700.0, 700.0), (0.0, 2000.0), (-600.0, 2000.0), (3000.0, 1500.0)], "x double, y double")
    got = [r[0] for r in points.select(geometry.in_polygon(F.col("x"), F.col("y"))).collect()]
    assert got == [True, False, True, False, True]


def test_perspective_takes_corners_to_corners(spark):
    corners = spark.createDataFrame([tuple(map(float, p)) for p in geometry.ROAD_ZONE], "x double, y double")
    a, b, c, e, f, g, h, i = geometry.perspective_coefficients()
    for (x, y), (u, v) in zip(geometry.ROAD_ZONE, geometry.ROAD_PLANE):
        depth = h * x + i * y + 1
        assert np.allclose([(a * x + b * y + c) / depth, (e * x + f * y + g) / depth], [u, v])
    assert corners.select(*geometry.perspective(F.col("x"), F.col("y"))).count() == 4


def test_event_rows(spark):
    rows = [("v", f, 1500.0 + f, 900.0 + 10 * f, 100.0, 80.0, 0.9, 7) for f in range(8)]
    boxes = boxes_of(spark, rows).withColumn("tracker_id", F.lit(4).cast("long"))
    got = d.detections_to_events(boxes, 3840).orderBy("frame_id").collect()
    assert len(got) == 8
    assert {r["vehicle_type"] for r in got} == {"truck"} and {r["direction"] for r in got} == {"in"}
    assert [r["estimated_speed_kmh"] > 0 for r in got] == [False] * 4 + [True] * 4
    assert got[0]["position_x"] == 1550 and got[0]["position_y"] == 980
