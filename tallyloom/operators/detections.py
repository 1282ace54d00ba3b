"""Detections of a frame: confidence, zone, overlap suppression, and the way to event rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import display, geometry
from tallyloom.operators.traffic import trailing_speed
from tallyloom.session import shared_folder

CONFIDENCE = 0.3
OVERLAP = 0.7
FRAME_BOXES = 256
CROWD_BOXES = 20_000
FRAME = ("video_id", "frame_id")


def confident(boxes: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    return boxes.filter(F.col("confidence") > threshold)


def in_zone(boxes: DataFrame, zone: Sequence[geometry.Point] = geometry.ROAD_ZONE) -> DataFrame:
    """Boxes whose bottom centre lies in the zone."""
    return boxes.filter(geometry.in_polygon((F.col("x1") + F.col("x2")) / 2, F.col("y2"), zone))


def suppress(boxes: DataFrame, threshold: float = OVERLAP, frame: Sequence[str] = FRAME, order: str = "event_id",
             frame_boxes: int = FRAME_BOXES, crowd_boxes: int = CROWD_BOXES) -> DataFrame:
    """Greedy overlap suppression in each frame and class.

    Boxes are taken by falling confidence, equals by rising ``order``, which is a unique number; a box is
    dropped when it overlaps one already kept by more than the threshold. A frame with few boxes is folded by
    expressions and a crowded one, up to a set size, by array arithmetic. Frames beyond that are worked on in a grid
    of cells. The outcome is the same.
    """
    keys = [*frame, "class_id"]
    counts = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    largest = counts.agg(F.max("_size")).first()[0] or 0
    if largest <= frame_boxes:
        return _fold(boxes, keys, threshold, order)

    def between(low: int, high: int | None) -> DataFrame:
        test = F.col("_size") > low
        return boxes.join(counts.filter(test if high is None else test & (F.col("_size") <= high)).select(*keys), keys, "left_semi")

    small = _fold(between(0, frame_boxes), keys, threshold, order)
    crowded = _fold_arrays(between(frame_boxes, max(crowd_boxes, frame_boxes)), keys, threshold, order)
    kept = small.unionByName(crowded)
    if largest <= crowd_boxes:
        return kept
    return kept.unionByName(_grid(between(max(crowd_boxes, frame_boxes), None), keys, threshold, order))


def _fold(boxes: DataFrame, keys: Sequence[str], threshold: float, order: str) -> DataFrame:
    names = boxes.columns
    item = F.struct((-F.col("confidence")).alias("_rank"), F.col(order).alias("_order"), *[F.col(n) for n in names])
    grouped = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_boxes"))
    none = F.slice(F.col("_boxes"), 1, 0)

    def keep(kept, box):
        covered = F.exists(kept, lambda other: geometry.overlap(other, box) > threshold)
        return F.when(covered, kept).otherwise(F.concat(kept, F.array(box)))

    kept = grouped.select(F.explode(F.aggregate("_boxes", none, keep)).alias("_box"))
    return kept.select(*[F.col(f"_box.{n}").alias(n) for n in names])


def _fold_arrays(boxes: DataFrame, keys: Sequence[str], threshold: float, order: str) -> DataFrame:
    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        ranked = rows.sort_values(["confidence", order], ascending=[False, True])
        return ranked[_greedy(ranked[["x1", "y1", "x2", "y2"]].to_numpy(dtype="float64"), threshold)]

    return boxes.groupBy(*keys).applyInPandas(keep, boxes.schema)


def _greedy(ranked: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the ranked boxes are kept."""
    x1, y1, x2, y2 = ranked.T
    area = (x2 - x1) * (y2 - y1)
    undecided = np.arange(len(ranked))
    kept = np.zeros(len(ranked), dtype=bool)
    while len(undecided):
        best, rest = undecided[0], undecided[1:]
        kept[best] = True
        across = np.maximum(np.minimum(x2[rest], x2[best]) - np.maximum(x1[rest], x1[best]), 0.0)
        down = np.maximum(np.minimum(y2[rest], y2[best]) - np.maximum(y1[rest], y1[best]), 0.0)
        shared = across * down
        union = area[rest] + area[best] - shared
        share = np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)
        undecided = rest[share <= threshold]
    return kept


def _reach(axis: str, base: float) -> list[Column]:
    """Steps along one axis to all size classes and cells that may hold a partner of a box."""
    return [F.struct(F.lit(step).alias(f"{axis}s"), F.lit(cell).alias(f"{axis}c"))
            for step, far in ((-1, math.ceil(base)), (0, 1), (1, 1)) for cell in range(-far, far + 1)]


def _grid(boxes: DataFrame, keys: Sequence[str], threshold: float, order: str) -> DataFrame:
    """Suppression in rounds.

    Two boxes that overlap by more than t have sides that differ by less than a factor 1/t, so with size classes by powers
    of that, or of two if it is more, they are in the same or in adjoining classes. Their centres are less than (1 - t)
    times the larger side apart; with cells of that size, one grid for each size class, a partner is few cells away. In each round the best box of a cell is kept if no undecided box that may be its partner is better, and it
    removes the boxes it covers. A round moves one box per cell and never pairs the boxes of a frame with each other, and
    a few large boxes do not widen the cells of the others.
    """
    base = max(2.0, 1 / threshold)
    shared_folder(boxes.sparkSession)
    names = boxes.columns
    cell = ["_sx", "_sy", "_cx", "_cy"]

    def size_class(side: Column) -> Column:
        return F.floor(F.log(base, F.greatest(side.cast("double"), F.lit(1e-9)))).cast("int")

    def cell_of(middle: Column, size: Column) -> Column:
        return F.floor(middle / (F.pow(F.lit(base), size + 1) * (1 - threshold)))

    placed = boxes.withColumns({
        "_mx": (F.col("x1") + F.col("x2")) / 2, "_my": (F.col("y1") + F.col("y2")) / 2,
        "_sx": size_class(F.col("x2") - F.col("x1")), "_sy": size_class(F.col("y2") - F.col("y1")),
        "_rank": F.struct(F.col("confidence").alias("c"), (-F.col(order)).alias("o"))})
    undecided = placed.withColumns({"_cx": cell_of(F.col("_mx"), F.col("_sx")), "_cy": cell_of(F.col("_my"), F.col("_sy"))})

    def spread(tops: DataFrame) -> DataFrame:
        """Each top box at all cells that may hold partners of it."""
        across = tops.select(*keys, "_top", F.explode(F.array(*_reach("x", base))).alias("_x"))
        both = across.select(*keys, "_top", "_x", F.explode(F.array(*_reach("y", base))).alias("_y"))
        sx, sy = F.col("_top._sx") + F.col("_x.xs"), F.col("_top._sy") + F.col("_y.ys")
        return both.select(*keys, "_top", sx.alias("_sx"), sy.alias("_sy"),
                           (cell_of(F.col("_top._mx"), sx) + F.col("_x.xc")).alias("_cx"),
                           (cell_of(F.col("_top._my"), sy) + F.col("_y.yc")).alias("_cy"))

    kept = None
    while True:
        undecided = undecided.checkpoint()
        if undecided.isEmpty():
            break
        best = F.max_by(F.struct(*names, "_rank", "_mx", "_my", "_sx", "_sy"), F.col("_rank"))
        tops = undecided.groupBy(*keys, *cell).agg(best.alias("_top"))
        seen = spread(tops).groupBy(*keys, *cell).agg(F.max("_top._rank").alias("_best"))
        winners = tops.join(seen, [*keys, *cell]).filter(F.col("_top._rank") == F.col("_best")).drop("_best").checkpoint()
        chosen = winners.select(*[F.col(f"_top.{n}").alias(n) for n in names])
        kept = chosen if kept is None else kept.unionByName(chosen)
        # Winners are no partners of each other, so a cell hears of a bounded number.
        heard = spread(winners).groupBy(*keys, *cell).agg(F.collect_list("_top").alias("_winners"))
        here = F.struct(*[F.col(n) for n in ("x1", "y1", "x2", "y2")])
        gone = F.exists("_winners", lambda w: (w[order] == F.col(order)) | (geometry.overlap(w, here) > threshold))
        undecided = undecided.join(heard, [*keys, *cell], "left").filter(~F.coalesce(gone, F.lit(False))).drop("_winners")
    return boxes.limit(0) if kept is None else kept


def detections_to_events(boxes: DataFrame, frame_width: int, order: str = "event_id", **suppression) -> DataFrame:
    """Event rows from boxes with tracker numbers: confidence, zone, suppression, speed on the plane, type, heading."""
    found = suppress(in_zone(confident(boxes)), order=order, **suppression)
    x = ((F.col("x1") + F.col("x2")) / 2)
    placed = found.withColumn("_plane_y", geometry.perspective(x, F.col("y2"))[1])
    timed = trailing_speed(placed, ("video_id", "tracker_id"), ("frame_id", order), "_plane_y", sized=boxes)
    return timed.select(
        order, "video_id", "frame_id", "timestamp", F.col("tracker_id").alias("car_id"),
        x.cast("long").alias("position_x"), F.col("y2").cast("long").alias("position_y"),
        F.col("speed").alias("estimated_speed_kmh"), display.class_name(F.col("class_id")).alias("vehicle_type"),
        geometry.direction(x.cast("long"), frame_width).alias("direction"), "processing_datetime",
    )
