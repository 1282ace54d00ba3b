"""Frame geometry: zones, overlap, perspective, direction of travel."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[float, float]

# The road trapezoid in the frame and the plane it maps to.
ROAD_ZONE: tuple[Point, ...] = ((1252, 787), (2298, 803), (5039, 2159), (-550, 2159))
ROAD_PLANE: tuple[Point, ...] = ((0, 0), (24, 0), (24, 249), (0, 249))


def direction(x: Column, frame_width: int) -> Column:
    """Which half of the frame a vehicle is in; the middle is a whole number of pixels."""
    return F.when(x < F.lit(frame_width // 2), F.lit("in")).otherwise(F.lit("out"))


def in_polygon(x: Column, y: Column, vertices: Sequence[Point] = ROAD_ZONE) -> Column:
    """Ray casting: a point is inside when a ray to the right crosses an odd number of edges."""
    crossings = []
    for (ax, ay), (bx, by) in zip(vertices, list(vertices[1:]) + [vertices[0]]):
        if ay == by:
            continue
        straddles = (F.lit(float(ay)) > y) != (F.lit(float(by)) > y)
        cut = F.lit(float(ax)) + (y - F.lit(float(ay))) * F.lit((bx - ax) / (by - ay))
        crossings.append(F.when(straddles & (x < cut), 1).otherwise(0))
    return reduce(lambda a, b: a + b, crossings) % 2 == 1


def perspective_coefficients(source: Sequence[Point] = ROAD_ZONE, target: Sequence[Point] = ROAD_PLANE) -> list[float]:
    """The eight numbers of the plane-to-plane map that takes four points to four others."""
    rows, values = [], []
    for (x, y), (u, v) in zip(source, target):
        rows.append([x, y, 1, 0, 0, 0, -u * x, -u * y])
        rows.append([0, 0, 0, x, y, 1, -v * x, -v * y])
        values += [u, v]
    return [float(c) for c in np.linalg.solve(np.array(rows, dtype=float), np.array(values, dtype=float))]


def perspective(x: Column, y: Column, coefficients: Sequence[float] | None = None) -> tuple[Column, Column]:
    """Mapped x and y, cut to whole numbers towards zero."""
    a, b, c, d, e, f, g, h = (F.lit(v) for v in (coefficients or perspective_coefficients()))
    depth = g * x + h * y + F.lit(1.0)
    return ((a * x + b * y + c) / depth).cast("long"), ((d * x + e * y + f) / depth).cast("long")


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes held as structs with x1, y1, x2, y2."""
    zero = F.lit(0.0)
    across = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), zero)
    down = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), zero)
    shared = across * down
    area_a = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])
    area_b = (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    union = area_a + area_b - shared
    return F.when(union > zero, shared / union).otherwise(zero)
