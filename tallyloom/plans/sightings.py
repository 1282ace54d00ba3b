"""Detections over the events table."""

from __future__ import annotations

from tallyloom.functions import geometry
from tallyloom.operators import detections as d
from tallyloom.plans import bindings as b
from tallyloom.plans.book import BOOK

DETECTIONS = "WITH " + b.DETECTIONS_SQL
BOX = "event_id, video_id, frame_id, class_id, x1, y1, x2, y2, confidence"


def _inside_sql(x: str, y: str) -> str:
    points = geometry.ROAD_ZONE
    edges = []
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        if ay != by:
            edges.append(f"CASE WHEN ({ay} > {y}) <> ({by} > {y}) AND {x} < {ax}::DOUBLE + ({y} - {ay}) * {(bx - ax) / (by - ay)!r}::DOUBLE "
                         "THEN 1 ELSE 0 END")
    return "(" + " + ".join(edges) + ") % 2 = 1"


def _overlap_sql(a: str, c: str) -> str:
    across = f"greatest(least({a}.x2, {c}.x2) - greatest({a}.x1, {c}.x1), 0)"
    down = f"greatest(least({a}.y2, {c}.y2) - greatest({a}.y1, {c}.y1), 0)"
    area = " + ".join(f"({v}.x2 - {v}.x1) * ({v}.y2 - {v}.y1)" for v in (a, c))
    return f"({across} * {down}) / ({area} - {across} * {down})"


def _kept_sql(source: str) -> str:
    """Greedy suppression as a fold over the boxes of a frame; each box is a list of its own so that lists add up."""
    return f"""
  SELECT unnest(list_reduce(boxes, lambda kept, one: CASE WHEN len(list_filter(kept, lambda k: {_overlap_sql('k', 'one[1]')} > 0.7)) > 0
                                                THEN kept ELSE list_concat(kept, one) END)) AS box
  FROM (SELECT list([r] ORDER BY r.confidence DESC, r.event_id) AS boxes
        FROM {source} AS r GROUP BY r.video_id, r.frame_id, r.class_id)"""


@BOOK.add("detections_confident", DETECTIONS + f" SELECT {BOX} FROM detections WHERE confidence > 0.3")
def detections_confident(spark, folder):
    return d.confident(b.detections(spark, folder)).select(*BOX.split(", "))


@BOOK.add("detections_in_zone", DETECTIONS + f" SELECT {BOX} FROM detections WHERE {_inside_sql('((x1 + x2) / 2)', 'y2')}")
def detections_in_zone(spark, folder):
    return d.in_zone(b.detections(spark, folder)).select(*BOX.split(", "))


@BOOK.add("detections_nms", DETECTIONS + f", kept AS ({_kept_sql('detections')}) SELECT {', '.join(f'box.{c}' for c in BOX.split(', '))} FROM kept")
def detections_nms(spark, folder):
    return d.suppress(b.detections(spark, folder)).select(*BOX.split(", "))


_COEF = [repr(v) + "::DOUBLE" for v in geometry.perspective_coefficients()]
_PLANE_Y = "CAST(trunc(({d} * x + {e} * y2 + {f}) / ({g} * x + {h} * y2 + 1.0::DOUBLE)) AS BIGINT)".format(
    d=_COEF[3], e=_COEF[4], f=_COEF[5], g=_COEF[6], h=_COEF[7])


@BOOK.add("detections_to_events", DETECTIONS + f""", usable AS (
  SELECT * FROM detections WHERE confidence > 0.3 AND {_inside_sql('((x1 + x2) / 2)', 'y2')}),
kept AS ({_kept_sql('usable')}), flat AS (SELECT box.*, (box.x1 + box.x2) / 2 AS x FROM kept),
placed AS (SELECT *, {_PLANE_Y} AS plane_y FROM flat)
SELECT event_id, video_id, frame_id, "timestamp", tracker_id AS car_id, CAST(trunc(x) AS BIGINT) AS position_x, CAST(y2 AS BIGINT) AS position_y,
       CAST(CASE WHEN count(*) OVER w < 5 THEN 0
            ELSE trunc(abs(plane_y - first_value(plane_y) OVER w)::DOUBLE / (count(*) OVER w / 30.0::DOUBLE) * 3.6::DOUBLE) END AS BIGINT) AS estimated_speed_kmh,
       CASE WHEN class_id = 7 THEN 'truck' ELSE 'car' END AS vehicle_type,
       CASE WHEN trunc(x) < {b.FRAME_WIDTH // 2} THEN 'in' ELSE 'out' END AS direction, processing_datetime
FROM placed WINDOW w AS (PARTITION BY video_id, tracker_id ORDER BY frame_id, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def detections_to_events(spark, folder):
    return d.detections_to_events(b.detections(spark, folder), b.FRAME_WIDTH)
