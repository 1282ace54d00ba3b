"""Traffic analytics over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import traffic as t
from tallyloom.plans import bindings as b
from tallyloom.plans.book import BOOK

TRAFFIC = "WITH " + b.TRAFFIC_SQL
VEHICLES = "WITH " + b.VEHICLES_SQL

FIGURES_SQL = VEHICLES + f""", raw AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE vehicle_type = 'car') AS cars, count(*) FILTER (WHERE vehicle_type = 'truck') AS trucks,
         CAST(sum(sightings) AS BIGINT) AS events, CAST(sum(max_speed) AS DOUBLE) / count(max_speed) AS mean_speed,
         max(max_speed) AS max_speed, min(max_speed) AS min_speed, stddev_samp(max_speed) AS std,
         count(*) FILTER (WHERE max_speed > {t.SPEED_LIMIT}) AS violations,
         max(max_speed) FILTER (WHERE vehicle_type = 'car') AS car_max, max(max_speed) FILTER (WHERE vehicle_type = 'truck') AS truck_max,
         avg(max_speed) FILTER (WHERE vehicle_type = 'car') AS car_avg, avg(max_speed) FILTER (WHERE vehicle_type = 'truck') AS truck_avg,
         count(*) FILTER (WHERE direction = 'in') AS came, count(*) FILTER (WHERE direction = 'out') AS went,
         count(*) FILTER (WHERE direction = 'stationary') AS still
  FROM vehicles), figures AS (
  SELECT n AS total_vehicles, cars AS total_cars, trucks AS total_trucks, events AS total_events,
         round_even(events::DOUBLE / n, 1) AS events_per_vehicle, round_even(cars::DOUBLE / n * 100, 1) AS car_percentage,
         round_even(trucks::DOUBLE / n * 100, 1) AS truck_percentage, round_even(mean_speed, 1) AS avg_speed, max_speed, min_speed,
         round_even(std, 1) AS speed_std,
         round_even(n / ((SELECT max(frame_id) - min(frame_id) + 1 FROM traffic)::DOUBLE / 30 / 60), 1) AS vehicles_per_minute,
         round_even(events::DOUBLE / n / 30, 1) AS avg_vehicle_duration, violations AS speed_violations,
         round_even(violations::DOUBLE / n * 100, 1) AS speed_violation_rate,
         CASE WHEN car_max IS NOT NULL AND truck_max IS NOT NULL THEN CASE WHEN car_max > truck_max THEN 'car' ELSE 'truck' END
              WHEN cars > 0 THEN 'car' WHEN trucks > 0 THEN 'truck' ELSE 'N/A' END AS fastest_vehicle_type,
         CASE WHEN car_max IS NOT NULL AND truck_max IS NOT NULL THEN CASE WHEN car_avg < truck_avg THEN 'car' ELSE 'truck' END
              WHEN cars > 0 THEN 'car' WHEN trucks > 0 THEN 'truck' ELSE 'N/A' END AS slowest_vehicle_type,
         came AS vehicles_in, went AS vehicles_out, still AS vehicles_stationary,
         CASE WHEN went > 0 THEN round_even(came::DOUBLE / went, 2) WHEN came > 0 THEN 'inf'::DOUBLE ELSE 0.0 END AS in_out_ratio,
         CASE WHEN came > went THEN 'More vehicles going IN' WHEN went > came THEN 'More vehicles going OUT'
              ELSE 'Balanced traffic flow' END AS direction_balance
  FROM raw)"""


def _vehicles(spark, folder):
    return t.vehicle_table(b.traffic(spark, folder))


def _block(name, columns):
    @BOOK.add(name, FIGURES_SQL + f" SELECT {', '.join(columns)} FROM figures")
    def query(spark, folder):
        return t.figures(_vehicles(spark, folder)).select(*columns)
    return query


_block("traffic_counts", t.COUNT_BLOCK)
_block("traffic_speed", t.SPEED_BLOCK)
_block("traffic_flow_stats", t.FLOW_BLOCK)
_block("type_extremes", t.TYPE_BLOCK)
_block("direction_stats", t.DIRECTION_BLOCK)

SUMMARY_SQL = FIGURES_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{label}' AS metric, CAST({name} AS VARCHAR) AS value FROM figures" for name, label in t.METRICS.items())


@BOOK.add("traffic_summary", SUMMARY_SQL)
def traffic_summary(spark, folder):
    return t.summary(b.traffic(spark, folder))


@BOOK.add("vehicle_max_speed", VEHICLES + " SELECT car_id, max_speed FROM vehicles")
def vehicle_max_speed(spark, folder):
    return t.vehicle_rows(b.traffic(spark, folder)).select("car_id", "max_speed")


@BOOK.add("vehicle_first_last", VEHICLES + " SELECT car_id, vehicle_type, direction FROM vehicles")
def vehicle_first_last(spark, folder):
    return _vehicles(spark, folder).select("car_id", "vehicle_type", "direction")


@BOOK.add("vehicle_duration", VEHICLES + " SELECT car_id, sightings, round(sightings / 30.0::DOUBLE, 4) AS seconds FROM vehicles")
def vehicle_duration(spark, folder):
    rows = t.vehicle_rows(b.traffic(spark, folder))
    return rows.select("car_id", "sightings", F.round(F.col("sightings") / F.lit(30.0), 4).alias("seconds"))


@BOOK.add("vehicle_aligned", VEHICLES + " SELECT car_id, max_speed, vehicle_type, sightings FROM vehicles")
def vehicle_aligned(spark, folder):
    return _vehicles(spark, folder).select("car_id", "max_speed", "vehicle_type", "sightings")


@BOOK.add("type_distribution", VEHICLES + ' SELECT vehicle_type, count(*) AS "count" FROM vehicles GROUP BY 1')
def type_distribution(spark, folder):
    return t.value_counts(_vehicles(spark, folder), "vehicle_type")


@BOOK.add("direction_distribution", VEHICLES + ' SELECT direction, count(*) AS "count" FROM vehicles GROUP BY 1')
def direction_distribution(spark, folder):
    return t.value_counts(_vehicles(spark, folder), "direction")


@BOOK.add("speed_histogram", VEHICLES + """, span AS (SELECT min(max_speed) AS low, max(max_speed) AS high,
  (max(max_speed) - min(max_speed))::DOUBLE / 20 AS width FROM vehicles)
SELECT CAST(bin AS INTEGER) AS bin, round(low + bin * width, 4) AS bin_start, round(low + (bin + 1) * width, 4) AS bin_end, count(*) AS "count"
FROM (SELECT low, width, CASE WHEN width = 0 THEN 0 ELSE least(floor((max_speed - low) / width), 19) END AS bin FROM vehicles, span)
GROUP BY low, width, bin""")
def speed_histogram(spark, folder):
    return t.speed_histogram(t.vehicle_rows(b.traffic(spark, folder)))


@BOOK.add("speed_bands", VEHICLES + """
SELECT * FROM (SELECT CASE WHEN max_speed > 0 AND max_speed <= 80 THEN 'Slow (0-80)' WHEN max_speed > 80 AND max_speed <= 100 THEN 'Normal (80-100)'
            WHEN max_speed > 100 AND max_speed <= 130 THEN 'Fast (100-130)' WHEN max_speed > 130 THEN 'Speeding (>130)' END AS speed_category,
       vehicle_type, count(*) AS "count" FROM vehicles GROUP BY ALL) WHERE speed_category IS NOT NULL""")
def speed_bands(spark, folder):
    return t.speed_bands(_vehicles(spark, folder))


@BOOK.add("speed_box", VEHICLES + """, box AS (
  SELECT vehicle_type, quantile_cont(max_speed, 0.25) AS q1, quantile_cont(max_speed, 0.5) AS median, quantile_cont(max_speed, 0.75) AS q3,
         min(max_speed) AS lowest, max(max_speed) AS highest, count(*) AS vehicles FROM vehicles GROUP BY vehicle_type)
SELECT b.vehicle_type, q1::DOUBLE AS q1, median::DOUBLE AS median, q3::DOUBLE AS q3, lowest, highest, vehicles,
       min(max_speed) FILTER (WHERE max_speed BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS lower_fence,
       max(max_speed) FILTER (WHERE max_speed BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS upper_fence
FROM box b JOIN vehicles v ON b.vehicle_type = v.vehicle_type GROUP BY ALL""")
def speed_box(spark, folder):
    return t.speed_box(_vehicles(spark, folder))


@BOOK.add("valid_guard", TRAFFIC + """
SELECT bool_or(direction <> '' AND direction <> 'unknown') AS has_direction, bool_or("timestamp" > 0) AS has_time FROM traffic""")
def valid_guard(spark, folder):
    return t.valid_guard(b.traffic(spark, folder))


@BOOK.add("direction_over_time", TRAFFIC + """
SELECT CAST(round_even(frame_id / 30.0::DOUBLE, 0) * 30 AS BIGINT) AS frame_interval, direction, count(*) AS "count" FROM traffic GROUP BY ALL""")
def direction_over_time(spark, folder):
    return t.direction_over_time(b.traffic(spark, folder))


@BOOK.add("flow_over_time", TRAFFIC + " SELECT frame_id, count(*) AS vehicle_count FROM traffic GROUP BY 1")
def flow_over_time(spark, folder):
    return t.flow_over_time(b.traffic(spark, folder))


@BOOK.add("speed_over_time", TRAFFIC + " SELECT frame_id, round(avg(estimated_speed_kmh), 4) AS avg_speed FROM traffic GROUP BY 1")
def speed_over_time(spark, folder):
    return t.speed_over_time(b.traffic(spark, folder))


FLOW = TRAFFIC + ", flow AS (SELECT frame_id, count(*) AS vehicle_count FROM traffic GROUP BY 1)"


@BOOK.add("traffic_trend", FLOW + """
SELECT round(regr_slope(vehicle_count, frame_id), 6) AS slope, round(regr_intercept(vehicle_count, frame_id), 4) AS intercept,
       round(regr_r2(vehicle_count, frame_id), 6) AS r2, count(*) AS points FROM flow HAVING count(*) >= 3""")
def traffic_trend(spark, folder):
    line = t.trend(t.flow_over_time(b.traffic(spark, folder)))
    return line.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"),
                       F.round("r2", 6).alias("r2"), "points")


@BOOK.add("traffic_forecast", FLOW + """, line AS (
  SELECT regr_slope(vehicle_count, frame_id) AS slope, regr_intercept(vehicle_count, frame_id) AS intercept, max(frame_id) AS last_x,
         greatest(1, CAST(floor((max(frame_id) - min(frame_id)) * 0.25) AS BIGINT)) AS steps FROM flow)
SELECT frame_id, CAST(vehicle_count AS DOUBLE) AS vehicle_count, 'Historical' AS type FROM flow
UNION ALL
SELECT x AS frame_id, round(intercept + slope * x, 4) AS vehicle_count, 'Forecast' AS type
FROM (SELECT slope, intercept, unnest(range(last_x + 1, last_x + steps + 1)) AS x FROM line)""")
def traffic_forecast(spark, folder):
    return t.forecast(b.traffic(spark, folder)).withColumn("vehicle_count", F.round("vehicle_count", 4))


SPEED_SQL = """SELECT event_id, video_id, car_id, frame_id,
       CAST(CASE WHEN count(*) OVER w < 5 THEN 0
            ELSE trunc(abs(position_y - first_value(position_y) OVER w)::DOUBLE / (count(*) OVER w / 30.0::DOUBLE) * 3.6::DOUBLE) END AS BIGINT) AS speed
FROM traffic WINDOW w AS (PARTITION BY video_id, car_id ORDER BY event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""


@BOOK.add("vehicle_speed", TRAFFIC + " " + SPEED_SQL)
def vehicle_speed(spark, folder):
    rows = b.traffic(spark, folder).select("event_id", "video_id", "car_id", "frame_id", "position_y")
    return t.trailing_speed(rows).drop("position_y")


@BOOK.add("metric_diff", """
WITH named AS (SELECT p_brand || ' ' || split_part(p_type, ' ', 1) || ' ' || p_size % 10 AS metric, p_size < 25 AS expected FROM part),
sides AS (SELECT metric, bool_or(expected) AS e, bool_or(NOT expected) AS a FROM named GROUP BY 1)
SELECT metric, CASE WHEN e THEN 'missing' ELSE 'unexpected' END AS problem FROM sides WHERE e <> a""")
def metric_diff(spark, folder):
    """Small parts name what is expected, all others what is there."""
    metric = F.concat_ws(" ", "p_brand", F.split("p_type", " ")[0], F.col("p_size") % 10).alias("metric")
    part = b.table(spark, folder, "part")
    return t.metric_difference(part.filter("p_size < 25").select(metric), part.filter("p_size >= 25").select(metric))


# Questions

@BOOK.add("q_average_speed", TRAFFIC + " SELECT round(avg(estimated_speed_kmh), 4) AS avg_speed FROM traffic")
def q_average_speed(spark, folder):
    return t.average_speed(b.traffic(spark, folder))


_block("q_violations", ("speed_violations", "speed_violation_rate"))


@BOOK.add("q_type_distribution", VEHICLES + """
SELECT vehicle_type, count(*) AS "count" FROM vehicles WHERE vehicle_type IN ('car', 'truck') GROUP BY 1""")
def q_type_distribution(spark, folder):
    return t.value_counts(_vehicles(spark, folder).filter(F.col("vehicle_type").isin("car", "truck")), "vehicle_type")


@BOOK.add("q_fastest_vehicle", TRAFFIC + """
SELECT event_id, video_id, car_id, estimated_speed_kmh, vehicle_type, direction FROM traffic
ORDER BY estimated_speed_kmh DESC, event_id LIMIT 1""")
def q_fastest_vehicle(spark, folder):
    rows = b.traffic(spark, folder).select(
        "event_id", "video_id", "car_id", "estimated_speed_kmh", "vehicle_type", "direction")
    return t.fastest_vehicle(rows)


@BOOK.add("q_max_per_entity", TRAFFIC + """
SELECT max(n) AS max_events FROM (SELECT count(*) AS n FROM traffic WHERE vehicle_type = 'truck' GROUP BY video_id, car_id)""")
def q_max_per_entity(spark, folder):
    return t.max_per_entity(b.traffic(spark, folder), "video_id", "car_id", "vehicle_type", "truck")


@BOOK.add("q_avg_per_entity", TRAFFIC + " SELECT car_id, round(avg(estimated_speed_kmh), 4) AS avg_speed FROM traffic GROUP BY 1")
def q_avg_per_entity(spark, folder):
    return t.average_per_entity(b.traffic(spark, folder), "car_id")


@BOOK.add("q_event_types", TRAFFIC + " SELECT DISTINCT vehicle_type FROM traffic")
def q_event_types(spark, folder):
    return t.distinct_values(b.traffic(spark, folder), "vehicle_type")


@BOOK.add("q_weekly_share", TRAFFIC + """, daily AS (
  SELECT CAST(processing_datetime AS DATE) AS day, video_id, count(*) AS n FROM traffic GROUP BY ALL),
shares AS (SELECT day, video_id, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY day) AS share FROM daily)
SELECT CAST(date_trunc('week', day) AS DATE) AS week, video_id, round(avg(share), 4) AS avg_share FROM shares GROUP BY ALL""")
def q_weekly_share(spark, folder):
    return t.weekly_share(b.traffic(spark, folder), "video_id", "processing_datetime")
