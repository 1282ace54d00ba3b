"""How the star-schema tables stand in for flights, traffic, chat and customers.

Every binding is given twice, as a DataFrame and as the SQL text of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.geometry import direction

FRAME_WIDTH = 3840
FRAME_HEIGHT = 2160
CARS = 1999
ACTIVE = ("O", "P")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Flights: one per order, leaving from the nation of the customer.

def flights(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("flight_id"),
            F.col("o_orderpriority").alias("airline"),
            F.col("n_name").alias("origin"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderdate").alias("departure_time"),
        )
    )


FLIGHTS_SQL = """flights AS (
  SELECT o_orderkey AS flight_id, o_orderpriority AS airline, n_name AS origin,
         o_orderstatus AS status, o_orderdate AS departure_time
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


# Passengers: one per line, bound for the nation of the supplier.

def passengers(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    supplier = table(spark, folder, "supplier")
    nation = table(spark, folder, "nation")
    return (
        line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("l_orderkey").alias("flight_id"),
            F.col("l_partkey").cast("string").alias("passport_id"),
            F.col("l_returnflag").alias("class"),
            F.col("l_extendedprice").cast("decimal(10,2)").alias("ticket_price"),
            F.col("n_name").alias("destination"),
            F.col("l_shipdate").alias("left_at"),
        )
    )


def bookings(spark: SparkSession, folder: str) -> DataFrame:
    """Passengers without the destination, straight from the line table."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("flight_id"),
        F.col("l_partkey").cast("string").alias("passport_id"),
        F.col("l_returnflag").alias("class"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("ticket_price"),
    )


PASSENGERS_SQL = """passengers AS (
  SELECT l_orderkey AS flight_id, CAST(l_partkey AS VARCHAR) AS passport_id, l_returnflag AS class,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS ticket_price, n_name AS destination, l_shipdate AS left_at
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def departures(spark: SparkSession, folder: str) -> DataFrame:
    """Flights with a delay: days from order to shipment of each line, half of them negative."""
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate")
    flown = flights(spark, folder)
    return line.join(flown, F.col("l_orderkey") == F.col("flight_id")).select(
        "flight_id", "airline", "origin", "status",
        F.date_diff("l_shipdate", "departure_time").alias("delay_minutes"),
    )


DEPARTURES_SQL = FLIGHTS_SQL + """, departures AS (
  SELECT flight_id, airline, origin, status,
         date_diff('day', CAST(departure_time AS DATE), CAST(l_shipdate AS DATE)) AS delay_minutes
  FROM lineitem JOIN flights ON l_orderkey = flight_id)"""


# Traffic: one vehicle sighting per event.

def traffic(spark: SparkSession, folder: str) -> DataFrame:
    return traffic_rows(table(spark, folder, "events"))


def traffic_rows(events: DataFrame) -> DataFrame:
    car = F.col("event_id") % CARS
    frame = (F.col("ts") - F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).cast("interval hour")
    kind = (
        F.when(F.col("event_type").isin("click", "view"), F.lit("car"))
        .when(F.col("event_type") == "purchase", F.lit("truck"))
        .otherwise(F.col("event_type"))
    )
    sighted = events.select(
        "event_id",
        F.concat(F.lit("v"), (car % 3).cast("string")).alias("video_id"),
        frame.cast("long").alias("frame_id"),
        car.alias("car_id"),
        ((F.col("event_id") * 37) % FRAME_WIDTH).alias("position_x"),
        ((F.col("event_id") * 53) % FRAME_HEIGHT).alias("position_y"),
        F.floor("value").cast("long").alias("estimated_speed_kmh"),
        kind.alias("vehicle_type"),
        F.col("ts").alias("processing_datetime"),
    )
    return sighted.select(
        "*",
        (F.col("frame_id") / F.lit(30.0)).alias("timestamp"),
        direction(F.col("position_x"), FRAME_WIDTH).alias("direction"),
    )


TRAFFIC_SQL = f"""traffic AS (
  SELECT event_id, 'v' || CAST((event_id % {CARS}) % 3 AS VARCHAR) AS video_id,
         date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS frame_id,
         event_id % {CARS} AS car_id,
         (event_id * 37) % {FRAME_WIDTH} AS position_x, (event_id * 53) % {FRAME_HEIGHT} AS position_y,
         CAST(floor(value) AS BIGINT) AS estimated_speed_kmh,
         CASE WHEN event_type IN ('click', 'view') THEN 'car' WHEN event_type = 'purchase' THEN 'truck'
              ELSE event_type END AS vehicle_type,
         ts AS processing_datetime,
         date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) / 30.0::DOUBLE AS "timestamp",
         CASE WHEN (event_id * 37) % {FRAME_WIDTH} < {FRAME_WIDTH // 2} THEN 'in' ELSE 'out' END AS direction
  FROM events)"""

VEHICLES_SQL = TRAFFIC_SQL + """, vehicles AS (
  SELECT car_id, max(estimated_speed_kmh) AS max_speed, count(*) AS sightings,
         arg_min(vehicle_type, event_id) FILTER (WHERE vehicle_type IS NOT NULL) AS vehicle_type,
         arg_max(direction, event_id) FILTER (WHERE direction IS NOT NULL) AS direction
  FROM traffic GROUP BY car_id)"""


# Detections: a box around each sighting, all arithmetic on the event id.

def detections(spark: SparkSession, folder: str) -> DataFrame:
    return detection_rows(traffic(spark, folder))


def detection_rows(sightings: DataFrame) -> DataFrame:
    """Boxes drawn to twelve places of the picture with some jitter, so that those of a frame overlap in chains."""
    key = F.col("event_id")
    x = F.col("position_x") - F.col("position_x") % 960 + 480 + (key * 13) % 90
    y = F.col("position_y") - F.col("position_y") % 720 + 640 + (key * 29) % 60
    width = (F.lit(400) + (key * 7) % 60).cast("double")
    height = (F.lit(300) + (key * 11) % 40).cast("double")
    class_id = F.when(F.col("vehicle_type") == "truck", F.lit(7)).otherwise(F.lit(2))
    return sightings.select(
        "event_id", "video_id", "frame_id", "timestamp",
        (x - width / 2).alias("x1"), (y - height).alias("y1"),
        (x + width / 2).alias("x2"), y.cast("double").alias("y2"),
        (((key * 17) % 100) / F.lit(100.0)).alias("confidence"),
        class_id.alias("class_id"),
        F.col("car_id").alias("tracker_id"),
        "processing_datetime",
    )


DETECTIONS_SQL = TRAFFIC_SQL + """, drawn AS (
  SELECT *, position_x - position_x % 960 + 480 + (event_id * 13) % 90 AS px, position_y - position_y % 720 + 640 + (event_id * 29) % 60 AS py FROM traffic),
detections AS (
  SELECT event_id, video_id, frame_id, "timestamp",
         px - (400 + (event_id * 7) % 60)::DOUBLE / 2 AS x1,
         py - (300 + (event_id * 11) % 40)::DOUBLE AS y1,
         px + (400 + (event_id * 7) % 60)::DOUBLE / 2 AS x2,
         py::DOUBLE AS y2,
         ((event_id * 17) % 100) / 100.0::DOUBLE AS confidence,
         CASE WHEN vehicle_type = 'truck' THEN 7 ELSE 2 END AS class_id,
         car_id AS tracker_id, processing_datetime
  FROM drawn)"""


# Churn: customers in debt.

def customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer")


# Chat: scenario by conversation number, markers that some replies contain.

SCENARIOS = ("COMPANY_IPO", "CARPET_SALE", "HOMEWORK")
WON_MARK = "eau"
LOST_MARK = "thou"


def turns(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in SCENARIOS])
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", "text",
        F.element_at(names, (F.col("conv_id") % len(SCENARIOS) + 1).cast("int")).alias("scenario"),
    )


TURNS_SQL = f"""turns AS (
  SELECT conv_id, turn, role, "text",
         CASE conv_id % 3 WHEN 0 THEN '{SCENARIOS[0]}' WHEN 1 THEN '{SCENARIOS[1]}' ELSE '{SCENARIOS[2]}' END AS scenario
  FROM conversations)"""
