"""Report pack, scans, sorts and set operations over the trips binding."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.operators import reports
from tallyloom.plans import bindings as b
from tallyloom.plans.book import BOOK
from tallyloom.sources import generate, tables, versions
from tallyloom.session import work_path

WITH_FLIGHTS = "WITH " + b.FLIGHTS_SQL
WITH_TRIPS = "WITH " + b.FLIGHTS_SQL + ", " + b.PASSENGERS_SQL
WITH_DEPARTURES = "WITH " + b.DEPARTURES_SQL
PRICE = "CAST(l_extendedprice AS DECIMAL(10,2))"


@BOOK.add("kpi_counts", """
SELECT (SELECT count(*) FROM orders) AS total_flights, (SELECT count(*) FROM lineitem) AS total_passengers,
       (SELECT count(*) FROM nation) AS total_airports""")
def kpi_counts(spark, folder):
    orders = b.table(spark, folder, "orders")
    return reports.kpi_counts(orders, b.table(spark, folder, "lineitem"), b.table(spark, folder, "nation"))


@BOOK.add("active_count", "SELECT count(*) AS active_flights FROM orders WHERE o_orderstatus IN ('O', 'P')")
def active_count(spark, folder):
    return reports.active_count(_plain_flights(spark, folder), b.ACTIVE)


def _plain_flights(spark, folder):
    """Flights without the origin, which needs no join."""
    return b.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("flight_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("airline"))


@BOOK.add("kpi_revenue", f"SELECT coalesce(CAST(sum({PRICE}) AS DOUBLE), 0.0) AS total_revenue FROM lineitem")
def kpi_revenue(spark, folder):
    return reports.kpi_revenue(b.bookings(spark, folder))


@BOOK.add("kpi_avg_price", f"""
SELECT round(coalesce(CAST(sum({PRICE}) AS DOUBLE) / count({PRICE}), 0.0), 4) AS avg_ticket_price FROM lineitem""")
def kpi_avg_price(spark, folder):
    return reports.kpi_avg_price(b.bookings(spark, folder))


@BOOK.add("kpi_summary", f"""
SELECT f.total_flights, p.total_passengers, f.active_flights, a.total_airports, p.total_revenue, p.avg_ticket_price
FROM (SELECT count(*) AS total_flights, count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS active_flights FROM orders) f,
     (SELECT count(*) AS total_passengers, coalesce(CAST(sum({PRICE}) AS DOUBLE), 0.0) AS total_revenue,
             round(coalesce(CAST(sum({PRICE}) AS DOUBLE) / count({PRICE}), 0.0), 4) AS avg_ticket_price FROM lineitem) p,
     (SELECT count(*) AS total_airports FROM nation) a""")
def kpi_summary(spark, folder):
    return reports.kpi_summary(
        _plain_flights(spark, folder), b.bookings(spark, folder), b.table(spark, folder, "nation"), b.ACTIVE)


@BOOK.add("status_distribution", 'SELECT o_orderstatus AS status, count(*) AS "count" FROM orders GROUP BY 1')
def status_distribution(spark, folder):
    return reports.distribution(_plain_flights(spark, folder), "status")


@BOOK.add("class_distribution", 'SELECT l_returnflag AS class, count(*) AS "count" FROM lineitem GROUP BY 1')
def class_distribution(spark, folder):
    return reports.distribution(b.bookings(spark, folder), "class")


@BOOK.add("top_airports", WITH_FLIGHTS + """
SELECT origin AS airport, count(*) AS "count" FROM flights GROUP BY origin ORDER BY 2 DESC, 1 LIMIT 10""")
def top_airports(spark, folder):
    return reports.top_airports(b.flights(spark, folder))


@BOOK.add("top_airlines", WITH_TRIPS + """
SELECT f.airline, count(p.passport_id) AS "count" FROM flights f JOIN passengers p ON f.flight_id = p.flight_id
GROUP BY f.airline ORDER BY 2 DESC, 1 LIMIT 10""")
def top_airlines(spark, folder):
    return reports.top_airlines(_plain_flights(spark, folder), b.bookings(spark, folder))


@BOOK.add("revenue_by_class", f"""
SELECT l_returnflag AS class, CAST(sum({PRICE}) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1""")
def revenue_by_class(spark, folder):
    return reports.revenue_by_class(b.bookings(spark, folder))


@BOOK.add("revenue_by_airline", WITH_TRIPS + """
SELECT f.airline, CAST(sum(p.ticket_price) AS DOUBLE) AS revenue
FROM flights f JOIN passengers p ON f.flight_id = p.flight_id GROUP BY f.airline""")
def revenue_by_airline(spark, folder):
    return reports.revenue_by_airline(_plain_flights(spark, folder), b.bookings(spark, folder))


TOP_ROUTES_SQL = WITH_TRIPS + """
SELECT origin || ' → ' || destination AS route, CAST(sum(ticket_price) AS DOUBLE) AS revenue,
       count(passport_id) AS passengers
FROM flights f JOIN passengers p ON f.flight_id = p.flight_id
GROUP BY origin, destination ORDER BY sum(ticket_price) DESC, origin, destination LIMIT 10"""


@BOOK.add("top_routes", TOP_ROUTES_SQL)
def top_routes(spark, folder):
    return reports.top_routes(b.flights(spark, folder), b.passengers(spark, folder))


@BOOK.add("delay_by_airport", WITH_DEPARTURES + """
SELECT origin AS airport, round(avg(delay_minutes), 4) AS avg_delay, count(*) AS flights FROM departures
WHERE delay_minutes > 0 GROUP BY origin ORDER BY 2 DESC, 1 LIMIT 10""")
def delay_by_airport(spark, folder):
    return reports.delay_by_airport(b.departures(spark, folder))


@BOOK.add("delay_by_airline", WITH_DEPARTURES + """
SELECT airline, round(avg(delay_minutes), 4) AS avg_delay, count(*) AS flights FROM departures
WHERE delay_minutes > 0 GROUP BY airline""")
def delay_by_airline(spark, folder):
    return reports.delay_by_airline(b.departures(spark, folder))


@BOOK.add("filter_positive", WITH_DEPARTURES + """
SELECT flight_id, airline, CAST(delay_minutes AS INTEGER) AS delay_minutes FROM departures WHERE delay_minutes > 0""")
def filter_positive(spark, folder):
    late = b.departures(spark, folder).filter(F.col("delay_minutes") > 0)
    return late.select("flight_id", "airline", "delay_minutes")


# Scans and sinks

@BOOK.add("scan_table", "SELECT * FROM orders")
def scan_table(spark, folder):
    return tables.read_table(spark, f"{folder}/orders.parquet")


NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
         "embeddings", "pages", "benchmark", "labels", "conversations")


@BOOK.add("catalog_tables", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS table_name, count(*) AS total_rows FROM {n}" for n in NAMES))
def catalog_tables(spark, folder):
    """The tables of the folder, registered in a schema of their own, as the catalog lists them, with their sizes."""
    schema = f"sized_{uuid.uuid4().hex[:12]}"
    tables.register_folder(spark, folder, schema)
    sized = tables.table_sizes(spark, schema=schema).select("table_name", "total_rows")
    spark.sql("DROP SCHEMA IDENTIFIER(:name) CASCADE", args={"name": schema})
    return sized


@BOOK.add("table_columns", "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS column_name, count({c}) AS filled FROM orders"
    for i, c in enumerate(
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])))
def table_columns(spark, folder):
    return tables.column_fill(b.table(spark, folder, "orders"))


@BOOK.add("append_events", "WITH " + b.TRAFFIC_SQL + """
SELECT video_id, frame_id, "timestamp", car_id, position_x, position_y, estimated_speed_kmh, vehicle_type, direction,
       processing_datetime FROM traffic""")
def append_events(spark, folder):
    path = work_path(spark, "append-events")
    rows = b.traffic(spark, folder).select(*[f.name for f in tables.TRAFFIC_EVENTS.fields])
    versions.append_rows(rows, path, ["video_id"])
    return spark.read.parquet(path).select(*rows.columns)


@BOOK.add("overwrite_stats", 'SELECT o_orderstatus AS status, count(*) AS "count" FROM orders GROUP BY 1')
def overwrite_stats(spark, folder):
    """Replaces one version of the statistics by the next and reads the current one."""
    root = work_path(spark, "stats")
    flights = _plain_flights(spark, folder)
    versions.write_version(reports.distribution(flights.filter(F.col("status") == "O"), "status"), root)
    versions.write_version(reports.distribution(flights, "status"), root)
    return versions.read_version(spark, root)


@BOOK.add("rows_as_json", """
SELECT '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_nationkey":' || s_nationkey ||
       ',"balance":"' || CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS VARCHAR) || '"}' AS "json" FROM supplier""")
def rows_as_json(spark, folder):
    supplier = b.table(spark, folder, "supplier")
    return tables.rows_as_json(supplier.select(
        "s_suppkey", "s_name", "s_nationkey", F.col("s_acctbal").cast("decimal(12,2)").alias("balance")))


def _draw_sql(key: str, field: str, size: int | str) -> str:
    factor, offset = generate.draw_constants(field, 7)
    high = f"(({key} // {generate.PRIME}) % {generate.PRIME}) * {factor * 69621 % generate.PRIME} % {generate.PRIME}"
    mixed = f"(({key} % {generate.PRIME}) * {factor} % {generate.PRIME} + {high} + {offset}) % {generate.PRIME}"
    for _ in range(2):
        mixed = f"list_aggregate(list_transform([{mixed}], lambda h: (h * h + {offset}) % {generate.PRIME}), 'max')"
    return f"({mixed} % {size})"


def _pick_sql(key: str, field: str, values: list[str]) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"([{items}])[{_draw_sql(key, field, len(values))} + 1]"


def _between_sql(key: str, field: str, low: int, high: int) -> str:
    return f"({_draw_sql(key, field, high - low + 1)} + {low})"


_CODES = [r[0] for r in tables.SEED_ROWS["airports"]]
_CARRIERS = [r[0] for r in tables.SEED_ROWS["airlines"]]
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@BOOK.add("generate_flights", f"""
WITH base AS (
  SELECT o_orderkey AS flight_id, {_pick_sql('o_orderkey', 'airline', _CARRIERS)} AS airline,
         {_draw_sql('o_orderkey', 'origin', len(_CODES))} AS a,
         {_between_sql('o_orderkey', 'step', 1, len(_CODES) - 1)} AS step,
         {_NOW} + to_days(CAST({_between_sql('o_orderkey', 'days', -30, 30)} AS INTEGER))
             + to_hours({_between_sql('o_orderkey', 'hours', 0, 23)}) AS departure_time,
         {_pick_sql('o_orderkey', 'status', generate.STATUSES)} AS status,
         {_pick_sql('o_orderkey', 'aircraft', generate.AIRCRAFT_TYPES)} AS aircraft_type
  FROM orders)
SELECT flight_id, airline || CAST(flight_id + 1000 AS VARCHAR) AS flight_number, airline,
       ([{", ".join(f"'{c}'" for c in _CODES)}])[a + 1] AS origin,
       ([{", ".join(f"'{c}'" for c in _CODES)}])[(a + step) % {len(_CODES)} + 1] AS destination,
       departure_time, departure_time + to_hours({_between_sql('flight_id', 'length', 2, 12)}) AS arrival_time,
       status, aircraft_type,
       CAST(CASE WHEN status IN ('Delayed', 'Cancelled') THEN {_between_sql('flight_id', 'major', 15, 240)}
            WHEN status IN ('Departed', 'Arrived') THEN
              CASE WHEN {_draw_sql('flight_id', 'luck', 100)} < 70 THEN 0
                   ELSE {_between_sql('flight_id', 'minor', 5, 60)} END
            ELSE 0 END AS INTEGER) AS delay_minutes
FROM base""")
def generate_flights(spark, folder):
    """One synthetic flight for each order."""
    return generate.generate_flights(b.table(spark, folder, "orders").select(F.col("o_orderkey").alias("flight_id")))


@BOOK.add("generate_passengers", f"""
WITH base AS (
  SELECT o_orderkey AS k, {_pick_sql('o_orderkey', 'first', generate.FIRST_NAMES)} AS first_name,
         {_pick_sql('o_orderkey', 'last', generate.LAST_NAMES)} AS last_name,
         {_pick_sql('o_orderkey', 'class', generate.CLASSES)} AS class FROM orders)
SELECT 'P' || {_between_sql('k', 'passport', 100000, 999999)} AS passport_id, first_name, last_name,
       lower(first_name) || '.' || lower(last_name) || k || '@email.com' AS email,
       '+1-555-' || {_between_sql('k', 'exchange', 100, 999)} || '-' || {_between_sql('k', 'line', 1000, 9999)} AS phone,
       {_pick_sql('k', 'sex', generate.SEXES)} AS sex, {_draw_sql('k', 'flight', '(SELECT count(*) FROM orders)')} + 1 AS flight_id,
       {_between_sql('k', 'row', 1, 30)} || {_pick_sql('k', 'seat', generate.SEAT_LETTERS)} AS seat_number, class,
       {_NOW} - to_days(CAST({_between_sql('k', 'booked', 1, 60)} AS INTEGER)) AS booking_date,
       CAST(CASE class WHEN 'Economy' THEN {_between_sql('k', 'price', 150, 800)}
                  WHEN 'Business' THEN {_between_sql('k', 'price', 1200, 3500)}
                  ELSE {_between_sql('k', 'price', 3500, 8000)} END AS DOUBLE) AS ticket_price
FROM base""")
def generate_passengers(spark, folder):
    """One synthetic passenger for each order, on as many flights."""
    ids = b.table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"))
    return generate.generate_passengers(ids, ids.count()).withColumn("ticket_price", F.col("ticket_price").cast("double"))


# Sorts and top-k

@BOOK.add("sorted_listing", "SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_suppkey")
def sorted_listing(spark, folder):
    return b.table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal").orderBy("s_suppkey")


@BOOK.add("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, folder):
    orders = b.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.col("o_totalprice").desc(), F.col("o_orderkey").asc()).limit(10)


# Set operations

@BOOK.add("union_all", """
SELECT c_custkey AS party_key, c_name AS party_name, 'customer' AS kind FROM customer
UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier""")
def union_all(spark, folder):
    customer = b.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("party_key"), F.col("c_name").alias("party_name"), F.lit("customer").alias("kind"))
    supplier = b.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("party_key"), F.col("s_name").alias("party_name"), F.lit("supplier").alias("kind"))
    return customer.unionByName(supplier)


@BOOK.add("project_alias", "SELECT o_orderkey AS flight_id, o_orderpriority AS airline, o_orderstatus AS status FROM orders")
def project_alias(spark, folder):
    return _plain_flights(spark, folder)
