"""Reports over the generated airport tables, against plain Python."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import reports
from tallyloom.sources import generate, tables


@pytest.fixture(scope="module")
def airport(spark):
    flights = generate.generate_flights(generate.flight_ids(spark, 100)).cache()
    ids = spark.range(1, 201).withColumnRenamed("id", "row_id")
    passengers = generate.generate_passengers(ids, 100).cache()
    return flights, passengers, tables.seed_rows(spark, "airports")


def plain(airport):
    flights, passengers, _ = airport
    return [r.asDict() for r in flights.collect()], [r.asDict() for r in passengers.collect()]


def test_page_equals_the_single_reports(airport):
    flights, passengers, airports = airport
    page = reports.report_page(flights, passengers, airports)
    single = {
        "summary": reports.kpi_summary(flights, passengers, airports),
        "top_airports": reports.top_airports(flights),
        "top_airlines": reports.top_airlines(flights, passengers),
        "status_distribution": reports.distribution(flights, "status"),
        "class_distribution": reports.distribution(passengers, "class"),
        "revenue_by_class": reports.revenue_by_class(passengers),
        "revenue_by_airline": reports.revenue_by_airline(flights, passengers),
        "top_routes": reports.top_routes(flights, passengers),
        "delay_by_airport": reports.delay_by_airport(flights),
        "delay_by_airline": reports.delay_by_airline(flights),
    }
    assert set(page) == set(single)
    for name, frame in single.items():
        assert sorted(map(tuple, page[name].collect())) == sorted(map(tuple, frame.collect())), name


def test_header(airport):
    flights, passengers = plain(airport)
    row = reports.kpi_summary(*airport).first()
    assert (row["total_flights"], row["total_passengers"], row["total_airports"]) == (100, 200, 12)
    assert row["active_flights"] == sum(f["status"] in reports.ACTIVE_STATUSES for f in flights)
    assert row["total_revenue"] == float(sum(p["ticket_price"] for p in passengers))
    assert row["avg_ticket_price"] == pytest.approx(row["total_revenue"] / 200, abs=1e-4)


def test_header_of_empty_tables(spark, airport):
    flights, passengers, airports = (df.limit(0) for df in airport)
    row = reports.kpi_summary(flights, passengers, airports).first()
    assert (row["total_flights"], row["total_revenue"], row["avg_ticket_price"]) == (0, 0.0, 0.0)


def test_routes_and_airlines(airport):
    flights, passengers = plain(airport)
    of = {f["flight_id"]: f for f in flights}
    revenue, count, seats = defaultdict(int), Counter(), Counter()
    for p in passengers:
        f = of[p["flight_id"]]
        revenue[f["origin"], f["destination"]] += p["ticket_price"]
        count[f["origin"], f["destination"]] += 1
        seats[f["airline"]] += 1
    want = sorted(revenue, key=lambda r: (-revenue[r], r))[:10]
    got = reports.top_routes(*airport[:2]).collect()
    assert [(r["route"], r["revenue"], r["passengers"]) for r in got] == [
        (f"{a} → {b}", float(revenue[a, b]), count[a, b]) for a, b in want]
    airlines = reports.top_airlines(*airport[:2]).collect()
    assert [(r["airline"], r["count"]) for r in airlines] == sorted(seats.items(), key=lambda x: (-x[1], x[0]))[:10]


def test_delays_leave_out_flights_on_time(airport):
    flights, _ = plain(airport)
    late = defaultdict(list)
    for f in flights:
        if f["delay_minutes"] > 0:
            late[f["airline"]].append(f["delay_minutes"])
    got = {r["airline"]: (r["avg_delay"], r["flights"]) for r in reports.delay_by_airline(airport[0]).collect()}
    assert got == {a: (pytest.approx(sum(v) / len(v), abs=1e-4), len(v)) for a, v in late.items()}


def test_equal_counts_go_by_name(spark):
    df = spark.createDataFrame([(c,) for c in "ccbbaad"], "origin string")
    assert [r["airport"] for r in reports.top_airports(df, 2).collect()] == ["a", "b"]


def test_group_without_prices_has_no_sum(spark):
    df = spark.createDataFrame([("x", None), ("y", 1.5)], "class string, ticket_price double").withColumn(
        "ticket_price", F.col("ticket_price").cast("decimal(10,2)"))
    assert {r["class"]: r["revenue"] for r in reports.revenue_by_class(df).collect()} == {"x": None, "y": 1.5}
