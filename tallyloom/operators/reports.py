"""The flight report pack: key figures, distributions, top lists, revenue and delays.

The functions take frames with the column names of the airport tables. Joins are on
``flight_id``; passengers are summed per flight before they meet the flights, so a flight with very many
passengers crosses the shuffle as a few partial rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import work_path

ACTIVE_STATUSES = ("Scheduled", "Boarding", "Departed")


def _rows() -> Column:
    return F.count(F.lit(1))


def _money(total: Column) -> Column:
    return total.cast("double")


def _average(amount: str) -> Column:
    """Mean by way of the exact decimal sum, so that it does not depend on the order of rows."""
    return F.try_divide(F.sum(amount).cast("double"), F.count(amount).cast("double"))


def _beside(one: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row frames side by side: the others come in as scalar subqueries, each a struct of its columns."""
    cells = [o.select(F.struct("*")).scalar().alias(f"_{i}") for i, o in enumerate(others)]
    return one.select("*", *cells).select(*one.columns, *[f"_{i}.*" for i in range(len(others))])


def kpi_counts(flights: DataFrame, passengers: DataFrame, airports: DataFrame) -> DataFrame:
    return _beside(
        flights.agg(_rows().alias("total_flights")),
        passengers.agg(_rows().alias("total_passengers")),
        airports.agg(_rows().alias("total_airports")),
    )


def active_count(flights: DataFrame, active: Sequence[str] = ACTIVE_STATUSES) -> DataFrame:
    return flights.filter(F.col("status").isin(*active)).agg(_rows().alias("active_flights"))


def kpi_revenue(passengers: DataFrame) -> DataFrame:
    return passengers.agg(F.coalesce(_money(F.sum("ticket_price")), F.lit(0.0)).alias("total_revenue"))


def kpi_avg_price(passengers: DataFrame) -> DataFrame:
    return passengers.agg(F.round(F.coalesce(_average("ticket_price"), F.lit(0.0)), 4).alias("avg_ticket_price"))


def kpi_summary(flights: DataFrame, passengers: DataFrame, airports: DataFrame,
                active: Sequence[str] = ACTIVE_STATUSES) -> DataFrame:
    """The whole header as one row, with one pass per table."""
    flown = flights.agg(
        _rows().alias("total_flights"),
        F.count(F.when(F.col("status").isin(*active), 1)).alias("active_flights"),
    )
    paid = passengers.agg(
        _rows().alias("total_passengers"),
        F.coalesce(_money(F.sum("ticket_price")), F.lit(0.0)).alias("total_revenue"),
        F.round(F.coalesce(_average("ticket_price"), F.lit(0.0)), 4).alias("avg_ticket_price"),
    )
    return _beside(flown, paid, airports.agg(_rows().alias("total_airports"))).select(
        "total_flights", "total_passengers", "active_flights", "total_airports", "total_revenue", "avg_ticket_price")


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(_rows().alias("count"))


def top_counts(df: DataFrame, column: str, label: str, k: int = 10) -> DataFrame:
    """The k most frequent values; equal counts go by the value."""
    counted = df.groupBy(F.col(column).alias(label)).agg(_rows().alias("count"))
    return counted.orderBy(F.col("count").desc(), F.col(label).asc()).limit(k)


def top_airports(flights: DataFrame, k: int = 10) -> DataFrame:
    return top_counts(flights, "origin", "airport", k)


def _per_flight(passengers: DataFrame, *extra: str) -> DataFrame:
    return passengers.groupBy("flight_id", *extra).agg(
        F.count("passport_id").alias("_passengers"), F.sum("ticket_price").alias("_revenue"))


def top_airlines(flights: DataFrame, passengers: DataFrame, k: int = 10) -> DataFrame:
    joined = flights.select("flight_id", "airline").join(_per_flight(passengers), "flight_id")
    counted = joined.groupBy("airline").agg(F.sum("_passengers").alias("count"))
    return counted.orderBy(F.col("count").desc(), F.col("airline").asc()).limit(k)


def revenue_by_class(passengers: DataFrame) -> DataFrame:
    total = passengers.groupBy("class").agg(_money(F.sum("ticket_price")).alias("revenue"))
    return total.orderBy(F.col("revenue").desc(), F.col("class").asc())


def revenue_by_airline(flights: DataFrame, passengers: DataFrame) -> DataFrame:
    joined = flights.select("flight_id", "airline").join(_per_flight(passengers), "flight_id")
    total = joined.groupBy("airline").agg(_money(F.sum("_revenue")).alias("revenue"))
    return total.orderBy(F.col("revenue").desc(), F.col("airline").asc())


def top_routes(flights: DataFrame, passengers: DataFrame, k: int = 10) -> DataFrame:
    """Origin and destination pairs by revenue. The destination may come from either side."""
    routes = _summed(flights, passengers, "origin", "destination").withColumnRenamed("_passengers", "passengers")
    return _route_list(routes, k)


def _summed(flights: DataFrame, passengers: DataFrame, *keys: str) -> DataFrame:
    """Revenue and passengers by keys that may come from either side; passengers are summed before they meet the flights."""
    own = [k for k in keys if k in passengers.columns]
    joined = flights.select("flight_id", *[k for k in keys if k not in own]).join(_per_flight(passengers, *own), "flight_id")
    return joined.groupBy(*keys).agg(F.sum("_revenue").alias("_revenue"), F.sum("_passengers").alias("_passengers"))


def _route_list(routes: DataFrame, k: int) -> DataFrame:
    ranked = routes.orderBy(F.col("_revenue").desc(), F.col("origin").asc(), F.col("destination").asc()).limit(k)
    return ranked.select(
        F.concat("origin", F.lit(" → "), "destination").alias("route"),
        _money(F.col("_revenue")).alias("revenue"), "passengers",
    )


def _delays(flights: DataFrame, column: str, label: str) -> DataFrame:
    late = flights.filter(F.col("delay_minutes") > 0)
    return late.groupBy(F.col(column).alias(label)).agg(
        F.round(F.avg("delay_minutes"), 4).alias("avg_delay"), _rows().alias("flights"))


def delay_by_airport(flights: DataFrame, k: int = 10) -> DataFrame:
    return _delays(flights, "origin", "airport").orderBy(F.col("avg_delay").desc(), F.col("airport").asc()).limit(k)


def delay_by_airline(flights: DataFrame) -> DataFrame:
    return _delays(flights, "airline", "airline").orderBy(F.col("avg_delay").desc(), F.col("airline").asc())


def report_page(flights: DataFrame, passengers: DataFrame, airports: DataFrame,
                active: Sequence[str] = ACTIVE_STATUSES) -> dict[str, DataFrame]:
    """The header and the nine reports of the page, by name.

    Flights meet passengers once: the totals per airline and route are written to the shared folder, and three reports
    add them up.
    """
    path = work_path(flights.sparkSession, "route-totals")
    _summed(flights, passengers, "airline", "origin", "destination").write.parquet(path)
    totals = flights.sparkSession.read.parquet(path)
    by_airline = totals.groupBy("airline").agg(
        F.sum("_passengers").alias("count"), _money(F.sum("_revenue")).alias("revenue"))
    routes = totals.groupBy("origin", "destination").agg(
        F.sum("_revenue").alias("_revenue"), F.sum("_passengers").alias("passengers"))
    return {
        "summary": kpi_summary(flights, passengers, airports, active),
        "top_airports": top_airports(flights),
        "top_airlines": by_airline.select("airline", "count").orderBy(F.col("count").desc(), "airline").limit(10),
        "status_distribution": distribution(flights, "status"),
        "class_distribution": distribution(passengers, "class"),
        "revenue_by_class": revenue_by_class(passengers),
        "revenue_by_airline": by_airline.select("airline", "revenue").orderBy(F.col("revenue").desc(), "airline"),
        "top_routes": _route_list(routes, 10),
        "delay_by_airport": delay_by_airport(flights),
        "delay_by_airline": delay_by_airline(flights),
    }
