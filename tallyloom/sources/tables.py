"""Table scans, discovery, explicit schemas, creation and seeding."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import work_path
from tallyloom.sources.versions import entries

AIRPORTS = T.StructType([
    T.StructField("airport_code", T.StringType()),
    T.StructField("airport_name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("country", T.StringType()),
])
AIRLINES = T.StructType([
    T.StructField("airline_code", T.StringType()),
    T.StructField("airline_name", T.StringType()),
    T.StructField("country", T.StringType()),
])
FLIGHTS = T.StructType([
    T.StructField("flight_id", T.IntegerType()),
    T.StructField("flight_number", T.StringType()),
    T.StructField("airline", T.StringType()),
    T.StructField("origin", T.StringType()),
    T.StructField("destination", T.StringType()),
    T.StructField("departure_time", T.TimestampType()),
    T.StructField("arrival_time", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("aircraft_type", T.StringType()),
    T.StructField("delay_minutes", T.IntegerType()),
])
PASSENGERS = T.StructType([
    T.StructField("passport_id", T.StringType()),
    T.StructField("first_name", T.StringType()),
    T.StructField("last_name", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("phone", T.StringType()),
    T.StructField("sex", T.StringType()),
    T.StructField("flight_id", T.IntegerType()),
    T.StructField("seat_number", T.StringType()),
    T.StructField("class", T.StringType()),
    T.StructField("booking_date", T.TimestampType()),
    T.StructField("ticket_price", T.DecimalType(10, 2)),
])
AIRCRAFT = T.StructType([
    T.StructField("aircraft_id", T.IntegerType()),
    T.StructField("aircraft_type", T.StringType()),
    T.StructField("manufacturer", T.StringType()),
    T.StructField("capacity", T.IntegerType()),
    T.StructField("range_km", T.IntegerType()),
])
TRAFFIC_EVENTS = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("frame_id", T.LongType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("car_id", T.LongType()),
    T.StructField("position_x", T.LongType()),
    T.StructField("position_y", T.LongType()),
    T.StructField("estimated_speed_kmh", T.LongType()),
    T.StructField("vehicle_type", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("processing_datetime", T.TimestampType()),
])
TRAFFIC_AGGREGATED = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.StringType()),
])

TABLE_SCHEMAS: Mapping[str, T.StructType] = {
    "airports": AIRPORTS,
    "airlines": AIRLINES,
    "flights": FLIGHTS,
    "passengers": PASSENGERS,
    "aircraft": AIRCRAFT,
    "traffic_events": TRAFFIC_EVENTS,
    "traffic_aggregated": TRAFFIC_AGGREGATED,
}

# The seed rows of the dimension tables.
SEED_ROWS: Mapping[str, list[tuple]] = {
    "airports": [
        ("JFK", "John F. Kennedy International Airport", "New York", "USA"),
        ("LAX", "Los Angeles International Airport", "Los Angeles", "USA"),
        ("ORD", "O'Hare International Airport", "Chicago", "USA"),
        ("ATL", "Hartsfield-Jackson Atlanta International Airport", "Atlanta", "USA"),
        ("DFW", "Dallas/Fort Worth International Airport", "Dallas", "USA"),
        ("DEN", "Denver International Airport", "Denver", "USA"),
        ("LHR", "London Heathrow Airport", "London", "UK"),
        ("CDG", "Charles de Gaulle Airport", "Paris", "France"),
        ("DXB", "Dubai International Airport", "Dubai", "UAE"),
        ("HND", "Tokyo Haneda Airport", "Tokyo", "Japan"),
        ("SFO", "San Francisco International Airport", "San Francisco", "USA"),
        ("MIA", "Miami International Airport", "Miami", "USA"),
    ],
    "airlines": [
        ("AA", "American Airlines", "USA"),
        ("DL", "Delta Air Lines", "USA"),
        ("UA", "United Airlines", "USA"),
        ("BA", "British Airways", "UK"),
        ("EK", "Emirates", "UAE"),
        ("LH", "Lufthansa", "Germany"),
        ("AF", "Air France", "France"),
        ("JL", "Japan Airlines", "Japan"),
    ],
    "aircraft": [
        (1, "Boeing 737", "Boeing", 180, 5600),
        (2, "Boeing 777", "Boeing", 396, 15200),
        (3, "Boeing 787", "Boeing", 330, 14140),
        (4, "Airbus A320", "Airbus", 180, 6100),
        (5, "Airbus A330", "Airbus", 277, 13400),
        (6, "Airbus A380", "Airbus", 555, 15200),
        (7, "Boeing 747", "Boeing", 416, 13450),
        (8, "Airbus A350", "Airbus", 440, 15000),
    ],
}


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A whole table: a path when it looks like one, else a catalog name."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def list_tables(spark: SparkSession, catalog: str | None = None, schema: str | None = None) -> DataFrame:
    """Catalogs, schemas and tables, narrowed by the names that are given.

    The rows come from the catalog, so this is metadata work whatever the tables hold.
    """
    current = spark.catalog.currentCatalog()
    rows: list[tuple[str, str, str]] = []
    try:
        for cat in spark.catalog.listCatalogs():
            if catalog and cat.name != catalog:
                continue
            spark.catalog.setCurrentCatalog(cat.name)
            for space in spark.catalog.listDatabases():
                if schema and space.name != schema:
                    continue
                rows += [(cat.name, space.name, t.name) for t in spark.catalog.listTables(space.name)]
    finally:
        spark.catalog.setCurrentCatalog(current)
    return spark.createDataFrame(rows, "catalog string, schema string, table_name string")


def table_columns(df: DataFrame) -> list[Row]:
    """Ordinal and name of each column, from the schema alone."""
    return [Row(ordinal=i, column_name=name) for i, name in enumerate(df.columns)]


def column_fill(df: DataFrame) -> DataFrame:
    """Column discovery with the number of non-null values, in one pass over the table."""
    names = [c.column_name for c in table_columns(df)]
    counts = df.agg(*[F.count(F.col(f"`{n}`")).alias(n) for n in names])
    wide = counts.select(F.posexplode(F.array(*[
        F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").alias("filled")) for n in names
    ])).alias("ordinal", "entry"))
    return wide.select("ordinal", "entry.column_name", "entry.filled")


def register_folder(spark: SparkSession, folder: str, schema: str) -> None:
    """Every parquet table of a folder as an external table of a schema, which is created if need be."""
    place = work_path(spark, "schema").replace("'", "\\'")
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS IDENTIFIER(:name) LOCATION '{place}'", args={"name": schema})
    for name in entries(spark, folder):
        if name.endswith(".parquet"):
            spark.catalog.createTable(f"{schema}.{name.removesuffix('.parquet')}", f"{folder}/{name}", "parquet")


def table_sizes(spark: SparkSession, catalog: str | None = None, schema: str | None = None) -> DataFrame:
    """The tables that ``list_tables`` finds with their rows. Counts come from the file footers, one small row a table."""
    found = list_tables(spark, catalog, schema)
    names = [tuple(r) for r in found.collect()]
    sized = [spark.table(".".join(f"`{part}`" for part in at)).agg(F.count(F.lit(1)).alias("total_rows")).select(
        *[F.lit(part).alias(f"_{k}") for k, part in enumerate(at)], "total_rows") for at in names]
    if not sized:
        return found.withColumn("total_rows", F.lit(0).cast("long"))
    rows = reduce(lambda a, b: a.unionByName(b), sized)
    same = (F.col("catalog") == F.col("_0")) & (F.col("schema") == F.col("_1")) & (F.col("table_name") == F.col("_2"))
    return found.join(rows, same).drop("_0", "_1", "_2")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """No rows, typed like the named table."""
    return spark.createDataFrame([], TABLE_SCHEMAS[name.split(".")[-1]])


def create_table(spark: SparkSession, name: str, schema: T.StructType | None = None,
                 partition_by: Iterable[str] = ()) -> bool:
    """Create an empty table unless it is there already; tells whether it made one."""
    if table_exists(spark, name):
        return False
    frame = empty_table(spark, name) if schema is None else spark.createDataFrame([], schema)
    writer = frame.write.format("parquet")
    parts = list(partition_by)
    if parts:
        writer = writer.partitionBy(*parts)
    writer.saveAsTable(name)
    return True


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a table; one that is missing is no error."""
    if table_exists(spark, name):
        spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})


def seed_rows(spark: SparkSession, name: str) -> DataFrame:
    """The literal rows of a dimension table."""
    key = name.split(".")[-1]
    return spark.createDataFrame(SEED_ROWS[key], TABLE_SCHEMAS[key])


def seed_if_empty(spark: SparkSession, name: str, rows: DataFrame) -> bool:
    """Append ``rows`` when the table has none. ``isEmpty`` stops at the first row it meets."""
    if not spark.table(name).isEmpty():
        return False
    columns = spark.table(name).columns
    rows.select(*columns).write.mode("append").insertInto(name)
    return True


def rows_as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object; decimals become strings so that no digit is lost."""
    cells = [
        F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.DecimalType)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("json"))
