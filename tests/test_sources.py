"""Creation, seeding, discovery, generated rows and media files."""

import pytest
from pyspark.sql import functions as F

from tallyloom.session import shared_folder, work_path
from tallyloom.sources import generate, media, tables, versions


def test_create_seed_and_drop(spark):
    name = "airports"
    tables.drop_table(spark, name)
    assert not tables.table_exists(spark, name)
    assert tables.create_table(spark, name) and not tables.create_table(spark, name)
    assert spark.table(name).schema == tables.AIRPORTS
    assert tables.seed_if_empty(spark, name, tables.seed_rows(spark, name))
    assert not tables.seed_if_empty(spark, name, tables.seed_rows(spark, name))
    assert spark.table(name).count() == 12
    assert spark.table(name).filter(F.col("airport_name") == "O'Hare International Airport").count() == 1
    listed = {r["table_name"] for r in tables.list_tables(spark).collect()}
    assert name in listed
    assert [r["column_name"] for r in tables.table_columns(spark.table(name))] == tables.AIRPORTS.names
    assert tables.read_table(spark, name).count() == 12
    tables.drop_table(spark, name)
    tables.drop_table(spark, name)
    assert not tables.table_exists(spark, name)


@pytest.mark.parametrize("name", sorted(tables.TABLE_SCHEMAS))
def test_empty_tables_are_typed(spark, name):
    empty = tables.empty_table(spark, name)
    assert empty.isEmpty() and empty.schema == tables.TABLE_SCHEMAS[name]


def test_column_fill_counts_values(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [tuple(r) for r in tables.column_fill(df).orderBy("ordinal").collect()] == [(0, "a", 2), (1, "b", 1)]


def test_rows_as_json_keep_nulls_and_digits(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string").withColumn("c", F.lit("12.30").cast("decimal(10,2)"))
    assert tables.rows_as_json(df).first()[0] == '{"a":1,"b":null,"c":"12.30"}'


def test_flights_obey_their_rules(spark):
    rows = generate.generate_flights(generate.flight_ids(spark, 2000)).cache()
    assert rows.count() == 2000 and rows.select("flight_id").distinct().count() == 2000
    assert rows.filter("origin = destination").count() == 0
    hours = (F.unix_timestamp(F.col("arrival_time").cast("timestamp")) - F.unix_timestamp(F.col("departure_time").cast("timestamp"))) / 3600
    low, high = rows.agg(F.min(hours), F.max(hours)).first()
    assert (low, high) == (2, 12)
    late = rows.filter("status in ('Delayed', 'Cancelled')")
    assert late.filter("delay_minutes not between 15 and 240").count() == 0
    gone = rows.filter("status in ('Departed', 'Arrived')")
    assert 0.6 < gone.filter("delay_minutes = 0").count() / gone.count() < 0.8
    assert gone.filter("delay_minutes != 0 and delay_minutes not between 5 and 60").count() == 0
    assert rows.filter("status in ('Scheduled', 'Boarding') and delay_minutes != 0").count() == 0
    assert rows.filter("flight_number != concat(airline, cast(1000 + flight_id as string))").count() == 0
    assert rows.select("origin").distinct().count() == 12 and rows.select("airline").distinct().count() == 8


def test_passengers_obey_their_rules(spark):
    ids = spark.range(1, 3001).withColumnRenamed("id", "row_id")
    rows = generate.generate_passengers(ids, 100).cache()
    bounds = {r["class"]: (int(r["lo"]), int(r["hi"])) for r in
              rows.groupBy("class").agg(F.min("ticket_price").alias("lo"), F.max("ticket_price").alias("hi")).collect()}
    for name, (low, high) in generate.PRICE_RANGES.items():
        assert low <= bounds[name][0] <= bounds[name][1] <= high
    assert rows.filter("flight_id not between 1 and 100").count() == 0
    assert rows.filter(~F.col("passport_id").rlike("^P[0-9]{6}$") | ~F.col("seat_number").rlike("^([1-9]|[12][0-9]|30)[A-F]$")).count() == 0


def test_generated_rows_do_not_depend_on_partitions(spark):
    ids = generate.flight_ids(spark, 300)
    one = sorted(map(tuple, generate.generate_flights(ids.coalesce(1)).collect()))
    many = sorted(map(tuple, generate.generate_flights(ids.repartition(7)).collect()))
    assert one == many
    assert one != sorted(map(tuple, generate.generate_flights(ids, seed=8).collect()))


def test_media_listing(spark, tmp_path):
    for name in ("a.mp4", "b.avi", "c.txt", "sub/d.mp4"):
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_bytes(b"x" * 7)
    got = media.list_files(spark, str(tmp_path), (".mp4", "avi"))
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in got.collect()) == ["a.mp4", "b.avi", "d.mp4"]
    assert {r["size_bytes"] for r in got.collect()} == {7}


def test_append_adds_up(spark):
    path = work_path(spark, "append")
    for _ in range(2):
        versions.append_rows(spark.range(5).withColumn("p", F.col("id") % 2), path, ["p"])
    assert spark.read.parquet(path).count() == 10
    assert versions.is_folder(spark, path) and versions.folder_bytes(spark, path) > 0


def test_shared_folder_is_the_checkpoint_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named or spark.sparkContext.getCheckpointDir()).rstrip("/")
    assert spark.sparkContext.getCheckpointDir() is not None
    assert work_path(spark, "x") != work_path(spark, "x")


def test_ids_far_apart_draw_other_rows(spark):
    step = 2**31 - 1
    ids = spark.createDataFrame([(5,), (5 + step,), (5 + 2 * step,)], "row_id long")
    rows = [tuple(r) for r in generate.generate_passengers(ids, 10**12).drop("email").collect()]
    assert len({r[0] for r in rows}) == 3 and len({r[3] for r in rows}) == 3
    far = generate.generate_flights(ids.withColumnRenamed("row_id", "flight_id")).collect()
    assert [r["flight_id"] for r in far] == [5, 5 + step, 5 + 2 * step]
