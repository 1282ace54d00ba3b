"""Scalar functions on the edges, and enrichment helpers."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import convert, display, text
from tallyloom.operators import enrich
from tallyloom.session import work_path


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_sanitize(spark):
    got = apply(spark, text.sanitize, ["a -- b", "x /* y */ z ;", "DROP  TABLE t", "O'Hare", None, " ; ", "union\nselect 1"])
    assert got == ["a", "x  z", "t", "O''Hare", "", "", "1"]


def test_identifiers(spark):
    assert apply(spark, text.is_identifier, ["a_1.b", " _x ", "1a", "", None, "a-b"]) == [True, True, False, False, False, False]


def test_numbers(spark):
    assert apply(spark, text.is_number, ["12", "-1.5", "2024-01-01", "1e3", "", None]) == [True, True, True, False, False, False]


def test_lists(spark):
    assert apply(spark, text.split_list, ["a, b,,c ", "", " , "]) == [["a", "b", "c"], [], []]


def test_truncate(spark):
    assert apply(spark, text.truncate, ["x" * 100, "x" * 101, None]) == ["x" * 100, "x" * 100 + "...", None]
    assert apply(spark, text.id_prefix, ["0123456789"]) == ["01234567..."]


def test_file_parts(spark):
    paths = ["/a/b.c/clip.part.mp4", "clip", "/x/.hidden", "v.MP4"]
    assert apply(spark, text.base_name, paths) == ["clip", "clip", "", "v"]
    assert apply(spark, text.extension, paths) == [".mp4", "", "", ".MP4"]


def test_clean_and_blank(spark):
    assert apply(spark, text.clean, ["\u0000 a b \u0000"]) == ["a b"]
    assert apply(spark, text.blank_to_null, ["", " ", "x"]) == [None, " ", "x"]


def test_casts(spark):
    raw = ["12", "-3.9", "abc", None, "1e3"]
    assert apply(spark, convert.safe_long, raw) == [12, -3, 0, 0, 1000]
    assert apply(spark, convert.safe_double, raw) == [12.0, -3.9, 0.0, 0.0, 1000.0]
    assert apply(spark, convert.safe_string, raw) == ["12", "-3.9", "abc", "unknown", "1e3"]
    assert apply(spark, convert.safe_timestamp, ["2024-01-01 00:00:00", "x"])[1] is None
    assert apply(spark, convert.or_zero, ["7", "", None]) == [7, 0, 0]


def test_half_even(spark):
    assert apply(spark, lambda c: convert.half_even(c, 0), [0.5, 1.5, 2.5], "double") == [0.0, 2.0, 2.0]


def test_base64_is_one_line_and_comes_back(spark):
    long = "é" * 200
    assert "\n" not in apply(spark, lambda c: convert.encode(F.encode(c, "UTF-8")), [long])[0]
    assert apply(spark, lambda c: F.decode(convert.decode(convert.encode(F.encode(c, "UTF-8"))), "UTF-8"), [long]) == [long]


def test_money(spark):
    assert apply(spark, display.thousands_of_dollars, [0.0, 1250.0, 999.0], "double") == ["$0.0K", "$1.3K", "$1.0K"]
    assert apply(spark, display.dollars, [1.0, 2.345], "double") == ["$1.00", "$2.35"]
    assert apply(spark, display.grouped_number, [1234567.0, 1234.5, 0.25, 100.0], "double") == ["1,234,567", "1,234.5", "0.25", "100"]


def test_badges(spark):
    level = lambda c: display.delay_badge(c)[1]
    assert apply(spark, level, [0, 1, 29, 30, -5], "int") == ["success", "warning", "warning", "danger", "warning"]
    assert apply(spark, lambda c: display.delay_badge(c)[0], [0, 12], "int") == ["On Time", "12 min"]


def test_class_names(spark):
    assert apply(spark, display.class_name, [2, 7, 99, None], "int") == ["car", "truck", "car", "car"]


def test_vehicle_label(spark):
    df = spark.createDataFrame([(1, 12, "in"), (2, 0, "out")], "t long, s long, d string")
    got = [r[0] for r in df.select(display.vehicle_label(F.col("t"), F.col("s"), F.col("d"))).collect()]
    assert got == ["#1 12 km/h in", "#2 out"]


def test_search_row(spark):
    df = spark.createDataFrame([(1, "Alpha"), (2, None)], "n int, s string")
    assert df.filter(text.search_row([F.col("n"), F.col("s")], "1 alp")).count() == 1


def test_latest_artifact(spark):
    rows = [("f", "v/uploaded_video9.mp4", 9), ("f", "v/processed_video1.mp4", 1), ("f", "v/processed_video2.avi", 2),
            ("f", "v/processed_video3.txt", 3), ("g", "v/uploaded_video.mov", 1), ("h", "v/other.mp4", 5)]
    files = spark.createDataFrame(rows, "folder string, path string, modified_at long")
    got = {r["folder"]: (r["path"], r["kind"]) for r in enrich.latest_artifact(files, ["folder"]).collect()}
    assert got == {"f": ("v/processed_video2.avi", "processed"), "g": ("v/uploaded_video.mov", "fallback")}


def test_valid_campaigns_and_the_outbox(spark):
    rows = [("1", "hello"), ("", "hello"), ("2", " "), ("3", None), ("4", "⚠️ none"), (None, "x"), ("5", "❌ bad")]
    df = spark.createDataFrame(rows, "customer_id string, marketing_copy string")
    assert [r[0] for r in enrich.valid_campaigns(df).collect()] == ["1"]
    box = work_path(spark, "box")
    for _ in range(2):
        enrich.send_campaigns(df, box, F.current_timestamp())
    assert spark.read.parquet(box).count() == 2


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        enrich.score_batch(spark.range(1), lambda m: None, "SLEEP", "id long")


@pytest.mark.parametrize(("size", "requests"), [(2, [None] * 2), (3, [3] * 3), (7, [7] * 7), (8, [5] * 5 + [3] * 3), (12, [5] * 5 + [7] * 7)])
def test_every_frame_of_a_sequence_comes_back(spark, size, requests):
    df = spark.range(size).withColumn("k", F.lit(None).cast("string"))
    load = lambda mode: lambda pdf: pdf[["id"]].assign(n=len(pdf))
    got = enrich.score_sequence(df, ["k"], ["id"], load, "RADAR", "id long, n long").collect()
    assert sorted((r["id"], r["n"], r["scored"]) for r in got) == [(i, n, n is not None) for i, n in enumerate(requests)]
