"""Structured requests: joins of every kind and size, typed literals, refusals."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import cells, pairing, request as rq
from tallyloom.operators.request import Filter, Join, Measure, Request, run_request


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(3)
    left = pd.DataFrame({"id": range(90), "x": [rng.choice([None, *range(12)]) for _ in range(90)]})
    right = pd.DataFrame({"no": range(70), "y": [rng.choice([None, *range(3, 20)]) for _ in range(70)]})
    left["x"], right["y"] = left["x"].astype("Int64"), right["y"].astype("Int64")
    make = lambda pdf, schema: spark.createDataFrame([tuple(None if pd.isna(v) else int(v) for v in r) for r in pdf.values], schema)
    return left, right, make(left, "id long, x long"), make(right, "no long, y long")


def joined(df):
    return sorted((tuple(r) for r in df.select("l.id", "r.no").collect()), key=repr)


def expected(left, right, on, how):
    con = duckdb.connect()
    con.register("l", left)
    con.register("r", right)
    return sorted(con.sql(f"SELECT l.id, r.no FROM l {how} JOIN r ON {on}").fetchall(), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("op", ["<", "<=", ">", ">=", "!="])
@pytest.mark.parametrize("small_rows", [0, 1000])
def test_comparison_join(sides, op, how, small_rows):
    left, right, l, r = sides
    got = pairing.comparison_join(pairing.Side(l.alias("l"), "l", "x"), pairing.Side(r.alias("r"), "r", "y"), op, how,
                                  small_rows=small_rows, ranges=5)
    assert joined(got) == expected(left, right, f"l.x {op} r.y", how)


@pytest.mark.parametrize("op, fan, broadcast", [("<", 1024, True), ("<=", 3, True), (">", 3, False), (">=", 3, True), ("!=", 3, False)])
def test_comparison_of_large_sides_with_hot_values(spark, monkeypatch, op, fan, broadcast):
    """A value holds a third of each side, once of equal rows; branches of cut points are looked up either way."""
    monkeypatch.setattr(cells, "FAN", fan)
    monkeypatch.setattr(cells, "is_small", lambda df: broadcast)
    rng = random.Random(6)
    left = pd.DataFrame({"id": [7 if k % 3 == 0 else k for k in range(150)], "x": [500 if k % 3 == 0 else rng.randint(0, 900) for k in range(150)]})
    right = pd.DataFrame({"no": range(240), "y": [500 if k % 3 == 0 else rng.randint(100, 1000) for k in range(240)]})
    l, r = spark.createDataFrame(left).repartition(5), spark.createDataFrame(right).repartition(3)
    got = pairing.comparison_join(pairing.Side(l.alias("l"), "l", "x"), pairing.Side(r.alias("r"), "r", "y"), op, "full", small_rows=-1, ranges=12)
    assert got.columns == ["id", "x", "no", "y"]
    assert joined(got) == expected(left, right, f"l.x {op} r.y", "full")


@pytest.mark.parametrize("kinds", [("string", "string"), ("double", "int"), ("int", "string"), ("decimal(12,3)", "double")])
def test_comparison_of_large_sides_of_several_kinds(spark, kinds):
    values = [-10.5, -3.0, 0.0, 2.0, 2.5, 9.0, 10.0, 100.0, None]
    l = spark.createDataFrame([(k, values[k % 9]) for k in range(60)], "id long, x double").withColumn("x", F.col("x").cast("int" if kinds[1] == "string" else "double").cast(kinds[0]))
    r = spark.createDataFrame([(k, values[k * 5 % 9]) for k in range(70)], "no long, y double").withColumn("y", F.col("y").cast("int").cast(kinds[1]))
    l, r = l.alias("l"), r.alias("r")
    for op in ("<", "!="):
        want = joined(l.join(F.broadcast(r), pairing.compare(op, F.col("l.x"), F.col("r.y")), "left"))
        got = pairing.comparison_join(pairing.Side(l, "l", "x"), pairing.Side(r, "r", "y"), op, "left", small_rows=0, ranges=7)
        assert joined(got) == want


def test_no_cell_is_large_and_copies_follow_the_answer(spark):
    """Half of the right side has one value; with < few left rows lie below it, so few copies are made."""
    n, block = 40_000, 1_000
    left = spark.range(n).select((F.col("id") + n).alias("x"))
    right = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, n + 100).otherwise(F.col("id")).alias("y"))
    places = cells.lay_out(left, F.col("x"), right, F.col("y"), ranges=40)
    spread = cells.with_cells(left, F.col("x"), "l", "<", places, None, block)
    dealt = cells.with_cells(right, F.col("y"), "r", "<", places, None, block)
    answer = 100 * n // 2
    assert spread.count() < 3 * (answer / block + block) and dealt.count() < 3 * (answer / block + n)
    assert dealt.groupBy("_r_l", "_r_r").count().agg(F.max("count")).first()[0] < 2 * block
    assert spread.groupBy("_l_l", "_l_r").count().agg(F.max("count")).first()[0] < 2 * block
    same = spark.range(n).select(F.lit(5).alias("y"))
    places = cells.lay_out(same, F.col("y"), same, F.col("y"), ranges=40)
    assert cells.with_cells(same, F.col("y"), "l", "!=", places, None, block).isEmpty()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_comparison_join_with_nothing_on_the_right(sides, how):
    left, right, l, r = sides
    none = r.filter("y > 1000")
    got = pairing.comparison_join(pairing.Side(l.alias("l"), "l", "x"), pairing.Side(none.alias("r"), "r", "y"), "<", how,
                                  small_rows=-1, ranges=5)
    assert joined(got) == expected(left, right[right["y"] > 1000], "l.x < r.y", how)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("small_rows", [0, 1000])
def test_pattern_join(spark, how, small_rows):
    left = pd.DataFrame({"id": range(40), "x": [f"{'ab'[i % 2]}{i % 7}" if i % 9 else None for i in range(40)]})
    right = pd.DataFrame({"no": range(6), "y": ["a%", "%3", "zzz", None, "b_", "a%"]})
    l = spark.createDataFrame([tuple(v) for v in left.astype(object).where(left.notna(), None).values], "id long, x string")
    r = spark.createDataFrame([tuple(v) for v in right.astype(object).where(right.notna(), None).values], "no long, y string")
    got = pairing.pattern_join(pairing.Side(l.alias("l"), "l", "x"), pairing.Side(r.alias("r"), "r", "y"), how, small_rows, 4)
    assert joined(got) == expected(left, right, "l.x LIKE r.y", how)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("small_rows", [0, 1000])
def test_literal_join(sides, how, small_rows):
    left, right, l, r = sides
    got = pairing.literal_join(l.alias("l"), r.alias("r"), F.col("l.x") == 5, how, small_rows, 4)
    assert joined(got) == expected(left, right, "l.x = 5", how)


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Ann", "2024-01-01", 10.5, "x"), (2, "O'Hare", "2024-02-01", None, "y"), (3, None, None, 3.0, "x")]
    df = spark.createDataFrame(rows, "id int, name string, day string, pay double, team string")
    return {"people": df.withColumn("day", F.col("day").cast("timestamp_ntz"))}


def ids(frame):
    return sorted(r["id"] for r in frame.collect())


def test_date_literal_is_a_date(people):
    assert ids(run_request(Request("people", filters=(Filter("day", ">", "2024-01-15"),)), people)) == [2]


def test_literal_of_the_wrong_type_is_refused(people):
    with pytest.raises(rq.RequestError):
        run_request(Request("people", filters=(Filter("id", "=", "abc"),)), people)


def test_quote_in_a_filter_and_in_an_expression(people):
    assert ids(run_request(Request("people", filters=(Filter("name", "=", "O'Hare"),)), people)) == [2]
    got = run_request(Request("people", columns=("id",), expressions=(("said", "concat('It''s ', name)"),)), people)
    assert [r["said"] for r in got.orderBy("id").collect()] == ["It's Ann", "It's O'Hare", None]


def test_in_list_drops_blanks_and_column_in_column_is_equality(people):
    assert ids(run_request(Request("people", filters=(Filter("id", "IN", " 1, ,3,"),)), people)) == [1, 3]
    assert ids(run_request(Request("people", filters=(Filter("team", "IN", other="team"),)), people)) == [1, 2, 3]


def test_filter_without_value_is_ignored(people):
    assert ids(run_request(Request("people", filters=(Filter("id", "=", "  "),)), people)) == [1, 2, 3]


@pytest.mark.parametrize("bad", [
    Request("nobody"),
    Request("people", columns=("height",)),
    Request("people", filters=(Filter("id", "~", "1"),)),
    Request("people", columns=("name",), group_by=("team",), measures=(Measure("COUNT"),)),
    Request("people", measures=(Measure("FIRST", "name"),)),
    Request("people", measures=(Measure("MEDIAN", "pay"),)),
    Request("people", joins=(Join("people", "CROSS JOIN", "id", "=", "id"),)),
    Request("people", joins=(Join("people", "INNER JOIN", "id"),)),
])
def test_refusals(people, bad):
    with pytest.raises(rq.RequestError):
        run_request(bad, people)


def test_star_keeps_both_columns_of_one_name(people):
    got = run_request(Request("people", joins=(Join("people", "INNER JOIN", "team", "=", "team", alias="mate"),)), people)
    assert "mate_id" in got.columns and got.count() == 5


def test_default_limit_and_sort(spark):
    tables = {"t": spark.range(500).toDF("n")}
    got = [r[0] for r in run_request(Request("t", order_by=("n DESC",)), tables).collect()]
    assert got == list(range(499, 399, -1))
    assert run_request(Request("t", limit=0), tables).count() == 500


def test_first_and_last_skip_nulls(people):
    got = run_request(Request("people", measures=(
        Measure("FIRST", "pay", order_by="id"), Measure("LAST", "name", order_by="id"))), people).first()
    assert (got["first_pay"], got["last_name"]) == (10.5, "O'Hare")


def test_group_columns_are_selected_once(people):
    got = run_request(Request("people", group_by=("team", "team"), measures=(Measure("COUNT", "pay"),)), people)
    assert got.columns == ["team", "count_pay"]
    assert sorted(tuple(r) for r in got.collect()) == [("x", 2), ("y", 0)]


@pytest.mark.parametrize("hot_rows", [3, 10**6])
@pytest.mark.parametrize("part_size", [1, 4, 1000])
def test_concat_parts_make_the_whole(spark, hot_rows, part_size):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.7 else "b", rng.choice(["p", "q", "r", None, "s"])) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, v string")
    got = rq.concat_parts(df, ["g"], "v", "|", part_size, hot_rows).orderBy("g", "part").collect()
    for g in "ab":
        pieces = [r for r in got if r["g"] == g]
        assert [r["part"] for r in pieces] == list(range(len(pieces)))
        assert all(len(r["v"].split("|")) <= part_size for r in pieces)
        assert "|".join(r["v"] for r in pieces) == "|".join(sorted(v for k, v in rows if k == g and v))


def test_text_beside_figures_without_groups(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "n int, s string")
    measures = (Measure("CONCAT_WS", "s"), Measure("SUM", "n"))
    assert [tuple(r) for r in run_request(Request("t", measures=measures), {"t": df}).collect()] == [(6, "a,b")]
    none = df.filter("s IS NULL")
    assert [tuple(r) for r in run_request(Request("t", measures=measures), {"t": none}).collect()] == [(2, None)]
    assert [tuple(r) for r in run_request(Request("t", measures=measures[:1]), {"t": none}).collect()] == [(None,)]


def test_large_group_is_one_row_under_the_default_limit(spark):
    df = spark.range(250_000).selectExpr("'g' AS g", "lpad(id, 6, '0') AS v").unionByName(spark.createDataFrame([("h", None)], "g string, v string"))
    got = run_request(Request("t", group_by=("g",), measures=(Measure("CONCAT_WS", "v"),)), {"t": df}).collect()
    assert sorted((r["g"], (r["concat_ws_v"] or "").count(",")) for r in got) == [("g", 249_999), ("h", 0)]
    assert next(r for r in got if r["g"] == "g")["concat_ws_v"].startswith("000000,000001,000002,")


def test_several_texts_and_expressions_in_a_grouped_request(people):
    got = run_request(Request("people", group_by=("team",), expressions=(("big", "upper(team)"), ("more", "sum(pay) + 1")), measures=(
        Measure("CONCAT_WS", "name"), Measure("CONCAT_WS", "id", separator="-"))), people)
    assert sorted(tuple(r) for r in got.collect()) == [("x", "X", 14.5, "Ann", "1-3"), ("y", "Y", None, "O'Hare", "2")]
    for bad in ((("bad", "upper(name)"),), (("bad", "upper("),)):
        with pytest.raises(rq.RequestError):
            run_request(Request("people", group_by=("team",), expressions=bad), people)


def test_numbers_and_times_are_not_rounded(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 10.00, DATE '2024-01-01', 0.1D), (2, 10.01, DATE '2024-01-02', 0.2D) AS t(id, p, d, x)").selectExpr(
        "id", "CAST(p AS DECIMAL(10,2)) AS p", "d", "x")
    run = lambda *f: ids(run_request(Request("t", filters=(Filter(*f),)), {"t": df}))
    assert run("p", "<=", "10.005") == [1] and run("p", "=", "10.010") == [2] and run("id", ">", "1.5") == [2]
    assert run("id", "IN", "1.0, 2.5, 7") == [1] and run("d", "<", "2024-01-01 12:00:00") == [1] and run("d", "=", "2024-01-02") == [2]
    assert run("x", "=", "0.1") == [1] and run("id", "<", "99999999999999999999") == [1, 2]
    for text in ("1e99", "abc", "NaN", "1" * 40):
        with pytest.raises(rq.RequestError):
            run("id", "=", text)


def test_a_list_of_dates_is_read_at_once(spark, monkeypatch):
    df = spark.sql("SELECT CAST(id AS INT) AS id, date_add(DATE '2024-01-01', CAST(id AS INT)) AS d, id % 2 = 0 AS even FROM range(90)")
    asked, plain = [], type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, *a, **k: asked.append(a) or plain(self, *a, **k))
    days = ", ".join(f"2024-01-{n:02d}" for n in range(1, 31))
    assert ids(run_request(Request("t", filters=(Filter("d", "IN", days),)), {"t": df})) == list(range(30)) and len(asked) == 1
    assert len(ids(run_request(Request("t", filters=(Filter("even", "=", "true"),)), {"t": df}))) == 45
    with pytest.raises(rq.RequestError, match="'soon'"):
        run_request(Request("t", filters=(Filter("d", "IN", "2024-01-01, soon"),)), {"t": df})


def test_sort_by_a_column_that_is_not_shown(people):
    got = run_request(Request("people", columns=("name",), order_by=("id DESC",)), people)
    assert got.columns == ["name"] and [r[0] for r in got.collect()] == [None, "O'Hare", "Ann"]
    with pytest.raises(rq.RequestError):
        run_request(Request("people", columns=("name",), order_by=("height",)), people)


def test_wide_rows_are_not_small(spark):
    from tallyloom.operators.ordering import is_small
    wide = spark.range(1000).select(F.expr("repeat('x', 200000)").alias("t"))
    assert not is_small(wide) and is_small(wide.limit(100)) and is_small(spark.range(1000)) and not is_small(spark.range(60_000))
    assert is_small(spark.range(0))


@pytest.mark.parametrize("limits", [{"HOT_ROWS": 40}, {"GROUP_BYTES": 90}, {}])
def test_texts_of_large_groups_beside_other_figures(spark, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(rq, name, value)
    rows = [("big", f"v{k % 37:03d}", k) for k in range(100)] + [("small", "b", 1), ("small", None, 2), ("small", "a", 3), (None, "n", 4), ("none", None, 5)]
    table = spark.createDataFrame(rows, "g string, v string, n long").repartition(3)
    measures = (Measure("CONCAT_WS", "v", separator="|"), Measure("COUNT"), Measure("SUM", "n"))
    got = {r.g: (r.concat_ws_v, r.count_all, r.sum_n) for r in run_request(Request("t", group_by=("g",), limit=0, measures=measures), {"t": table}).collect()}
    assert got == {"big": ("|".join(sorted(f"v{k % 37:03d}" for k in range(100))), 100, sum(range(100))), "small": ("a|b", 3, 6), None: ("n", 1, 4),
                   "none": (None, 1, 5)}
    one = run_request(Request("t", limit=0, measures=measures), {"t": table}).collect()
    assert len(one) == 1 and one[0].concat_ws_v.startswith("a|b|n|v000|v000") and one[0].count_all == 105


ODD_TEXTS = ["", "%", "_", "a", "ab", "abc", "abcd", "xabcx", "a%b", "a_b", "a\\b", "", "x", "é_ü", "a\x02b", "\x03", "line\nbreak", "ABC", None]
ODD_PATTERNS = ["", "%", "_", "__", "a%", "%a", "%a%", "abc", "%abc%", "a\\%b", "a\\_b", "a\\\\b", "%\\%%", "_b%", "a%b%c", "%bc_", "", "%", "%zzz%",
                "é%ü", "%\x02%", "%\nb%", None, "%%a%%", "ab%"]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_patterns_of_two_large_sides(spark, how):
    rng = random.Random(3)
    texts = [(k, t) for k, t in enumerate(ODD_TEXTS * 2 + ["".join(rng.choices("abc%_é", k=rng.randint(0, 6))) for _ in range(80)])]
    patterns = [(k, p) for k, p in enumerate(ODD_PATTERNS * 2 + ["".join(rng.choices("abc%%_é", k=rng.randint(0, 5))) for _ in range(60)])]
    left = spark.createDataFrame(texts, "id long, t string").alias("l")
    right = spark.createDataFrame(patterns, "no long, p string").alias("r")
    sides = pairing.Side(left, "l", "t"), pairing.Side(right, "r", "p")
    want = left.join(F.broadcast(right) if how != "full" else right, F.like(F.col("l.t"), F.col("r.p")), how).select("id", "t", "no", "p")
    got = pairing.pattern_join(*sides, how, small_rows=1).select("id", "t", "no", "p")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_two_hundred_thousand_texts_and_patterns(spark):
    n = 200_000
    texts = spark.range(n).select(F.concat(F.lit("customer "), F.md5(F.col("id").cast("string"))).alias("_text"))
    patterns = spark.range(n).select(F.concat(F.lit("%"), F.substring(F.md5(F.col("id").cast("string")), 3, 9), F.lit("%")).alias("_pattern"))
    compared = pairing.like_candidates(texts, patterns.distinct())
    assert compared.count() < 200 * n  # of 200,000 times 200,000
    few = spark.range(50).select(F.concat(F.lit("%"), F.substring(F.md5(F.col("id").cast("string")), 3, 9), F.lit("%")).alias("_pattern"))
    found = pairing.like_matches(texts, few)
    assert found.select("_pattern").distinct().count() == few.distinct().count()
    want = texts.join(F.broadcast(few.distinct()), F.like("_text", F.col("_pattern")))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
