"""Model calls: once for each distinct request, errors by row, a ledger that outlives jobs."""

import os

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import enrich


def asked(path):
    return sorted(open(path).read().split("\n")[:-1]) if os.path.exists(path) else []


def model(log, crash_at=None, flag=None):
    def answer(requests):
        with open(log, "a") as out:
            out.write("".join(f"{r}\n" for r in requests))
        if crash_at in requests and not os.path.exists(flag):
            open(flag, "w").close()
            os._exit(1)
        if any(r == "bad" for r in requests):
            raise ValueError("no such game")
        return [r.upper() for r in requests]
    return answer


def test_distinct_requests_are_asked_once(spark, tmp_path):
    log, ledger = str(tmp_path / "log"), str(tmp_path / "ledger")
    df = spark.createDataFrame([(k, w) for k, w in enumerate(["a", "b", "a", None, "bad", "", "a", "bad"])], "id long, request string").selectExpr(
        "*", "1 AS digest", "2 AS error").repartition(3)
    got = {r.id: (r.said, r.said_error) for r in enrich.complete(df, model(log), "request", "said", ledger, "m1").collect()}
    assert got[0] == got[2] == got[6] == ("A", None) and got[1] == ("B", None) and got[5] == ("", None) and got[3] == (None, None)
    assert got[4] == got[7] == (None, "ValueError: no such game")
    assert asked(log) == ["", "a", "b", "bad"]
    again = df.unionByName(spark.createDataFrame([(9, "c", 1, 2)], df.schema))
    got = {r.id: r.said for r in enrich.complete(again, model(log), "request", "said", ledger, "m1").collect()}
    assert got[0] == "A" and got[9] == "C" and asked(log) == ["", "a", "b", "bad", "bad", "c"]
    enrich.complete(df.filter("request = 'a'"), model(log), "request", "said", ledger, "m2").collect()
    assert asked(log).count("a") == 2


def test_a_task_that_dies_half_way_repeats_one_call(spark, tmp_path):
    log, ledger, flag = (str(tmp_path / n) for n in ("log", "ledger", "flag"))
    df = spark.range(30).select(F.concat(F.lit("r"), F.format_string("%02d", "id")).alias("request"))
    with pytest.raises(Exception):
        enrich.complete(df, model(log, "r17", flag), "request", "said", ledger)
    before = asked(log)
    assert "r17" in before
    got = enrich.complete(df, model(log, "r17", flag), "request", "said", ledger)
    assert sorted(r.said for r in got.collect()) == [f"R{k:02d}" for k in range(30)]
    calls = asked(log)
    assert calls.count("r17") == 2 and len(calls) <= 30 + 8 and set(calls) == {f"r{k:02d}" for k in range(30)}
    assert not os.path.exists(f"{ledger}/pending")


def test_several_requests_in_a_call(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("bad",), ("c",), ("d",)], "request string").coalesce(1)
    got = {r.request: (r.said, r.said_error) for r in enrich.complete(df, model(str(tmp_path / "log")), "request", "said", at_once=4).collect()}
    assert got == {"a": ("A", None), "bad": (None, "ValueError: no such game"), "c": ("C", None), "d": ("D", None)}


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "request string")
    assert enrich.complete(df, model(str(tmp_path / "log")), "request", "said").count() == 0
