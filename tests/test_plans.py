"""What the plans must and must not hold."""

import re

import pytest

from tallyloom.plans.all import BOOK

QUERIES = BOOK.queries
PYTHON = {"score_batch", "score_sequence", "campaign_udtf"}
#: Its model is asked, in Arrow batches, while the ledger is written; the rows then only join it.
LEDGER = {"chat_complete"}
STREAMS = {n for n in QUERIES if n.startswith("stream_")}


def plan(spark, data, name):
    return QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON - LEDGER - STREAMS))
def test_native_queries_stay_in_the_jvm(spark, data, name):
    text = plan(spark, data, name)
    assert not re.search(r"Python|ArrowEval|InPandas", text)
    assert "CartesianProduct" not in text


@pytest.mark.parametrize("name", sorted(PYTHON))
def test_python_queries_use_batches(spark, data, name):
    text = plan(spark, data, name)
    assert re.search(r"ArrowEvalPython|InPandas|InArrow", text) and "BatchEvalPython" not in text


def test_answers_are_written_before_use(spark, data):
    text = plan(spark, data, "chat_complete")
    assert "digest" in text and "answers" in text and not re.search("Python|InPandas", text)


def test_filters_reach_the_scan(spark, data):
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThan(o_orderdate" in plan(spark, data, "filter_compare")
    assert "In(o_orderstatus" in plan(spark, data, "active_count")
    assert "LessThan(c_acctbal" in plan(spark, data, "at_risk_customers")


@pytest.mark.parametrize("name, columns", [
    ("revenue_by_class", "l_extendedprice:double,l_returnflag:string"),
    ("status_distribution", "o_orderstatus:string"),
    ("flow_over_time", "ts:timestamp_ntz"),
    ("vehicle_max_speed", "event_id:bigint,value:double"),
])
def test_scans_read_only_what_is_asked(spark, data, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(spark, data, name)


@pytest.mark.parametrize("name", ["top_k", "top_routes", "top_airports", "limit_rows", "grid_page"])
def test_top_lists_never_sort_the_table(spark, data, name):
    assert "TakeOrderedAndProject" in plan(spark, data, name)


def test_vehicle_figures_are_hashed_before_the_shuffle(spark, data):
    text = plan(spark, data, "traffic_summary")
    below = text[text.rindex("Exchange hashpartitioning"):]
    assert "HashAggregate" in below and "SortAggregate" not in below


# These number a batch that was counted first; one beyond a million rows is cut into ranges, see test_ordering.
COUNTED = {"assign_keys", "dml_insert_keyed"}


def test_every_window_has_a_key(spark, data):
    for name in sorted(set(QUERIES) - STREAMS - COUNTED):
        for line in plan(spark, data, name).splitlines():
            if re.search(r"\+- Window \[|^Window \[", line):
                assert "windowspecdefinition(" in line
                first = line.split("windowspecdefinition(", 1)[1]
                assert not re.match(r"[^,]* (ASC|DESC) ", first), (name, line[:200])
