"""The named queries over the given tables, beside their SQL where there is any."""

import re

import pytest
from compare import difference

import __spark_entry__ as entry
from tallyloom.llm.queries import LLM

NATIVE = ("op1_", "op4_", "op6_", "op9_", "op12_")


@pytest.mark.parametrize("name", sorted(LLM.queries))
def test_query(spark, data, name):
    assert difference(LLM.queries[name], LLM.oracles.get(name), spark, data) is None


@pytest.mark.parametrize("name", sorted(n for n in LLM.queries if n.startswith(NATIVE)))
def test_native_queries_have_no_python(spark, data, name):
    plan = LLM.queries[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_all_thirteen_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


def test_every_document_has_one_row(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").count()
    for name in ("op1_secret_scan", "op2_language_model", "op3_simhash_near_dedup", "op4_quality_rules", "op7_decontamination",
                 "op9_sharding", "op10_personal_data"):
        rows = LLM.queries[name](spark, data).select("doc_id").collect()
        assert len(rows) == len({r.doc_id for r in rows}) == docs


def test_conversation_queries_over_an_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").limit(0).write.parquet(f"{tmp_path}/conversations.parquet")
    assert LLM.queries["op11_prefix_trie"](spark, str(tmp_path)).count() == 0
    assert [r.conv_id for r in LLM.queries["op12_chat_format"](spark, str(tmp_path)).collect()] == [-1]
    assert LLM.queries["op13_structure_repair"](spark, str(tmp_path)).count() == 0
