"""The named queries of this package, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import (chatformat, decontaminate, hostrules, inputs, maxent, packing, pii, prefixtrie, repair, secrets, sharding,
                           simhash, templates, urltree)
from tallyloom.llm.tables import frozen, table
from tallyloom.plans.book import Book
from tallyloom.session import work_path

LLM = Book()


def _number_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


@LLM.add("op4_quality_rules", hostrules.ORACLE)
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    rows = hostrules.measured(docs).select(F.struct("doc.doc_id").alias("doc"), "host", "m", "base_failed", "n_failed")
    rows = frozen(rows, "measures")
    judged = hostrules.judge(rows, hostrules.host_verdicts(rows))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc.doc_id", *[f"m.{n}" for n in names], "base_failed", "kept", "n_failed")


@LLM.add("op3_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.groups(table(spark, folder, "documents").select("doc_id", "text"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@LLM.add("op7_decontamination", decontaminate.ORACLE)
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.measured(docs, table(spark, folder, "benchmark"))
    return found.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@LLM.add("op10_personal_data")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", pii.spans(F.col("text")).alias("s"))
    base = F.filter("s", lambda x: x["kind"].isin(*pii.BASE))
    counts = [_number_of("s", kind).alias(f"n_{kind}") for kind in pii.BASE]
    return rows.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"),
                       pii.joined(F.col("s")).alias("spans"))


@LLM.add("op5_packing")
def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"))


@LLM.add("op1_secret_scan", secrets.ORACLE)
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    versions = table(spark, folder, "documents").select("doc_id", "text")
    ledger = work_path(spark, "secret-ledger")
    secrets.scan(versions, ledger)
    found = secrets.findings(versions, ledger)
    base = F.filter("spans", lambda x: x["rank"] < len(secrets.BASE))
    counts = [_number_of("spans", rule.name).alias(f"n_{rule.name}") for rule in secrets.BASE]
    return found.select("version.doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"),
                        secrets.joined(F.col("spans")).alias("spans"))


#: One object of a training loader.
SHARD_BYTES = 1 << 20


@LLM.add("op9_sharding", sharding.oracle(SHARD_BYTES))
def shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sharding.assign(docs, sharding.Shards(limit=SHARD_BYTES)).select("doc.doc_id", "n_bytes", "shard", "shard_bytes", "shard_rows")


@LLM.add("op6_url_filter", urltree.oracle())
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    urls = table(spark, folder, "pages").select("page_id", urltree.host_of(F.col("url")).alias("host"),
                                                urltree.path_of(F.col("url")).alias("path"))
    rule, bad = urltree.rule_for(F.col("host"), F.col("path"))
    judged = urltree.judge(urls.withColumn("rule", rule).withColumn("bad", bad))
    verdict = F.when(F.coalesce("doc.bad", "rejected"), "block").otherwise("allow")
    return judged.select("doc.page_id", "doc.host", "doc.path", "doc.rule", verdict.alias("verdict"), "template")


@LLM.add("op8_html_extraction")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    return templates.extract(table(spark, folder, "pages").select("page_id", "url", "html"))


@LLM.add("op2_language_model")
def language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counts, known, weights = maxent.model(docs)
    return maxent.score(docs, counts, known, weights)


@LLM.add("op11_prefix_trie", inputs.TRIE_ORACLE)
def prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns, ids = inputs.shared_starts(prefixtrie.marked(table(spark, folder, "conversations")))
    return prefixtrie.nodes(turns, ids).drop("last")


@LLM.add("op12_chat_format", chatformat.oracle(inputs.ADVERSE_SQL))
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = inputs.with_adverse(table(spark, folder, "conversations"))
    made = chatformat.formatted(turns.withColumn("parts", F.array(chatformat.text_part(F.col("text")))))
    text, learned = chatformat.whole_text(F.col("segments")), chatformat.learned_text(F.col("segments"))
    lines = F.transform(chatformat.read_back(text), lambda t: F.concat(
        t["role"], F.lit("\n"), F.array_join(F.transform(t["parts"], lambda p: p["text"]), ""), F.lit("\n")))
    return made.select("conv_id", F.size(lines).cast("long").alias("n_turns"),
                       F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
                       F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
                       F.char_length(text).cast("long").alias("formatted_chars"))


@LLM.add("op13_structure_repair", inputs.REPAIR_ORACLE)
def structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    found = repair.accounts(inputs.damaged(turns)).withColumnRenamed("conv_id", "found")
    ids = turns.select("conv_id").distinct()
    whole = ids.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left").drop("found")
    return whole.fillna(0).fillna("", ["audit"]).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
