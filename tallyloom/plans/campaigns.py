"""Campaigns for customers at risk, and model scoring of feature vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tallyloom.operators import enrich
from tallyloom.plans import bindings as b
from tallyloom.plans.book import BOOK
from tallyloom.session import work_path

AT_RISK = "c_acctbal < 0"
COPY_SQL = "'Dear ' || c_name || ', we have an offer for ' || lower(c_mktsegment) || ' customers. Reference ' || c_custkey || '.'"


def _at_risk(spark, folder):
    return b.customers(spark, folder).filter(AT_RISK)


def _campaigns(spark, folder):
    copy = enrich.campaign_text(F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment"))
    return _at_risk(spark, folder).select(F.col("c_custkey").alias("customer_id"), copy.alias("marketing_copy"), "c_mktsegment")


@BOOK.add("campaign_for_all", f"""
SELECT c_custkey AS customer_id, {COPY_SQL} AS marketing_copy,
       'Customer ID: ' || c_custkey || chr(10) || repeat('=', 60) || chr(10) || {COPY_SQL} AS report FROM customer WHERE {AT_RISK}""")
def campaign_for_all(spark, folder):
    report = enrich.campaign_report(F.col("customer_id"), F.col("marketing_copy"))
    return _campaigns(spark, folder).withColumn("report", report).drop("c_mktsegment")


DAMAGED_SQL = f"""SELECT c_custkey AS customer_id, CASE c_mktsegment WHEN 'BUILDING' THEN '⚠️ No marketing copy generated' WHEN 'MACHINERY' THEN '  '
       WHEN 'FURNITURE' THEN NULL ELSE {COPY_SQL} END AS marketing_copy FROM customer WHERE {AT_RISK}"""


def _damaged(spark, folder):
    """Campaigns of which some failed: a warning, a blank, a null."""
    segment = F.col("c_mktsegment")
    copy = (F.when(segment == "BUILDING", F.lit("⚠️ No marketing copy generated")).when(segment == "MACHINERY", F.lit("  "))
            .when(segment != "FURNITURE", F.col("marketing_copy")))
    return _campaigns(spark, folder).select("customer_id", copy.alias("marketing_copy"))


@BOOK.add("valid_campaigns", f"""
SELECT * FROM ({DAMAGED_SQL}) WHERE trim(marketing_copy) <> '' AND marketing_copy NOT LIKE '%⚠️%' AND marketing_copy NOT LIKE '%❌%'""")
def valid_campaigns(spark, folder):
    return enrich.valid_campaigns(_damaged(spark, folder))


@BOOK.add("campaign_outbox", f"""
SELECT *, TIMESTAMP '2024-02-01 00:00:00' AS sent_at FROM ({DAMAGED_SQL})
WHERE trim(marketing_copy) <> '' AND marketing_copy NOT LIKE '%⚠️%' AND marketing_copy NOT LIKE '%❌%'""")
def campaign_outbox(spark, folder):
    outbox = work_path(spark, "outbox")
    enrich.send_campaigns(_damaged(spark, folder), outbox, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return spark.read.parquet(outbox)


@udtf(returnType="channel string, copy string", useArrow=True)
class CampaignCopy:
    """Messages for one customer: one by mail, and one by text for those deep in debt."""

    def eval(self, customer_id: int, name: str, balance: float):
        yield "mail", f"{name}: offer {customer_id}"
        if balance < -500:
            yield "text", f"{name}: call us"


UDTF_SQL = f"""
SELECT c_custkey, 'mail' AS channel, c_name || ': offer ' || c_custkey AS copy FROM customer WHERE {AT_RISK}
UNION ALL SELECT c_custkey, 'text', c_name || ': call us' FROM customer WHERE {AT_RISK} AND c_acctbal < -500"""


@BOOK.add("campaign_udtf", UDTF_SQL)
def campaign_udtf(spark, folder):
    """The table function called for every customer at risk."""
    joined = enrich.per_customer(_at_risk(spark, folder), CampaignCopy, "c_custkey", "c_name", "c_acctbal")
    return joined.select("c_custkey", "channel", "copy")


@BOOK.add("campaign_lateral", UDTF_SQL)
def campaign_lateral(spark, folder):
    """The same rows from columns alone, without Python."""
    mail = F.struct(F.lit("mail").alias("channel"), F.concat("c_name", F.lit(": offer "), F.col("c_custkey").cast("string")).alias("copy"))
    message = F.struct(F.lit("text").alias("channel"), F.concat("c_name", F.lit(": call us")).alias("copy"))
    copies = F.when(F.col("c_acctbal") < -500, F.array(mail, message)).otherwise(F.array(mail))
    return _at_risk(spark, folder).select("c_custkey", F.inline(copies))


def weighted_model(mode):
    """Stands in for a frame model: a weighted sum whose weights follow the mode."""
    scale = enrich.MODES.index(mode) + 1

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(batch["embedding"].to_numpy()).astype("float64") if len(batch) else np.zeros((0, 1))
        weights = (np.arange(vectors.shape[1]) % 7 + 1) * scale
        return pd.DataFrame({"vec_id": batch["vec_id"], "mode": mode, "score": np.round(vectors @ weights, 4)})
    return score


@BOOK.add("score_batch", """
SELECT vec_id, mode, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * ((i - 1) % 7 + 1) * scale)), 4) AS score
FROM embeddings, (SELECT 'BALL_DETECTION' AS mode, 3 AS scale)""")
def score_batch(spark, folder):
    rows = b.table(spark, folder, "embeddings").select("vec_id", "embedding")
    return enrich.score_batch(rows, weighted_model, "BALL_DETECTION", "vec_id long, mode string, score double")


def motion_model(mode):
    """Stands in for a tracking model: how far each frame is from the one before it in the request."""
    def score(batch: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(batch["embedding"].to_numpy()).astype("float64")
        steps = np.sqrt((np.diff(vectors, axis=0) ** 2).sum(axis=1))
        return pd.DataFrame({"label": batch["label"], "vec_id": batch["vec_id"], "motion": np.round(np.concatenate([[0.0], steps]), 4)})
    return score


@BOOK.add("score_sequence", """
WITH placed AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n,
                       count(*) OVER (PARTITION BY label) AS size FROM embeddings),
sized AS (SELECT *, least(n // 5, greatest(size - 3, 0) // 5) AS request FROM placed),
steps AS (SELECT *, lag(e) OVER (PARTITION BY label, request ORDER BY vec_id) AS before FROM sized)
SELECT label, vec_id, size >= 3 AS scored,
       CASE WHEN size >= 3 THEN round(CASE WHEN before IS NULL THEN 0.0 ELSE list_distance(e, before) END, 4) END AS motion FROM steps""")
def score_sequence(spark, folder):
    rows = b.table(spark, folder, "embeddings")
    return enrich.score_sequence(rows, ["label"], ["vec_id"], motion_model, "PLAYER_TRACKING", "label int, vec_id long, motion double")
