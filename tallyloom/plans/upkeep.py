"""Table maintenance: changes that come from one table, applied to another."""

from __future__ import annotations

from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tallyloom.operators import maintain
from tallyloom.plans import bindings as b
from tallyloom.plans.book import BOOK
from tallyloom.session import work_path
from tallyloom.sources import buckets

COLUMNS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
FAR = 10**9


def _newcomers(spark, folder):
    """Suppliers in the shape of customers, under keys that customers have too."""
    return b.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"), F.lit("SUPPLY").alias("c_mktsegment"))


NEWCOMERS = "SELECT s_suppkey AS c_custkey, s_name AS c_name, s_nationkey AS c_nationkey, s_acctbal AS c_acctbal, 'SUPPLY' AS c_mktsegment FROM supplier"


@BOOK.add("dml_insert", f"SELECT {COLUMNS} FROM customer UNION ALL {NEWCOMERS}")
def dml_insert(spark, folder):
    return maintain.insert(b.customers(spark, folder), _newcomers(spark, folder))


KEYED = f"""SELECT (SELECT coalesce(max(c_custkey), 0) FROM customer) + row_number() OVER (ORDER BY s_suppkey) AS c_custkey, s_name AS c_name,
       s_nationkey AS c_nationkey, s_acctbal AS c_acctbal, 'SUPPLY' AS c_mktsegment FROM supplier"""


@BOOK.add("assign_keys", KEYED)
def assign_keys(spark, folder):
    batch = _newcomers(spark, folder).withColumnRenamed("c_custkey", "batch_no")
    return maintain.assign_keys(b.customers(spark, folder), batch, "c_custkey", ["batch_no"]).drop("batch_no")


@BOOK.add("dml_insert_keyed", f"SELECT {COLUMNS} FROM customer UNION ALL {KEYED}")
def dml_insert_keyed(spark, folder):
    batch = _newcomers(spark, folder).withColumnRenamed("c_custkey", "batch_no")
    return maintain.insert_keyed(b.customers(spark, folder), batch, "c_custkey", ["batch_no"])


_MOVED = f"CASE WHEN s_acctbal < 1000 THEN s_suppkey + {FAR} ELSE s_suppkey END"


@BOOK.add("dml_update", f"""
SELECT c.c_custkey, CASE WHEN u.k IS NULL THEN c.c_name ELSE u.s_name END AS c_name, c.c_nationkey,
       CASE WHEN u.k IS NULL THEN c.c_acctbal ELSE u.balance END AS c_acctbal, c.c_mktsegment
FROM customer c LEFT JOIN (SELECT {_MOVED} AS k, s_name, CASE WHEN s_acctbal < 5000 THEN s_acctbal END AS balance FROM supplier) u
ON c.c_custkey = u.k""")
def dml_update(spark, folder):
    """Names and balances from suppliers: some keys are missing, some balances are set to null."""
    moved = F.when(F.col("s_acctbal") < 1000, F.col("s_suppkey") + FAR).otherwise(F.col("s_suppkey"))
    changes = b.table(spark, folder, "supplier").select(
        moved.alias("c_custkey"), F.col("s_name").alias("c_name"),
        F.when(F.col("s_acctbal") < 5000, F.col("s_acctbal")).alias("c_acctbal"))
    return maintain.update(b.customers(spark, folder), changes, "c_custkey")


@BOOK.add("dml_replace", f"""
SELECT {COLUMNS} FROM customer WHERE c_custkey NOT IN (SELECT {_MOVED} FROM supplier)
UNION ALL SELECT s_suppkey + {2 * FAR}, s_name, s_nationkey, s_acctbal, 'SUPPLY' FROM supplier""")
def dml_replace(spark, folder):
    moved = F.when(F.col("s_acctbal") < 1000, F.col("s_suppkey") + FAR).otherwise(F.col("s_suppkey"))
    rows = b.table(spark, folder, "supplier").select(
        moved.alias("old_key"), (F.col("s_suppkey") + 2 * FAR).alias("c_custkey"), F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit("SUPPLY").alias("c_mktsegment"))
    return maintain.replace(b.customers(spark, folder), rows, "c_custkey")


@BOOK.add("dml_delete", "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000)")
def dml_delete(spark, folder):
    gone = b.table(spark, folder, "supplier").filter("s_acctbal < 5000").select(F.col("s_suppkey").alias("c_custkey"))
    return maintain.delete(b.customers(spark, folder), gone, "c_custkey")


@BOOK.add("dml_rollback", f"SELECT {COLUMNS} FROM customer")
def dml_rollback(spark, folder):
    """A change set that is committed and rolled back, and one that fails half way: the table reads as before."""
    root = work_path(spark, "customer")
    first = buckets.create(b.customers(spark, folder), root, ["c_custkey"])
    rows = _newcomers(spark, folder).withColumn("seq", F.col("c_custkey")).withColumn("op", F.lit("replace")).withColumn(
        "old_key", F.col("c_custkey"))
    maintain.commit_changes(spark, root, rows, "c_custkey")
    buckets.roll_back(spark, root, first)
    broken = F.when(F.col("c_custkey") % 97 == 0, F.raise_error(F.lit("no such balance")).cast("double")).otherwise(F.lit(0.0))
    try:
        maintain.commit_changes(spark, root, rows.withColumn("c_acctbal", broken), "c_custkey")
    except SparkRuntimeException as error:
        if "no such balance" not in str(error):
            raise
    return buckets.read(spark, root).select(*COLUMNS.split(", "))
