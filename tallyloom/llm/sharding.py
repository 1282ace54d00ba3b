"""Shards of bounded size by extendible hashing.

A directory maps prefixes of a row's hash to shards. It starts as one shard; a shard over the byte limit splits on the
next bit, until each fits or holds a single row. Bytes are summed per prefix, several bits at a time, and only rows of
shards that are still too large take part in the next round. Equal rows have equal hashes, so a second hash over a
frozen row number goes on where the first has run out of bits. Column expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tables import frozen

#: Bits of the first hash that are used, and of both together.
FIRST_BITS = 60
ALL_BITS = 120


@dataclass(frozen=True)
class Shards:
    """``limit``: bytes a shard may hold. ``step``: bits that one round looks ahead."""
    limit: int = 256 << 20
    step: int = 4


def key_bits(key: Column, text: Column, row: Column) -> Column:
    """120 bits as a string of 0 and 1: 60 of the key and content, 60 of the row number."""
    content = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))
    return F.concat(*[F.lpad(F.conv(F.substring(h, 1, 15), 16, 2), FIRST_BITS, "0") for h in (content, F.md5(row.cast("string")))])


def _leaves(rows: DataFrame, depth: int, ahead: int, limit: int) -> DataFrame:
    """``slot, shard, shard_bytes, shard_rows`` for every prefix of ``ahead`` bits in ``rows``: the shortest of its prefixes
    beyond ``depth`` bits that fits; null where none does. Rows are summed at the slots before anything is multiplied."""
    slots = frozen(rows.groupBy(F.substring("bits", 1, ahead).alias("slot")).agg(
        F.sum("n_bytes").alias("b"), F.count("*").alias("n")), "slots")
    each = slots.select("slot", "b", "n", F.explode(F.transform(F.sequence(F.lit(depth), F.lit(ahead)),
                                                                lambda d: F.substring("slot", 1, d))).alias("prefix"))
    sums = each.groupBy("prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).withColumn(
        "fits", (F.col("b") <= limit) | (F.col("n") <= 1) | (F.length("prefix") == ALL_BITS))
    best = each.select("slot", F.col("prefix").alias("p")).join(sums.filter("fits"), F.col("p") == F.col("prefix")).groupBy(
        "slot").agg(F.min(F.struct(F.length("p").alias("size"), "p", "b", "n")).alias("best"))
    return slots.select("slot").join(best.withColumnRenamed("slot", "s"), F.col("slot") == F.col("s"), "left").select(
        "slot", F.col("best.p").alias("shard"), F.col("best.b").alias("shard_bytes"), F.col("best.n").alias("shard_rows"))


def assign(docs: DataFrame, shards: Shards = Shards(), key: str = "doc_id", text: str = "text",
           carry: Sequence[str] | None = None) -> DataFrame:
    """A struct ``doc`` of the columns in ``carry`` (all but the text unless given), with ``n_bytes``, ``shard`` (its prefix;
    empty for an only shard), ``shard_bytes`` and ``shard_rows``.

    Null keys and null texts hash as such, an empty text has no bytes. A row beyond the limit is a shard by itself.
    Rows that are equal in all are told apart by a row number only. An empty table gives no shard.
    """
    carry = [c for c in docs.columns if c != text] if carry is None else list(carry)
    rows = frozen(docs.select(
        F.struct(*carry).alias("doc"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"),
        key_bits(F.col(key), F.col(text), F.monotonically_increasing_id()).alias("bits")), "entries")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    depth, ahead, out = 0, min((total // max(shards.limit, 1)).bit_length() + shards.step, ALL_BITS), None
    while True:
        leaves = frozen(_leaves(rows, depth, ahead, shards.limit), "leaves")
        placed = rows.join(leaves, F.substring("bits", 1, ahead) == F.col("slot"))
        done = placed.filter(F.col("shard").isNotNull()).select("doc", "n_bytes", "shard", "shard_bytes", "shard_rows")
        out = done if out is None else out.unionByName(done)
        if leaves.filter(F.col("shard").isNull()).isEmpty():
            return out
        rows = frozen(placed.filter(F.col("shard").isNull()).select("doc", "n_bytes", "bits"), "too-large")
        depth, ahead = ahead, min(ahead + shards.step, ALL_BITS)


def write_shards(docs: DataFrame, path: str, shards: Shards = Shards(), key: str = "doc_id", text: str = "text") -> None:
    """The documents as parquet, one folder a shard, each written by one task."""
    placed = assign(docs, shards, key, text, docs.columns)
    placed.select("doc.*", F.concat(F.lit("s"), "shard").alias("in_shard")).repartition("in_shard").write.partitionBy(
        "in_shard").parquet(path)


def oracle(limit: int) -> str:
    return f"""
WITH t AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, to_base(CAST('0x' || substr(md5(
             coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT), 2, 60) AS bits
           FROM documents),
p AS (SELECT doc_id, n_bytes, d, bits[1:d] AS shard, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_rows
      FROM (SELECT *, unnest(range(0, 61)) AS d FROM t) WINDOW w AS (PARTITION BY d, bits[1:d]))
SELECT doc_id, n_bytes::BIGINT AS n_bytes, shard, shard_bytes::BIGINT AS shard_bytes, shard_rows::BIGINT AS shard_rows FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS k FROM p WHERE shard_bytes <= {limit} OR shard_rows <= 1)
WHERE k = 1
"""
