"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tables import frozen


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
                        .alias("e")).select("e.u", "e.v")


def roots(edges: DataFrame) -> DataFrame:
    """``u, v`` edges to ``node, root`` for every node that has an edge; the root is the least node of its component.

    Large-star and small-star steps in turn until the edges form stars. Each step needs only the least neighbour of a
    node, which is summed up before the shuffle, and a join that Spark may split where one node has very many
    neighbours. Steps are written to the shared folder, so nothing is computed twice and a lost executor costs
    only the step at hand. No edge gives no row; loops and repeated edges do no harm.
    """
    now = frozen(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                 "edges")
    before = None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sign["n"] == 0 or sign == before:
            break
        before = sign
        near = _both_ways(now)
        least = near.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        large = near.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = frozen(large.filter("u <> v").distinct(), "large-star")
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        hung = large.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hung.unionAll(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        now = frozen(small.filter("u <> v").distinct(), "small-star")
    stars = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
