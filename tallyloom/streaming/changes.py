"""Change sets and chat turns that arrive as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import maintain
from tallyloom.operators.conversations import LOST, WON, asked_pairs, number_pairs, pair_marks
from tallyloom.operators.ordering import HOT_ROWS
from tallyloom.sources import buckets
from tallyloom.streaming.runs import KEPT, drain, kept_beside, version_before


def apply_stream(changes: DataFrame, root: str, key: str, n: int, checkpoint: str | None = None, keep: int | None = None) -> None:
    """Each batch of changes makes the next version of the table at ``root``, once only for each batch of a stream.

    Of a bucketed table a batch writes the rows of the keys it names; any other table is written anew. All versions stay unless
    ``keep`` says how many.
    """
    spark = changes.sparkSession
    bucketed = buckets.is_table(spark, root)

    def write(batch: DataFrame, label: str, number: int) -> None:
        if batch.isEmpty():
            return
        if bucketed:
            maintain.commit_changes(spark, root, batch, key, label, keep)
        else:
            maintain.commit(spark, root, lambda base: maintain.apply_changes(base, batch, key), label, keep)

    drain(changes, "changes", n, each=write, checkpoint=checkpoint)


# What is kept of a conversation: its newest message with what its reply says, and the games that ended before it.
LAST_PAIR = "conv_id long, user_turn long, answered boolean, won boolean, lost boolean, consumed boolean, over long"
MOVES = "conv_id long, game_no long, user_turn long, sent long, outcome string"


def game_moves(turns: DataFrame, n: int, won: str = WON, lost: str = LOST, sink: str | None = None,
               checkpoint: str | None = None, hot_rows: int = HOT_ROWS, ranges: int | None = None) -> str:
    """Messages sent and games ended, one row each, with the newest message of each conversation kept between batches.

    The files of the stream have to come in the order of the turns. A batch is numbered by the batch operator, led in by what is
    kept, so a conversation with very many turns is cut into ranges there too. A replayed batch writes the same rows again.
    """
    spark = turns.sparkSession
    state, path = kept_beside(spark, "last-pairs", checkpoint, sink, "games", LAST_PAIR, ["conv_id"], MOVES)

    def write(batch: DataFrame, label: str, number: int) -> None:
        marks = pair_marks(batch, won, lost)
        before = version_before(spark, state, label)
        keys = batch.filter(F.col("conv_id").isNotNull()).select("conv_id")
        lead = buckets.read(spark, state, before, keys)
        names = ("conv_id", "user_turn", "asks", "answered", "won", "lost")
        asked = lead.withColumn("asks", F.lit(True))
        # A message that was used up follows a game that ended: one marked pair before it says so to the numbering.
        ended = asked.filter("consumed").withColumn("user_turn", F.col("user_turn") - 1).withColumn("won", F.lit(True))
        pairs = asked_pairs(marks.select(*names).unionByName(asked.select(*names)).unionByName(ended.select(*names)))
        known = lead.select(F.col("conv_id").alias("_conv"), F.col("user_turn").alias("_lead"), (F.col("won") | F.col("lost")).alias("_told"),
                            (F.col("over") - F.when(F.col("consumed"), 1).otherwise(0)).alias("_over"))
        numbered = number_pairs(pairs, hot_rows, ranges).join(known, F.col("conv_id") == F.col("_conv"), "left").withColumn(
            "game_no", F.col("game_no") + F.coalesce("_over", F.lit(0))).persist()
        try:
            new = numbered.filter(F.col("_lead").isNull() | (F.col("user_turn") > F.col("_lead")))
            sent = new.filter(~F.col("consumed")).select("conv_id", "game_no", "user_turn", F.lit(1).cast("long").alias("sent"),
                                                         F.lit(None).cast("string").alias("outcome"))
            at_lead = (F.col("user_turn") == F.col("_lead")) & ~F.col("_told")
            over = numbered.filter(F.col("ends") & (F.col("_lead").isNull() | (F.col("user_turn") > F.col("_lead")) | at_lead)).select(
                "conv_id", "game_no", "user_turn", F.lit(0).cast("long").alias("sent"), F.when(F.col("won"), "won").otherwise("lost").alias("outcome"))
            sent.unionByName(over).write.mode("overwrite").parquet(f"{path}/batch={label}")
            last = numbered.groupBy("conv_id").agg(F.max_by(F.struct("user_turn", "answered", "won", "lost", "consumed", "game_no"), "user_turn").alias(
                "last"), F.max("game_no").alias("_top"))
            newest = last.select("conv_id", "last.*", F.when(F.col("last.consumed"), F.col("_top")).otherwise(F.col("last.game_no") - 1).alias("over"))
            pair = F.struct("user_turn", "answered", "won", "lost", "consumed", "over")
            buckets.commit(spark, state, keys, lambda base: base.unionByName(newest.select(*base.columns)).groupBy("conv_id").agg(
                F.max_by(pair, "user_turn").alias("p")).select("conv_id", "p.*"), label, KEPT)
        finally:
            numbered.unpersist()

    drain(turns.select("conv_id", "turn", "role", "text"), "games", n, each=write, checkpoint=checkpoint)
    return path


def games(moves: DataFrame) -> DataFrame:
    """The moves of each game put together."""
    return moves.groupBy("conv_id", "game_no").agg(
        F.sum("sent").alias("messages"), F.min("user_turn").alias("first_turn"), F.max("user_turn").alias("last_turn"),
        F.coalesce(F.max("outcome"), F.lit("open")).alias("outcome"))
