"""Conversations: games, transcripts and model requests.

A conversation can be of any length. Games come from running sums over marks that are taken from
the texts beforehand. What is told of a game starts anew with the game: the end of one clears history and transcript, and the
message that only resets is left out. Tasks lay out parts of a set number of turns, which are then joined in order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import contains_any
from tallyloom.operators.ordering import HOT_ROWS, scan_keys, scan_ranges, split_hot

# What a reply says when the game is over, and what stands between the pairs of a transcript.
WON = "you have won"
LOST = "you have lost"
SEPARATOR = "\n -- \n"
#: Turns that one task lays out at a time, and the bytes a whole may have; no cell holds two gigabytes.
PART_TURNS = 512
CELL_BYTES = 1 << 30


@dataclass(frozen=True)
class Scenario:
    """Labels of the speakers, and the texts that go to a model."""

    user_label: str
    reply_label: str
    prompt: str
    goal: str
    greeting: str
    image: str


# The speakers of the three games. The texts are our own.
SCENARIOS: Mapping[str, Scenario] = {
    "COMPANY_IPO": Scenario(
        "\n Employee : ", "\n CEO : ", "You are the head of a company and do not want to sell shares.",
        "Talk the head of the company into selling shares.", "Good morning. What brings you here?",
        "Describe a picture of this talk in a board room."),
    "CARPET_SALE": Scenario(
        "\n Buyer : ", "\n Turkish carpet salesman : ", "You sell a fine carpet and hold on to your price.",
        "Bring the price of the carpet down.", "Welcome, friend. Which carpet do you like?",
        "Describe a picture of this talk among carpets."),
    "HOMEWORK": Scenario(
        "\n Child : ", "\n Parents : ", "You are parents who want homework done before any play.",
        "Get leave to play from your parents.", "Hello dear, is your homework done?",
        "Describe a picture of this talk in a kitchen."),
}


def _by_scenario(scenarios: Mapping[str, Scenario], field: str) -> Column:
    pairs = [F.lit(v) for name, s in scenarios.items() for v in (name, getattr(s, field))]
    return F.try_element_at(F.create_map(*pairs), F.col("scenario"))


def _own_turn() -> Column:
    """The turn of the user message that a turn belongs to: its own, or the one right before a reply."""
    return F.when(F.col("role") == "user", F.col("turn")).when(F.col("role") == "assistant", F.col("turn") - 1)


def pair_marks(turns: DataFrame, won: str = WON, lost: str = LOST) -> DataFrame:
    """Each message and each reply under the turn of its message, with what the reply says about the game; the texts stay behind."""
    reply = F.col("role") == "assistant"
    return turns.select(
        "conv_id", _own_turn().alias("user_turn"), (F.col("role") == "user").alias("asks"), reply.alias("answered"),
        (reply & contains_any(F.col("text"), [won])).alias("won"), (reply & contains_any(F.col("text"), [lost])).alias("lost"))


def asked_pairs(marks: DataFrame) -> DataFrame:
    """The marks put together, one row a message; a reply to no message is left out."""
    pairs = marks.filter(F.col("user_turn").isNotNull()).groupBy("conv_id", "user_turn").agg(
        *[F.max(c).alias(c) for c in ("asks", "answered", "won", "lost")])
    return pairs.filter("asks").drop("asks")


def marked_pairs(turns: DataFrame, won: str = WON, lost: str = LOST) -> DataFrame:
    """Each user message with what the assistant turn right after it says about the game."""
    return asked_pairs(pair_marks(turns, won, lost))


def game_turns(turns: DataFrame, won: str = WON, lost: str = LOST, hot_rows: int = HOT_ROWS, ranges: int | None = None) -> DataFrame:
    """User messages with their game: number, whether the pair ends it, and whether it only starts the next one.

    After the end of a game the next message resets it and belongs to no game, and a marker in its
    reply does not count. In a run of replies with markers the first, third, fifth ... therefore end a game, and the
    pair after an odd run is the one used up.
    """
    return number_pairs(marked_pairs(turns, won, lost), hot_rows, ranges, turns.filter(F.col("role") == "user").select("conv_id"))


def number_pairs(pairs: DataFrame, hot_rows: int = HOT_ROWS, ranges: int | None = None, sized: DataFrame | None = None) -> DataFrame:
    """The pairs of ``marked_pairs`` with their games; ``sized`` as for ``split_hot``."""
    cold, hot = split_hot(pairs, ["conv_id"], hot_rows, sized=sized)
    plain = _number_games(cold, scan_keys)
    if hot is None:
        return plain
    return plain.unionByName(_number_games(hot, partial(scan_ranges, ranges=ranges)))


def _number_games(pairs: DataFrame, scan: Callable[..., DataFrame]) -> DataFrame:
    keys, order = ["conv_id"], ["user_turn"]
    mark = F.col("won") | F.col("lost")
    placed = scan(pairs, keys, order, sums={"_n": F.lit(1).cast("long")})
    plain = scan(placed, keys, order, maxes={"_plain": F.when(~mark, F.col("_n"))}, inclusive=False)
    run = F.col("_n") - 1 - F.coalesce(F.col("_plain"), F.lit(0))
    flagged = plain.withColumn("consumed", run % 2 == 1).withColumn("ends", mark & ~F.col("consumed"))
    numbered = scan(flagged, keys, order, sums={"_over": F.when(F.col("ends"), 1).otherwise(0).cast("long")}, inclusive=False)
    return numbered.select(
        "conv_id", "user_turn", "answered", "won", "lost", "consumed", "ends",
        F.when(~F.col("consumed"), F.col("_over") + 1).alias("game_no"))


def games(played: DataFrame) -> DataFrame:
    """One row per game: messages sent, first and last message, outcome."""
    outcome = F.when(F.max(F.col("ends") & F.col("won")), F.lit("won")).when(F.max("ends"), F.lit("lost")).otherwise(F.lit("open"))
    return played.filter(~F.col("consumed")).groupBy("conv_id", "game_no").agg(
        F.count(F.lit(1)).alias("messages"), F.min("user_turn").alias("first_turn"),
        F.max("user_turn").alias("last_turn"), outcome.alias("outcome"))


def with_closing(finished: DataFrame, turns: DataFrame) -> DataFrame:
    """Games with the reply that closed them: the one after their last message, unless they are open."""
    said = turns.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("text").alias("closing"))
    same = (F.col("conv_id") == F.col("_conv")) & (F.col("last_turn") + 1 == F.col("_turn")) & (F.col("outcome") != "open")
    return finished.join(said, same, "left").drop("_conv", "_turn")


def status_line(messages: Column, closing: Column) -> Column:
    """What the player is told: the number of messages, after a game also the reply that closed it."""
    sent = messages.cast("string")
    over = F.concat(F.lit("Game over! "), closing, F.lit(" And you have sent "), sent, F.lit(" messages ! A new session will start."))
    return F.coalesce(over, F.concat(F.lit("Total messages sent: "), sent))


def _part(turn: Column, part_turns: int) -> Column:
    return F.floor(turn / F.lit(part_turns)).cast("long")


def _played_turns(turns: DataFrame, won: str, lost: str) -> DataFrame:
    """Turns of pairs that belong to a game, with its number and ``_own``, the message they go with."""
    placed = game_turns(turns, won, lost).filter(~F.col("consumed")).select(
        F.col("conv_id").alias("_conv"), F.col("user_turn").alias("_user_turn"), "game_no")
    own = turns.withColumn("_own", _own_turn()).filter(F.col("_own").isNotNull())
    return own.join(placed, (F.col("conv_id") == F.col("_conv")) & (F.col("_own") == F.col("_user_turn"))).drop("_conv", "_user_turn")


def game_pairs(turns: DataFrame, won: str = WON, lost: str = LOST, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per game: ``pairs`` of message and reply (null if there is none) in order.

    Tasks pair up parts of a game first; a reply goes with its message, so no pair is cut in two. A game that no cell
    can hold raises an error that says so.
    """
    item = F.struct(F.col("_own").alias("at"), (F.col("role") == "assistant").alias("is_reply"), F.col("text").alias("text"))
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    keys = ("conv_id", "scenario", "game_no")
    grouped = _played_turns(turns, won, lost).groupBy(*keys, _part(F.col("_own"), part_turns).alias("part")).agg(
        F.array_sort(F.collect_list(item)).alias("_items"), size.alias("_bytes"))
    # In this order a reply stands right after its message.
    def pair(x: Column, i: Column) -> Column:
        after = F.get(F.col("_items"), i + 1)
        return F.struct(x["at"].alias("at"), x["is_reply"].alias("is_reply"), x["text"].alias("message"),
                        F.when(after["is_reply"] & (after["at"] == x["at"]), after["text"]).alias("reply"))

    paired = grouped.select(*keys, "part", "_bytes", F.filter(F.transform("_items", pair), lambda x: ~x["is_reply"]).alias("_pairs"))
    in_order = F.array_sort(F.collect_list(F.struct("part", "_pairs")))
    whole = F.flatten(F.transform(in_order, lambda p: p["_pairs"]))
    kind = "array<struct<at:bigint,is_reply:boolean,message:string,reply:string>>"
    too_long = F.raise_error(F.lit(f"a game is beyond {CELL_BYTES} bytes of text")).cast(kind)
    return paired.groupBy(*keys).agg(F.when(F.sum("_bytes") > CELL_BYTES, too_long).otherwise(whole.cast(kind)).alias("pairs"))


def _script() -> Column:
    """Speaker-labelled text of the answered pairs; empty if there are none."""
    answered = F.filter("pairs", lambda p: p["reply"].isNotNull())
    lines = F.transform(answered, lambda p: F.concat(F.col("_user"), p["message"], F.col("_reply"), p["reply"]))
    return F.array_join(lines, SEPARATOR)


def transcripts(turns: DataFrame, scenarios: Mapping[str, Scenario] = SCENARIOS, won: str = WON, lost: str = LOST,
                part_turns: int = PART_TURNS) -> DataFrame:
    """The transcript of every game; empty before the first answer."""
    labelled = game_pairs(turns, won, lost, part_turns).withColumns({
        "_user": _by_scenario(scenarios, "user_label"), "_reply": _by_scenario(scenarios, "reply_label")})
    return labelled.select("conv_id", "scenario", "game_no", _script().alias("transcript"))


def prompt_contexts(scripts: DataFrame, scenarios: Mapping[str, Scenario] = SCENARIOS) -> DataFrame:
    """Hint requests from transcripts: the goal, and the transcript or before the first answer the greeting."""
    greeting = F.concat(_by_scenario(scenarios, "reply_label"), _by_scenario(scenarios, "greeting"))
    content = F.when(F.col("transcript") == "", greeting).otherwise(F.col("transcript"))
    return scripts.select("conv_id", "game_no", _by_scenario(scenarios, "goal").alias("system"), content.alias("content"))


def image_requests(scripts: DataFrame, scenarios: Mapping[str, Scenario] = SCENARIOS) -> DataFrame:
    """Requests for the words of a picture from transcripts: the image prompt and the transcript, without a greeting."""
    return scripts.select("conv_id", "game_no", _by_scenario(scenarios, "image").alias("system"), F.col("transcript").alias("content"))


def requests(turns: DataFrame, scenarios: Mapping[str, Scenario] = SCENARIOS, won: str = WON, lost: str = LOST,
             part_turns: int = PART_TURNS) -> DataFrame:
    """The latest model request of each conversation, one row each: the prompt, the answered pairs of its game, and its
    newest message. A message that only resets makes no request; messages without a reply are not part of the history."""
    played = game_turns(turns, won, lost).filter(~F.col("consumed"))
    last = played.groupBy(F.col("conv_id").alias("_conv")).agg(F.max("game_no").alias("_game"))
    games_ = game_pairs(turns, won, lost, part_turns).join(
        last, (F.col("conv_id") == F.col("_conv")) & (F.col("game_no") == F.col("_game"))).withColumn("_prompt", _by_scenario(scenarios, "prompt"))

    def said(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    past = F.filter(F.slice("pairs", 1, F.size("pairs") - 1), lambda p: p["reply"].isNotNull())
    history = F.flatten(F.transform(past, lambda p: F.array(said("user", p["message"]), said("assistant", p["reply"]))))
    newest = F.array(said("user", F.element_at("pairs", -1)["message"]))
    return games_.select("conv_id", "game_no", F.concat(F.array(said("system", F.col("_prompt"))), history, newest).alias("messages"))
