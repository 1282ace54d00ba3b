"""Conversations: games, transcripts, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import conversations as c
from tallyloom.operators import enrich
from tallyloom.plans import bindings as b
from tallyloom.plans.book import BOOK

PAIRS_SQL = b.TURNS_SQL + """, pairs AS (
  SELECT u.conv_id, u.turn AS user_turn, u."text" AS message, a."text" AS reply, u.scenario
  FROM turns u LEFT JOIN turns a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""

# Runs of marked replies: an odd place in a run ends a game, an even one is used up by the reset.
GAME_TURNS_SQL = PAIRS_SQL + f""", marked AS (
  SELECT *, coalesce(lower(reply) LIKE '%{b.WON_MARK}%', false) AS won,
         coalesce(lower(reply) LIKE '%{b.WON_MARK}%' OR lower(reply) LIKE '%{b.LOST_MARK}%', false) AS mark,
         row_number() OVER (PARTITION BY conv_id ORDER BY user_turn) AS n FROM pairs),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY conv_id, mark ORDER BY user_turn) AS run FROM marked),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, mark, run ORDER BY user_turn) AS place FROM runs),
ended AS (SELECT *, mark AND place % 2 = 1 AS ends FROM placed),
used AS (SELECT *, coalesce(lag(ends) OVER (PARTITION BY conv_id ORDER BY user_turn), false) AS consumed FROM ended),
played AS (SELECT *, 1 + coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY user_turn
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS game_no FROM used),
games AS (SELECT conv_id, CAST(game_no AS BIGINT) AS game_no, count(*) AS messages, min(user_turn) AS first_turn, max(user_turn) AS last_turn,
                 CASE WHEN bool_or(ends AND won) THEN 'won' WHEN bool_or(ends) THEN 'lost' ELSE 'open' END AS outcome,
                 max(CASE WHEN ends THEN reply END) AS closing
          FROM played WHERE NOT consumed GROUP BY ALL)"""


def _games(spark, folder):
    return c.games(c.game_turns(b.turns(spark, folder), b.WON_MARK, b.LOST_MARK))


@BOOK.add("game_sessions", "WITH " + GAME_TURNS_SQL + " SELECT conv_id, game_no, messages, first_turn, last_turn, outcome FROM games")
def game_sessions(spark, folder):
    return _games(spark, folder)


@BOOK.add("chat_outcome", "WITH " + GAME_TURNS_SQL + " SELECT conv_id, game_no, outcome FROM games")
def chat_outcome(spark, folder):
    return _games(spark, folder).select("conv_id", "game_no", "outcome")


@BOOK.add("chat_message_count", "WITH " + GAME_TURNS_SQL + """
SELECT conv_id, game_no, messages, coalesce('Game over! ' || closing || ' And you have sent ' || messages || ' messages ! A new session will start.',
       'Total messages sent: ' || messages) AS info FROM games""")
def chat_message_count(spark, folder):
    closed = c.with_closing(_games(spark, folder), b.turns(spark, folder))
    return closed.select("conv_id", "game_no", "messages", c.status_line(F.col("messages"), F.col("closing")).alias("info"))


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _texts_sql(field: str) -> str:
    cases = " ".join(f"WHEN {_quoted(n)} THEN {_quoted(getattr(s, field))}" for n, s in c.SCENARIOS.items())
    return f"CASE scenario {cases} END"


TRANSCRIPT_SQL = GAME_TURNS_SQL + f""", scripts AS (
  SELECT conv_id, scenario, CAST(game_no AS BIGINT) AS game_no, coalesce(string_agg(
         {_texts_sql('user_label')} || message || {_texts_sql('reply_label')} || reply, {_quoted(c.SEPARATOR)} ORDER BY user_turn)
         FILTER (reply IS NOT NULL), '') AS transcript
  FROM played WHERE NOT consumed GROUP BY conv_id, scenario, game_no)"""


def _scripts(spark, folder):
    return c.transcripts(b.turns(spark, folder), won=b.WON_MARK, lost=b.LOST_MARK)


@BOOK.add("chat_transcript", "WITH " + TRANSCRIPT_SQL + " SELECT conv_id, scenario, game_no, transcript FROM scripts")
def chat_transcript(spark, folder):
    return _scripts(spark, folder)


@BOOK.add("chat_prompt_context", "WITH " + TRANSCRIPT_SQL + f"""
SELECT conv_id, game_no, {_texts_sql('goal')} AS system,
       CASE WHEN transcript = '' THEN {_texts_sql('reply_label')} || {_texts_sql('greeting')} ELSE transcript END AS content FROM scripts""")
def chat_prompt_context(spark, folder):
    return c.prompt_contexts(_scripts(spark, folder))


@BOOK.add("chat_image_request", "WITH " + TRANSCRIPT_SQL + f"""
SELECT conv_id, game_no, {_texts_sql('image')} AS system, transcript AS content FROM scripts""")
def chat_image_request(spark, folder):
    return c.image_requests(_scripts(spark, folder))


REQUESTS_SQL = GAME_TURNS_SQL + f""", own AS (SELECT * FROM played WHERE NOT consumed
  QUALIFY game_no = max(game_no) OVER (PARTITION BY conv_id)),
newest AS (SELECT conv_id, max(user_turn) AS newest FROM own GROUP BY 1),
lines AS (
  SELECT DISTINCT conv_id, -1 AS spot, 0 AS n, 'system' AS role, {_texts_sql('prompt')} AS content FROM own
  UNION ALL SELECT conv_id, user_turn, 1, 'user', message FROM own JOIN newest USING (conv_id) WHERE user_turn = newest OR reply IS NOT NULL
  UNION ALL SELECT conv_id, user_turn, 2, 'assistant', reply FROM own JOIN newest USING (conv_id) WHERE user_turn < newest AND reply IS NOT NULL),
requests AS (SELECT conv_id, string_agg(role || ': ' || content, chr(10) ORDER BY spot, n) AS request, count(*) AS messages,
  last(content ORDER BY spot, n) AS newest FROM lines GROUP BY ALL)"""


def _requests(spark, folder):
    return c.requests(b.turns(spark, folder), won=b.WON_MARK, lost=b.LOST_MARK)


@BOOK.add("chat_requests", "WITH " + REQUESTS_SQL + " SELECT conv_id, request, messages FROM requests")
def chat_requests(spark, folder):
    return _requests(spark, folder).select("conv_id", F.array_join(F.transform(
        "messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("request"),
        F.size("messages").cast("long").alias("messages"))


def echo_model(requests):
    """Stands in for a chat model: says how long the request is and repeats the start of its last message."""
    return [f"{len(r)} messages; {r[-1]['content'][:20]}" for r in requests]


@BOOK.add("chat_complete", "WITH " + REQUESTS_SQL + """
SELECT conv_id, messages || ' messages; ' || substr(newest, 1, 20) AS answer FROM requests""")
def chat_complete(spark, folder):
    return enrich.complete(_requests(spark, folder), echo_model, "messages", "answer").select("conv_id", "answer")
