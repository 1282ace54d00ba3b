"""Games, transcripts and requests against a plain state machine."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import conversations as c
from tallyloom.streaming import changes, runs

SCHEMA = "conv_id long, turn long, role string, text string, scenario string"


def talk(conv, replies, start=0):
    rows = []
    for i, reply in enumerate(replies):
        rows.append((conv, start + 2 * i, "user", f"m{i}", "HOMEWORK"))
        if reply is not None:
            rows.append((conv, start + 2 * i + 1, "assistant", reply, "HOMEWORK"))
    return rows


def play(replies):
    """Games of one conversation: (messages, outcome)."""
    games, sent, over = [], 0, False
    for reply in replies:
        if over:
            over, sent = False, 0
            continue
        sent += 1
        said = (reply or "").lower()
        if "you have won" in said or "you have lost" in said:
            games.append((sent, "won" if "you have won" in said else "lost"))
            over = True
    if not over and sent:
        games.append((sent, "open"))
    return games


def played(df):
    out = {}
    for r in df.orderBy("conv_id", "game_no").collect():
        out.setdefault(r["conv_id"], []).append((r["messages"], r["outcome"]))
    return out


W, L = "well, You have WON.", "you have lost"


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(2)
    fixed = {1: [W, W, "x", W], 2: ["x", "x"], 3: [W], 4: [W, W, W, "y", L, "z", "z"], 5: [None], 6: [W, None, L], 7: [L, L]}
    for conv in range(10, 30):
        fixed[conv] = [rng.choice([W, L, "x", "x", None]) for _ in range(rng.randint(1, 40))]
    return fixed


@pytest.fixture(scope="module")
def turns(spark, talks):
    rows = [row for conv, replies in talks.items() for row in talk(conv, replies, conv % 2)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("hot_rows", [3, 15, 10**6])
def test_games(turns, talks, hot_rows):
    got = played(c.games(c.game_turns(turns, hot_rows=hot_rows, ranges=4)))
    want = {conv: games for conv, replies in talks.items() if (games := play(replies))}
    assert got == want


def test_games_as_a_stream_with_a_restart(spark, turns, talks, tmp_path):
    path, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    top = turns.agg(F.max("turn")).first()[0]
    cut = max(4, top // 4)
    for start in range(0, top + 1, cut):
        turns.filter(F.col("turn").between(start, start + cut - 1)).drop("scenario").coalesce(1).write.mode("append").parquet(path)
        if start in (cut, 3 * cut):
            stream = runs.stream_table(spark, path, files_per_trigger=1)
            changes.game_moves(stream, 2, sink=sink, checkpoint=check)
    changes.game_moves(runs.stream_table(spark, path, files_per_trigger=1), 2, sink=sink, checkpoint=check)
    got = played(changes.games(spark.read.parquet(sink)))
    assert got == {conv: games for conv, replies in talks.items() if (games := play(replies))}


def test_status_line(spark):
    rows = spark.createDataFrame([(2, None), (3, "you have won")], "n long, closing string")
    got = [r[0] for r in rows.select(c.status_line(F.col("n"), F.col("closing"))).collect()]
    assert got == ["Total messages sent: 2", "Game over! you have won And you have sent 3 messages ! A new session will start."]


def replay(replies):
    """What a player's session holds after each message: script and request, by the rules of the chat."""
    history, script, over, game, last = [], [], False, 1, None
    scripts = {}
    for i, reply in enumerate(replies):
        if over:
            history, script, over, game = [], [], False, game + 1
            continue
        own = c.SCENARIOS["HOMEWORK"]
        last = (game, [("system", own.prompt)] + [m for a, b in history for m in (("user", a), ("assistant", b))] + [("user", f"m{i}")])
        if reply is not None:
            history.append((f"m{i}", reply))
            script.append(f"\n Child : m{i}\n Parents : {reply}")
            over = "you have won" in reply.lower() or "you have lost" in reply.lower()
        scripts[game] = c.SEPARATOR.join(script)
    return scripts, last


@pytest.mark.parametrize("part_turns", [3, 512])
def test_transcripts_and_requests_start_anew_with_each_game(turns, talks, part_turns):
    wanted = {conv: replay(replies) for conv, replies in talks.items()}
    scripts = c.transcripts(turns, part_turns=part_turns)
    got = {(r["conv_id"], r["game_no"]): r["transcript"] for r in scripts.collect()}
    assert got == {(conv, game): text for conv, (texts, _) in wanted.items() for game, text in texts.items()}
    sent = {r["conv_id"]: (r["game_no"], [tuple(m) for m in r["messages"]]) for r in c.requests(turns, part_turns=part_turns).collect()}
    assert sent == {conv: last for conv, (_, last) in wanted.items()}


def test_greeting_before_any_answer_but_none_in_a_picture(spark):
    scripts = c.transcripts(spark.createDataFrame(talk(1, [None]), SCHEMA))
    got = c.prompt_contexts(scripts).first()
    assert got["content"] == "\n Parents : " + c.SCENARIOS["HOMEWORK"].greeting
    assert got["system"] == c.SCENARIOS["HOMEWORK"].goal
    picture = c.image_requests(scripts).first()
    assert (picture["system"], picture["content"]) == (c.SCENARIOS["HOMEWORK"].image, "")


def test_long_conversation_is_one_request(spark):
    rows = talk(1, [f"r{k}" for k in range(1300)])
    got = c.requests(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 1 and len(got[0]["messages"]) == 1 + 2 * 1299 + 1
    assert [m["content"] for m in got[0]["messages"]][-2:] == ["r1298", "m1299"]
