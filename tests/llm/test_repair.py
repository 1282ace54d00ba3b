import hashlib
import random
import re

import pytest

from tallyloom.llm import inputs, repair

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(turns):
    """Least (cost, audit, roles) over all edits of (initial, must go, cut off), by trying them all."""
    best = (4 * len(turns), "D" * len(turns), "")

    def go(k, roles, audit, cost, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if k == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit, roles))
        if inserts <= len(turns):
            for r in "ua":
                go(k, roles + r, audit + "I", cost + 3, inserts + 1)
        if k < len(turns):
            initial, must_go, cut_off = turns[k]
            go(k + 1, roles, audit + "D", cost + 4, inserts)
            if not must_go:
                extra = 3 * cut_off
                go(k + 1, roles + initial, audit + "K", cost + extra, inserts)
                for r in "ua":
                    go(k + 1, roles + r, audit + "R", cost + 3 + extra, inserts)

    go(0, "", "", 0, 0)
    return best


def test_every_edit_script_of_short_conversations():
    rng = random.Random(1)
    for _ in range(600):
        turns = [(rng.choice("suaauatE"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 5))]
        parse, edits = repair.Parse(), []
        for k, (initial, must_go, cut_off) in enumerate(turns):
            edits += parse.add(initial, str(k), must_go, cut_off)
        edits += parse.end()
        assert (parse.cost, "".join(e for e, _, _ in edits), "".join(r[:1] for e, r, _ in edits if e != "D")) == cheapest(turns)


@pytest.mark.parametrize("kind", ["uauaua", "uuuu", "aaaa", "su", "saua", "ausx"])
def test_long_conversations_hold_few_turns(kind):
    parse, most, edits = repair.Parse(), 0, 0
    for k in range(20_000):
        edits += sum(e != "I" for e, _, _ in parse.add(kind[k % len(kind)], "x", k % 11 == 0, k % 7 == 0))
        most = max(most, len(parse.waiting))
    assert most < 20 and edits + sum(e != "I" for e, _, _ in parse.end()) == 20_000


def test_rows_agree_with_accounts(spark, data):
    turns = inputs.damaged(spark.read.parquet(f"{data}/conversations.parquet"))
    rows = {}
    for r in repair.repaired(turns).orderBy("conv_id", "at").collect():
        rows.setdefault(r.conv_id, []).append(r)
    accounts = repair.accounts(turns).collect()
    assert len(accounts) == len(rows)
    for a in accounts:
        mine = rows[a.conv_id]
        kept = [r for r in mine if r.edit != "D"]
        assert "".join(r.edit for r in mine) == a.audit and [r.at for r in mine] == list(range(1, len(mine) + 1))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == a.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in kept))


def account(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS position", "2 AS repeated", "3 AS said").repartition(3)
    return {r.conv_id: r for r in repair.accounts(df).collect()}


def test_nulls_ties_repeated_rows_and_empty_table(spark):
    got = account(spark, [(1, None, "user", "a."), (1, 4, "assistant", "b."), (1, 9, None, None), (2, 3, "user", "x."), (2, 3, "user", "x."),
                          (None, 0, "user", "q?"), (None, 1, "assistant", "cut"), (3, None, "", "\t\n"),
                          (4, -2 ** 63, "user", "x."), (4, 2 ** 63 - 1, "assistant", "y.")])
    assert (got[1].gaps, got[1].blank, got[1].illegal, got[1].cost, got[1].audit) == (4, 1, 1, 4, "KKD")
    assert (got[2].duplicate, got[2].gaps, got[2].cost, got[2].audit) == (1, 0, 7, "KDI")
    assert (got[None].truncated, got[None].cost, got[None].audit) == (1, 3, "KK")
    assert (got[3].blank, got[3].gaps, got[3].audit, got[3].repaired_sha256) == (1, 0, "D", hashlib.sha256(b"").hexdigest())
    assert got[4].gaps == 2 ** 63 - 1 and got[4].audit == "KK"
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.accounts(empty).count() == repair.repaired(empty).count() == 0


def test_very_long_texts(spark):
    got = account(spark, [(1, 0, "user", "word " * 200_000 + "end."), (1, 1, "assistant", " " * 1_000_000 + "no end")])
    assert (got[1].truncated, got[1].cost, got[1].audit) == (1, 3, "KK")


def test_damage(spark):
    rows = [(c, k, "assistant", "One. Two!") for c in range(40) for k in range(5)] + [(None, None, None, None)]
    got = inputs.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    import zlib
    want = []
    for c, k, role, text in rows:
        place = f"{' ' if c is None else c}:{' ' if k is None else k}"
        kind, role, text = zlib.crc32(place.encode()) % 20, role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, k, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
