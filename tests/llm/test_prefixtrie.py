import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tallyloom.llm import inputs, prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(convs):
    """{sequence: node} by a dictionary of all prefixes."""
    members = defaultdict(list)
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = defaultdict(set)
    for seq in members:
        if seq:
            children[seq[:-1]].add(seq)
    out = []
    for seq, who in members.items():
        under = [s for s in members if s[:len(seq)] == seq]
        ends = sorted(c for c in who if len(convs[c]) == len(seq))
        out.append((min(who), len(seq), min(members[seq[:-1]]) if seq else None, len(who), len(children[seq]),
                    sum(not children[s] for s in under),
                    sum((len(members[s]) - 1) * len(s[-1][1].split()) for s in under if s),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                   for r in df.collect()), key=str)


def made(n, seed=3):
    rng = np.random.default_rng(seed)
    return {int(c): [(str(rng.choice(["user", "assistant"])), " ".join(["w"] * int(rng.integers(0, 3))))
                     for _ in range(int(rng.integers(0, 6)))] for c in rng.choice(10_000, n, replace=False) - 50}


def frames(spark, convs):
    rows = [(c, k, *t) for c, turns in convs.items() for k, t in enumerate(turns)]
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    return prefixtrie.marked(spark.createDataFrame(rows, SCHEMA)), ids


@pytest.mark.parametrize("block", [1, 7, 16_384])
def test_nodes_against_all_prefixes(spark, block):
    convs = made(60)
    assert found(prefixtrie.nodes(*frames(spark, convs), block_turns=block)) == plain(convs)


def test_copies_of_one_conversation_over_many_blocks(spark):
    same = [("user", "a b"), ("assistant", "c")]
    convs = {k: list(same) for k in range(400)} | {1000 + k: [*same, ("user", f"{k % 3}")] for k in range(90)} | {5000: []}
    turns, ids = frames(spark, convs)
    assert found(prefixtrie.nodes(turns, ids, block_turns=20)) == plain(convs)


def test_only_turnless_and_empty_tables(spark):
    turns, ids = frames(spark, {5: [("user", "x")], 3: []})
    none = turns.limit(0)
    assert found(prefixtrie.nodes(none, ids)) == plain({5: [], 3: []})
    assert prefixtrie.nodes(none).count() == 0 and prefixtrie.nodes(none, ids.limit(0)).count() == 0


def test_long_conversations(spark):
    long = [("user", f"turn {k}") for k in range(3000)]
    convs = {1: long, 2: long[:2000], 3: [*long[:2500], ("user", "else")]}
    nodes = prefixtrie.nodes(*frames(spark, convs), block_turns=100)
    got = {(r.conv_id, r.depth): r for r in nodes.collect()}
    assert len(got) == 3002
    assert (got[1, 2000].n_convs, got[1, 2500].n_convs, got[1, 2501].n_convs, got[3, 2501].n_convs) == (3, 2, 1, 1)
    assert got[1, 2500].n_children == 2 and got[1, 0].n_leaves == 2 and got[1, 0].saved_tokens == (2000 * 2 + 500) * 2


def test_nulls_ties_repeated_rows_and_other_columns(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 5, "b", "x"), (1, 5, "a", "x"), (None, 0, "user", "lost"),
            (2, 3, "user", "first"), (2, 9, "", ""), (4, 0, "user", "first"), (4, 0, "user", "first")]
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS position", "2 AS mark", "3 AS block")
    nodes = prefixtrie.with_texts(prefixtrie.nodes(prefixtrie.marked(turns)), turns).collect()
    by_depth = defaultdict(list)
    for r in nodes:
        by_depth[r.depth].append((r.conv_id, r.n_convs, r.role, r.text))
    assert by_depth[0] == [(1, 3, None, None)] and by_depth[1] == [(1, 3, "user", "first")]
    assert sorted(by_depth[2]) == [(1, 2, "", ""), (4, 1, "user", "first")]
    assert len(by_depth[3]) == len(by_depth[4]) == 1 and 5 not in by_depth


def test_starts_come_from_the_first_of_the_group(spark):
    rows = [(c, k, "user", f"{c}:{k}") for c in [0, 20, *range(1, 12), *range(41, 50), -7] for k in range(c % 5)]
    turns, ids = inputs.shared_starts(prefixtrie.marked(spark.createDataFrame(rows, SCHEMA)))
    import zlib
    want = defaultdict(list)
    for c in {r[0] for r in rows}:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        want[c] = [t for _, k, _, t in sorted(r for r in rows if r[0] == base)][:h] + [t for _, k, _, t in sorted(r for r in rows if r[0] == c)][h:]
    got = defaultdict(list)
    for r in prefixtrie.with_texts(turns.withColumnRenamed("mark", "last"), spark.createDataFrame(rows, SCHEMA)).orderBy("position").collect():
        got[r.conv_id].append(r.text)
    assert {r.conv_id: got[r.conv_id] for r in ids.collect()} == want


def test_sparse_table():
    values = np.random.default_rng(1).integers(0, 9, 77)
    table = prefixtrie.SparseTable(values)
    for bound in range(10):
        at = np.arange(78)
        limit = np.full(78, bound)
        for k, right, left in zip(at, table.reach_right(at, limit), table.reach_left(at, limit)):
            assert right == next((j for j in range(k, 77) if values[j] < bound), 77)
            assert left == next((j + 1 for j in range(k - 1, -1, -1) if values[j] < bound), 0)
    low, high = np.triu_indices(77)
    assert (table.least(low, high) == [values[a:b + 1].min() for a, b in zip(low, high)]).all()
