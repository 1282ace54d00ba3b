"""Changes to tables, versions, and keys."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import maintain as m
from tallyloom.session import work_path
from tallyloom.sources import versions


def frame(spark, rows, schema="id long, name string, pay double"):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def base(spark):
    return frame(spark, [(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)])


def test_insert_keeps_duplicates_and_fills_nulls(spark, base):
    got = m.insert(base, frame(spark, [("d", 1)], "name string, id long"))
    assert rows_of(got) == sorted(rows_of(base) + [(1, "d", None)], key=repr)


def test_update_of_known_and_missing_keys(spark, base):
    got = m.update(base, frame(spark, [(2, None), (9, "x")], "id long, name string"), "id")
    assert rows_of(got) == [(1, "a", 1.0), (2, None, None), (3, "c", 3.0)]


def test_two_changes_of_one_key_are_refused(spark, base):
    with pytest.raises(m.DuplicateChange):
        m.update(base, frame(spark, [(2, "x"), (2, "y")], "id long, name string"), "id")


def test_delete_of_known_and_missing_keys(spark, base):
    assert rows_of(m.delete(base, frame(spark, [(1,), (1,), (7,)], "id long"), "id")) == [(2, "b", None), (3, "c", 3.0)]


def test_replace_may_change_the_key_and_inserts_a_missing_one(spark, base):
    changes = frame(spark, [(1, 10, "z", 0.0), (8, 8, "n", 1.0)], "old_key long, id long, name string, pay double")
    assert rows_of(m.replace(base, changes, "id")) == sorted([(2, "b", None), (3, "c", 3.0), (10, "z", 0.0), (8, "n", 1.0)], key=repr)


def test_replace_twice_is_the_same_as_once(spark, base):
    changes = frame(spark, [(1, 1, "z", 0.0)], "old_key long, id long, name string, pay double")
    once = m.replace(base, changes, "id")
    assert rows_of(m.replace(once, changes, "id")) == rows_of(once)


def test_delete_then_insert_gives_the_keys_back(spark, base):
    two = base.filter("id < 3")
    assert rows_of(m.insert(m.delete(base, two, "id"), two)) == rows_of(base)


def test_assigned_keys_follow_the_highest(spark, base):
    batch = frame(spark, [("q", 1.0), ("p", 2.0)], "name string, pay double")
    assert rows_of(m.assign_keys(base, batch, "id", ["name"]).select("id", "name")) == [(4, "p"), (5, "q")]
    assert rows_of(m.assign_keys(base.limit(0), batch, "id", ["name"]).select("id")) == [(1,), (2,)]


def one_by_one(rows, changes):
    """The same changes done in order on a list."""
    table = list(rows)
    for old, op, new in changes:
        if op in ("delete", "replace"):
            table = [r for r in table if r[0] != old]
        if op in ("insert", "replace"):
            table.append(new)
        if op == "update":
            table = [new if r[0] == old else r for r in table]
    return sorted(table, key=repr)


@pytest.mark.parametrize("seed", range(5))
def test_changes_as_if_done_in_order(spark, seed):
    rng = random.Random(seed)
    start = [(i, f"s{i}", float(i)) for i in range(6)]
    changes = []
    for n in range(40):
        op = rng.choice(["insert", "update", "update", "delete", "replace"])
        key = rng.randrange(9)
        changes.append((key, op, (key, f"n{n}", float(n))))
    sent = frame(spark, [(i, op, old, *new) for i, (old, op, new) in enumerate(changes)],
                 "seq long, op string, old_key long, id long, name string, pay double")
    assert rows_of(m.apply_changes(frame(spark, start), sent, "id")) == one_by_one(start, changes)


def test_replace_that_moves_a_row_to_another_key(spark, base):
    sent = frame(spark, [(0, "replace", 1, 7, "moved", 0.0), (1, "update", 7, 7, "later", 1.0)],
                 "seq long, op string, old_key long, id long, name string, pay double")
    assert rows_of(m.apply_changes(base, sent, "id")) == [(2, "b", None), (3, "c", 3.0), (7, "later", 1.0)]


def test_versions_and_the_failed_write(spark, base):
    root = work_path(spark, "people")
    assert versions.current_version(spark, root) is None
    first = versions.write_version(base, root)
    second = m.commit(spark, root, lambda t: t.filter("id > 1"))
    assert first != second and rows_of(versions.read_version(spark, root)) == [(2, "b", None), (3, "c", 3.0)]
    with pytest.raises(Exception):
        m.commit(spark, root, lambda t: t.withColumn("pay", F.raise_error(F.lit("no"))))
    assert versions.current_version(spark, root) == second
    assert rows_of(versions.read_version(spark, root, first)) == rows_of(base)


def test_a_label_is_committed_once(spark, base):
    root = work_path(spark, "people")
    versions.write_version(base, root)
    for _ in range(2):
        m.commit(spark, root, lambda t: t.withColumn("id", F.col("id") + 1), "batch-4")
    assert versions.current_version(spark, root) == "batch-4"
    assert [r[0] for r in rows_of(versions.read_version(spark, root))] == [2, 3, 4]


def test_old_versions_go_and_the_current_one_stays(spark, base):
    root = work_path(spark, "people")
    names = [versions.write_version(base.filter(F.col("id") <= n), root, keep=2) for n in (1, 2, 3)]
    assert versions.current_version(spark, root) == names[2]
    assert not versions.is_folder(spark, f"{root}/{names[0]}") and versions.is_folder(spark, f"{root}/{names[1]}")
    versions.drop_old_versions(spark, root, 0)
    assert versions.read_version(spark, root).count() == 3
