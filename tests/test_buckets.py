"""Bucketed tables: what a commit writes, layers, replays, roll back, old versions."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import maintain
from tallyloom.session import work_path
from tallyloom.sources import buckets
from tallyloom.sources.versions import current_version

SENT = "seq long, op string, old_key long, id long, name string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, n=200, **sizes):
    root = work_path(spark, "bucketed")
    buckets.create(spark.range(n).select("id", F.concat(F.lit("s"), "id").alias("name")), root, ["id"], **sizes)
    return root


def files_of(spark, root, version):
    """Rows and buckets that a version wrote."""
    path = f"{root}/{version}"
    rows = spark.read.parquet(path)
    return rows.filter("not _gone").count(), {str(r[0]) for r in rows.select("_bucket").distinct().collect()}


def test_a_change_writes_only_what_it_touches(spark):
    root = table(spark, 5000, buckets=32, small_bytes=0)
    sent = spark.createDataFrame([(0, "update", 3, 3, "u"), (1, "delete", 4, 4, None), (2, "insert", 9000, 9000, "i")], SENT)
    maintain.commit_changes(spark, root, sent, "id")
    held = buckets.manifest(spark, root)
    rows, touched = files_of(spark, root, held.name)
    assert rows == 2 and 1 <= len(touched) <= 3
    assert sum(layers[-1][0] == held.name for layers in held.layers.values()) == len(touched)
    got = buckets.read(spark, root)
    assert got.count() == 5000 and rows_of(got.filter("id in (3, 4, 9000)")) == [(3, "u"), (9000, "i")]


def test_small_buckets_are_written_anew(spark):
    root = table(spark, 300, buckets=8)
    sent = spark.createDataFrame([(0, "update", 3, 3, "u")], SENT)
    maintain.commit_changes(spark, root, sent, "id")
    held = buckets.manifest(spark, root)
    rows, touched = files_of(spark, root, held.name)
    assert len(touched) == 1 and 1 < rows < 300 and all(len(x) == 1 for x in held.layers.values())
    assert buckets.read(spark, root).count() == 300


@pytest.mark.parametrize("sizes", [{"buckets": 1}, {"buckets": 4, "small_bytes": 0}, {"buckets": 4, "small_bytes": 0, "bucket_bytes": 800}])
def test_many_change_sets_as_if_done_in_order(spark, sizes, monkeypatch):
    monkeypatch.setattr(buckets, "MAX_LAYERS", 4)
    rng = random.Random(5)
    root, want = table(spark, 30, **sizes), [(i, f"s{i}") for i in range(30)]
    for turn in range(6):
        sent = [(k, rng.choice(["insert", "update", "delete", "replace"]), rng.randrange(40), 0, f"n{turn}.{k}") for k in range(12)]
        sent = [(k, op, old, rng.randrange(40) if op == "replace" else old, name) for k, op, old, _, name in sent]
        maintain.commit_changes(spark, root, spark.createDataFrame(sent, SENT), "id", f"batch-{turn}")
        want = rows_of(maintain.apply_changes(spark.createDataFrame(want, "id long, name string"), spark.createDataFrame(sent, SENT), "id"))
        assert rows_of(buckets.read(spark, root)) == want
        keys = spark.createDataFrame([(k,) for k in range(0, 40, 3)], "id long")
        assert rows_of(buckets.read(spark, root, keys=keys)) == [r for r in want if r[0] % 3 == 0]
    if sizes.get("bucket_bytes"):
        assert buckets.manifest(spark, root).buckets > 4


def test_replay_roll_back_and_the_failed_write(spark):
    root = table(spark, small_bytes=0)
    first = current_version(spark, root)
    sent = spark.createDataFrame([(0, "insert", 500, 500, "i")], SENT)
    for _ in range(2):
        maintain.commit_changes(spark, root, sent, "id", "batch-1")
    assert buckets.read(spark, root).count() == 201
    broken = sent.withColumn("name", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        maintain.commit_changes(spark, root, broken, "id", "batch-2")
    assert current_version(spark, root) == "batch-1"
    buckets.roll_back(spark, root, first)
    assert buckets.read(spark, root).count() == 200
    maintain.commit_changes(spark, root, broken, "id", "batch-1")
    assert current_version(spark, root) == "batch-1" and buckets.read(spark, root).count() == 201


def test_written_rows_are_those_of_the_last_commit(spark):
    root = table(spark, 100, buckets=4, small_bytes=0)
    maintain.commit_changes(spark, root, spark.createDataFrame([(0, "update", 7, 7, "u"), (1, "delete", 8, 8, None)], SENT), "id")
    old, new = buckets.written(spark, root)
    assert rows_of(old) == [(7, "s7"), (8, "s8")] and rows_of(new) == [(7, "u")]


def test_old_versions_go_and_shared_layers_stay(spark):
    root = table(spark, 100, buckets=4, small_bytes=0)
    spark.range(1).write.parquet(f"{root}/archive")
    first = current_version(spark, root)
    for k in range(4):
        maintain.commit_changes(spark, root, spark.createDataFrame([(0, "update", 7, 7, f"u{k}")], SENT), "id", f"b{k}", keep=2)
    assert rows_of(buckets.read(spark, root).filter("id = 7")) == [(7, "u3")] and buckets.read(spark, root).count() == 100
    assert rows_of(buckets.read(spark, root, "b2").filter("id = 7")) == [(7, "u2")]
    assert spark.read.parquet(f"{root}/archive").count() == 1 and first in {v for x in buckets.manifest(spark, root).layers.values() for v, _ in x}


def test_null_and_repeated_keys_and_empty_tables(spark):
    root = work_path(spark, "bucketed")
    buckets.create(spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (1, "d")], "id long, name string"), root, ["id"], 3, small_bytes=0)
    keys = spark.createDataFrame([(None,), (None,)], "id long")
    buckets.commit(spark, root, keys, lambda base: base.withColumn("name", F.upper("name")))
    assert rows_of(buckets.read(spark, root)) == sorted([(None, "A"), (None, "B"), (1, "c"), (1, "d")], key=repr)
    buckets.commit(spark, root, keys, lambda base: base.limit(0))
    assert rows_of(buckets.read(spark, root)) == [(1, "c"), (1, "d")]
    empty = work_path(spark, "bucketed")
    buckets.create(spark.createDataFrame([], "id long, name string"), empty, ["id"])
    assert buckets.read(spark, empty).count() == 0
    buckets.commit(spark, empty, keys, lambda base: base)
    assert buckets.read(spark, empty).count() == 0
