from collections import defaultdict

import pytest

from tallyloom.llm import sharding
from tallyloom.session import work_path


@pytest.mark.parametrize(("limit", "step"), [(1, 20), (500, 2), (1 << 30, 4)])
def test_shards_fit_and_split_only_where_too_large(spark, limit, step):
    rows = [(k, "x" * (k % 90)) for k in range(300)] + [(7, "same row " * 5)] * 90 + [(None, None)] * 5 + [(1000, "long" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS doc", "'s' AS shard", "0 AS bits", "2 AS slot")
    got = sharding.assign(docs.repartition(5), sharding.Shards(limit=limit, step=step)).collect()
    assert sorted(str(r.doc.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    held, number = defaultdict(int), defaultdict(int)
    for r in got:
        held[r.shard] += r.n_bytes
        number[r.shard] += 1
    for r in got:
        assert (r.shard_bytes, r.shard_rows) == (held[r.shard], number[r.shard])
    names = sorted(held)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:]))
    for name in names:
        assert held[name] <= limit or number[name] == 1
        if name:
            under = [r for r in got if r.shard.startswith(name[:-1])]
            assert sum(r.n_bytes for r in under) > limit and len(under) > 1


def test_files_and_empty_table(spark):
    docs = spark.createDataFrame([(k, "text " * k) for k in range(40)], "doc_id long, text string")
    path = work_path(spark, "shards")
    sharding.write_shards(docs, path, sharding.Shards(limit=900))
    back = spark.read.parquet(path)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
    assert sharding.assign(docs.limit(0)).count() == 0
