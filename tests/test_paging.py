"""Pages of a versioned table."""

from pyspark.sql import functions as F

from tallyloom.operators import paging
from tallyloom.session import work_path
from tallyloom.sources.versions import write_version


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_pages_read_few_pieces_and_follow_the_version(spark):
    root = work_path(spark, "paged")
    table = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("f"), F.lit("x").alias("t"))
    first = write_version(table, root)
    want = sorted(map(tuple, table.collect()), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    order = ["f", "k"]
    path = paging.index_pages(spark, root, order)
    index = spark.read.parquet(f"{path}/index").collect()
    assert sum(r.n for r in index) == 20_000 and max(r.n for r in index) < 0.05 * 20_000
    for offset in (0, 6_660, 18_000, 19_990, 30_000):
        assert _rows(paging.read_page(spark, root, order, offset, 25)) == want[offset:offset + 25]
    deep = paging.read_page(spark, root, order, 18_000, 25)
    assert len(deep.inputFiles()) <= 2 and all("/_piece=" in f for f in deep.inputFiles())
    assert paging.index_pages(spark, root, order) == path
    write_version(table.filter("k % 2 = 0"), root)
    even = [r for r in want if r[0] % 2 == 0]
    assert _rows(paging.read_page(spark, root, order, 9_000, 40)) == even[9_000:9_040]
    assert _rows(paging.read_page(spark, root, order, 18_000, 5, version=first)) == want[18_000:18_005]


def test_pages_of_a_table_without_rows(spark):
    root = work_path(spark, "paged")
    write_version(spark.createDataFrame([], "k long, t string"), root)
    got = paging.read_page(spark, root, ["k"], 0, 5)
    assert got.columns == ["k", "t"] and _rows(got) == []
