import pytest
from pyspark.sql import functions as F

from tallyloom.llm import urltree


def frame(spark, rows):
    return spark.createDataFrame(rows, "host string, path string, bad boolean")


@pytest.mark.parametrize(("url", "host", "path", "rule"), [
    (None, "", "", None), ("no scheme", "", "", None), ("http://A.Example.COM/en/1?x=/#y", "a.example.com", "/en/1", "example.com/en/"),
    ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"), ("x://com", "com", "", None),
    ("x://b.www.example.com/en/2", "b.www.example.com", "/en/2", "www.example.com/en/"), ("http://com/", "com", "/", "com/"),
    ("http://x.net?/es/", "x.net", "", None), ("http://xnet/es/", "xnet", "/es/", None), ("http://net/es/é", "net", "/es/é", "net/es/"),
    ("http://É.net#a", "É.net", "", None), ("a://b://c/d", "b:", "//c/d", None), ("://", "", "", None)])
def test_parts_and_rules(spark, url, host, path, rule):
    row = spark.createDataFrame([(url,)], "url string").select(
        urltree.host_of(F.col("url")).alias("host"), urltree.path_of(F.col("url")).alias("path"))
    got = row.select("host", "path", urltree.rule_for(F.col("host"), F.col("path"))[0].alias("rule")).first()
    assert tuple(got) == (host, path, rule)


def test_tree_tells_branches_apart(spark):
    rows = [("a.org", f"/spam/{k}/x{k}", True) for k in range(40)] + [("a.org", f"/spam/{k}/y", None) for k in range(30)]
    rows += [("a.org", f"/{s}/{k}", False) for s in ("news", "blog", "wiki") for k in range(40)]
    rows += [("a.org", f"/open/{k}.html", None) for k in range(200)] + [("a.org", f"/rare{k}/{'f' * 20}", None) for k in range(9)]
    rows += [("b.org", "/only/one", None), ("b.org", "", None), ("", "", None), ("c.org", "/1/2/3/4/5/6/7", True), ("c.org", "/1/2/3/4/9/9", True)]
    urls = frame(spark, rows).selectExpr("*", "'d' AS doc", "'t' AS template", "1 AS segs")
    got = urltree.judge(urls).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault((r.doc.host, r.template), set()).add(r.rejected)
    assert of[("a.org", "/spam/#/x#")] == {True}
    assert all(x == {False} for (h, t), x in of.items() if h == "a.org" and t != "/spam/#/x#"), of
    assert of[("c.org", "/#/#/#/#/#/#/#")] == of[("c.org", "/#/#/#/#/#/#")] == {False}, "one label is too few against the overall share"
    assert of[("b.org", "")] == {False} and of[("", "")] == {False}


def test_hot_host_with_many_slugs_merges(spark):
    rows = [("h.org", f"/p/slug-{chr(97 + k % 26)}{chr(97 + k // 26)}", None) for k in range(500)]
    got = urltree.templates(frame(spark, rows)).select("template").distinct().collect()
    assert [r.template for r in got] == ["/p/*"]


def test_empty(spark):
    assert urltree.judge(frame(spark, [])).count() == 0


@pytest.mark.parametrize("times", [1, 100])
def test_one_mix_has_one_verdict_at_every_size(spark, times):
    rows = [("x.net", f"/de/page-{chr(97 + k % 26)}", None) for k in range(12 * times)] + [("x.net", f"/fr/{k}", True) for k in range(8 * times)]
    rows += [("y.net", f"/en/{k}", None) for k in range(18 * times)] + [("y.net", f"/de/{k}", None) for k in range(4 * times)]
    rows += [("y.net", f"/{c}/{k}", True) for c, m in (("es", 4), ("fr", 3)) for k in range(m * times)]
    rows += [("z.net", f"/es/{k}", True) for k in range(19 * times)] + [("z.net", f"/de/{k}", None) for k in range(times)]
    got = {(r.doc.host, r.doc.path.split("/")[1], r.rejected) for r in urltree.judge(frame(spark, rows)).collect() if r.doc.bad is None}
    assert got == {("x.net", "de", False), ("y.net", "en", False), ("y.net", "de", False), ("z.net", "de", False)}


def test_unlabelled_slugs_beside_bad_ones_are_rejected(spark):
    slug = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    rows = [("s.org", f"/spam/{s}", True if k % 4 else None) for k, s in enumerate(slug)] + [("s.org", f"/ok/{s}", False) for s in slug]
    got = urltree.judge(frame(spark, rows)).collect()
    assert {(r.template, r.rejected) for r in got} == {("/spam/*", True), ("/ok/*", False)}


def test_long_paths_repeated_rows_and_branches_far_down(spark):
    deep = "/a" * 10_000
    rows = [("d.org", f"{deep}/x/{k}", True) for k in range(30)] + [("d.org", f"{deep}/y/{k}", None) for k in range(30)]
    rows += [("d.org", f"{deep}/x/1", True)] * 5 + [("d.org", deep, None)] * 3
    got = urltree.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.template[len(deep):], r.rejected) for r in got} == {("/x/#", True), ("/y/#", False), ("", False)}


def test_sql_gives_the_same_templates(spark):
    import random

    import duckdb
    draw = random.Random(4)
    pages = [(k, f"http://{draw.choice(['net', 'a.net', 'b.example.com'])}/" + "/".join(
        draw.choice(["es", "fr", "en", "de", "x1", "y", "", "0123456789abcdef"]) for _ in range(draw.randrange(0, 7))))
        for k in range(600)] + [(600, None), (601, "none"), (602, "http://net")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    urls = df.select("page_id", urltree.host_of(F.col("url")).alias("host"), urltree.path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("bad", urltree.rule_for(F.col("host"), F.col("path"))[1])
    got = {r.doc.page_id: (r.template, bool(r.doc.bad if r.doc.bad is not None else r.rejected)) for r in urltree.judge(urls).collect()}
    con = duckdb.connect()
    con.register("pages", df.toArrow())
    want = {r[0]: (r[1], r[2] == "block") for r in con.execute(f"SELECT page_id, template, verdict FROM ({urltree.oracle()})").fetchall()}
    assert got == want
