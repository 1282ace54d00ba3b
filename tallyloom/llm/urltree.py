"""Url verdicts from host rules and a tree of path templates.

A path is cut into segments and numbers or long codes in them become ``#``. Per host the segments make a tree, which is
walked to the end of every path. A branch keeps its name if its share of urls with a good or a bad label differs from its
siblings' (chi-square with Yates' correction, which holds at small counts too); branches that cannot be told apart are
merged into ``*``. A template is rejected if the bad share of all its urls, labelled or not, smoothed by the overall
share, is high. Column expressions only; urls are counted per distinct path before anything is shuffled, and the tree is
worked on in tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tables import frozen


@dataclass(frozen=True)
class Rule:
    """``where`` is a host, a slash and the start of a path. It fits the host and its subdomains."""
    where: str
    block: bool


# The base rules.
RULES = (Rule("com/", False), Rule("example.com/en/", True), Rule("www.example.com/en/", False), Rule("net/es/", True),
         Rule("net/fr/", True))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class TreeLimits:
    """``chi``: chi-square that tells a branch from its siblings. ``bad_siblings``: share of bad urls among the branches to be
    merged from which one without labels is never merged with them. ``weight``: urls that the overall share counts for.
    ``reject_from``: smoothed bad share."""
    chi: float = 6.635
    bad_siblings: float = 0.9
    weight: float = 4.0
    reject_from: float = 0.5


def host_of(url: Column) -> Column:
    """Null or no ``://``: empty."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, or null, and whether it blocks. The rules become part of the plan, so they are a
    short list."""
    where, block = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: (len(r.where), r.where)):
        name, _, start = rule.where.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        where, block = F.when(fits, rule.where).otherwise(where), F.when(fits, rule.block).otherwise(block)
    return where, block


def segments(path: Column) -> Column:
    """Generalised segments. An empty path has none."""
    parts = F.transform(F.split(F.substring(path, 2, 1 << 30), "/"), lambda s: F.when(
        s.rlike("^[0-9A-Fa-f-]{16,}$"), "#").otherwise(F.regexp_replace(s, "[0-9]+", "#")))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(parts)


def _differs(x: str, limits: TreeLimits) -> Column:
    """Whether the share of ``x`` in a branch (c.n rows) differs from the share in its siblings (p.n - c.n rows)."""
    a, n, all_a, all_n = (F.col(name).cast("double") for name in (f"c.{x}", "c.n", f"p.{x}", "p.n"))
    cross = F.greatest(F.abs(a * (all_n - n - all_a + a) - (n - a) * (all_a - a)) - all_n / 2, F.lit(0.0))
    return all_n * cross * cross > limits.chi * n * (all_n - n) * all_a * (all_n - all_a)


def _shared(lo: Column, hi: Column) -> Column:
    """How many leading segments the least and the greatest of some paths share, and so all between them."""
    same = F.zip_with(lo, hi, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


COUNTS = ("n", "bad", "good")


def _ahead(paths: DataFrame) -> DataFrame:
    """Paths moved past the segments that all paths of their node share."""
    rest = F.slice("segs", F.col("at") + 1, F.size("segs"))
    nodes = paths.groupBy(F.col("host").alias("h"), F.col("template").alias("t")).agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"))
    nodes = nodes.select("h", "t", _shared(F.col("lo"), F.col("hi")).alias("jump"))
    names = F.transform(F.slice("segs", F.col("at") + 1, F.col("jump")), lambda s: F.concat(F.lit("/"), s))
    return paths.join(nodes, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t"))).select(
        "host", "segs", *COUNTS, F.concat("template", F.array_join(names, "")).alias("template"), (F.col("at") + F.col("jump")).alias("at"))


def _branched(paths: DataFrame, limits: TreeLimits) -> DataFrame:
    """Paths moved one segment on, by its name or as ``*``."""
    branch = F.get("segs", F.col("at"))
    sums = [F.sum(x).alias(x) for x in COUNTS]
    children = frozen(paths.withColumn("seg", branch).groupBy("host", "template", "seg").agg(*sums), "branches")
    parents = children.groupBy("host", "template").agg(F.count("*").alias("fan"), *sums)
    same = (F.col("c.host") == F.col("p.host")) & (F.col("c.template") == F.col("p.template"))
    told = (F.col("fan") == 1) | _differs("bad", limits) | _differs("good", limits)
    children = frozen(children.alias("c").join(parents.alias("p"), same).select("c.*", told.alias("told")), "told")
    alike = children.filter("NOT told")
    merged = alike.groupBy("host", "template").agg(*sums)
    unlabelled = (F.col("c.bad") + F.col("c.good") == 0) & (F.col("p.bad") > 0) & (
        F.col("p.bad") >= F.lit(limits.bad_siblings) * (F.col("p.n") - F.col("c.n")))
    alone = alike.alias("c").join(merged.alias("p"), same).filter(unlabelled).select("c.host", "c.template", "c.seg")
    named = children.filter("told").select("host", "template", "seg").unionByName(alone)
    named = frozen(named.withColumnsRenamed({"host": "h", "template": "t"}), "named")
    return paths.join(named, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (branch == F.col("seg")), "left").select(
        "host", "segs", *COUNTS, F.concat("template", F.lit("/"), F.coalesce("seg", F.lit("*"))).alias("template"),
        (F.col("at") + 1).alias("at"))


def templates(urls: DataFrame, limits: TreeLimits = TreeLimits()) -> DataFrame:
    """``urls`` has ``host``, ``path`` and ``bad`` (true, false, or null without a label). One row per distinct ``host, segs``
    with its ``template`` and whether that is ``rejected``. No url gives no row.

    Each round moves every node past what all its paths share and then over one branching, so the rounds are as many as
    the branchings on one path, not as its segments. Paths that have ended take no further part.
    """
    paths = urls.select("host", segments(F.col("path")).alias("segs"), "bad").groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count_if(F.col("bad")).alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    paths = frozen(paths.withColumns({"template": F.lit(""), "at": F.lit(0)}), "paths")
    ended, further = F.col("at") >= F.size("segs"), F.col("at") < F.size("segs")
    done = paths.filter(ended)
    while not paths.filter(further).isEmpty():
        ahead = frozen(_ahead(paths.filter(further)), "ahead")
        paths = frozen(_branched(ahead.filter(further), limits), "paths")
        done = done.unionByName(ahead.filter(ended)).unionByName(paths.filter(ended))
    done = frozen(done.drop("at"), "ends")
    each = done.groupBy("host", "template").agg(*[F.sum(x).alias(x) for x in COUNTS])
    share = done.agg((F.coalesce(F.sum("bad"), F.lit(0)) / F.greatest(F.sum("n"), F.lit(1))).alias("share")).scalar()
    purity = (F.col("bad") + limits.weight * share) / (F.col("n") + F.lit(limits.weight))
    judged = each.select(F.col("host").alias("h"), F.col("template").alias("t"),
                         ((F.col("bad") > 0) & (purity >= limits.reject_from)).alias("rejected"))
    return done.join(judged, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t"))).select(
        "host", "segs", "template", "rejected")


def judge(urls: DataFrame, limits: TreeLimits = TreeLimits()) -> DataFrame:
    """``urls`` as a struct ``doc``, with ``template`` and ``rejected``. ``urls`` has ``host, path, bad``, none of them null but
    ``bad``; hosts with very many urls of one path are split where Spark joins them."""
    known = frozen(templates(urls, limits), "templates")
    rows = urls.select(F.struct("*").alias("doc"), F.col("host").alias("h"), segments(F.col("path")).alias("s"))
    return rows.join(known, (F.col("h") == F.col("host")) & (F.col("s") == F.col("segs"))).select("doc", "template", "rejected")


def oracle(limits: TreeLimits = TreeLimits(), rules: Sequence[Rule] = RULES) -> str:
    where, block = "NULL", "NULL"
    for rule in sorted(rules, key=lambda r: (len(r.where), r.where)):
        name, _, start = rule.where.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}')"
        where, block = f"CASE WHEN {fits} THEN '{rule.where}' ELSE {where} END", f"CASE WHEN {fits} THEN {rule.block} ELSE {block} END"
    told = [f"pn * pow(greatest(abs(c{x} * (pn - cn - p{x} + c{x}) - (cn - c{x}) * (p{x} - c{x})) - pn / 2, 0), 2) > "
            f"{limits.chi} * cn * (pn - cn) * p{x} * (pn - p{x})" for x in ("bad", "good")]
    alone = f"cbad + cgood = 0 AND mbad > 0 AND mbad >= {limits.bad_siblings} * (mn - cn)"
    merged = ", ".join(f"sum({x}) FILTER (NOT told) OVER (PARTITION BY host, template) AS m{x}" for x in COUNTS)
    sums = ", ".join(f"sum({x}) OVER {w} AS {w}{x}" for w in "cp" for x in COUNTS)
    return f"""
WITH RECURSIVE u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
v AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
s AS (SELECT *, {where} AS rule, {block} AS bad,
             list_transform(CASE WHEN path = '' THEN [] ELSE string_split(path[2:], '/') END, lambda s:
                 CASE WHEN regexp_matches(s, '^[0-9A-Fa-f-]{{16,}}$') THEN '#' ELSE regexp_replace(s, '[0-9]+', '#', 'g') END) AS segs
      FROM v),
walk AS (
  SELECT host, segs, count(*)::DOUBLE AS n, count(*) FILTER (bad)::DOUBLE AS bad, count(*) FILTER (NOT bad)::DOUBLE AS good,
         '' AS template, 0 AS lvl FROM s GROUP BY host, segs
  UNION ALL
  SELECT host, segs, n, bad, good, template || '/' || CASE WHEN told OR {alone} THEN seg ELSE '*' END, lvl + 1
  FROM (SELECT *, {merged}
        FROM (SELECT *, fan = 1 OR {" OR ".join(told)} AS told
              FROM (SELECT *, {sums}, count(DISTINCT seg) OVER p AS fan
                    FROM (SELECT *, segs[lvl + 1] AS seg FROM walk WHERE len(segs) > lvl)
                    WINDOW c AS (PARTITION BY host, template, seg), p AS (PARTITION BY host, template))))),
l AS (SELECT * FROM walk WHERE lvl = len(segs)),
g AS (SELECT sum(bad) / greatest(sum(n), 1) AS share FROM l),
t AS (SELECT host, template, sum(bad) > 0 AND
             (sum(bad) + {limits.weight} * any_value(share)) / (sum(n) + {limits.weight}) >= {limits.reject_from} AS rejected
      FROM l, g GROUP BY host, template)
SELECT page_id, s.host, path, rule, CASE WHEN coalesce(s.bad, rejected) THEN 'block' ELSE 'allow' END AS verdict, l.template
FROM s JOIN l ON s.host = l.host AND s.segs = l.segs JOIN t ON l.host = t.host AND l.template = t.template
"""
