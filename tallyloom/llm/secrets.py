"""Secret scans over every version of every file, with a ledger of what has been scanned.

A version's content is named by its digest. The ledger holds, for each blob and rule version, the spans found (none is
recorded too). A run scans only blobs for which some pair of blob and rule version is not in the ledger, and in them only
the missing rules; findings then go back to every path that holds the blob. Column expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tables import let
from tallyloom.sources.versions import is_folder

PAIRS = "array<struct<rule: string, version: int, spans: array<struct<start: int, end: int>>>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost matches that do not overlap; those whose group ``group`` has fewer than ``least``
    characters are dropped."""
    name: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0


# The base rules, in the order that counts for equal starts.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Rules beyond the base.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"://[A-Za-z0-9._~%-]{1,100}:[A-Za-z0-9._~%!*-]{1,100}@"),
)
RULES = BASE + MORE


SPANS = "array<struct<start: int, end: int>>"
#: Matches that are summed up in one go; appending to a list copies it, so lists stay this short.
RUN = 256


def _laid(runs: Column) -> Column:
    """Spans of the matches that are kept, from runs of (gap before, length, kept). Each run is laid from its own start, and
    then moved by the length of the runs before it."""
    none = F.array().cast(SPANS)

    def step(a: Column, x: Column) -> Column:
        here = a["at"] + x["g"]
        span = F.array(F.struct(here.alias("start"), (here + x["h"]).alias("end")))
        return F.struct((here + x["h"]).alias("at"), F.when(x["ok"], F.concat(a["found"], span)).otherwise(a["found"]).alias("found"))

    own = F.transform(runs, lambda run: F.aggregate(run, F.struct(F.lit(0).alias("at"), none.alias("found")), step))

    def move(a: Column, run: Column) -> Column:
        moved = F.transform(run["found"], lambda s: F.struct((a["at"] + s["start"]).alias("start"), (a["at"] + s["end"]).alias("end")))
        return F.struct((a["at"] + run["at"]).alias("at"), F.concat(a["found"], F.array(moved)).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("found"))
    return F.flatten(F.aggregate(own, start, move, lambda a: a["found"]))


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the matches, in code points. The text between matches and the matches themselves
    are measured and added up."""
    def placed(gaps: Column) -> Column:
        def found(hits: Column) -> Column:
            ok = (lambda h: F.length(F.regexp_extract(h, rule.pattern, rule.group)) >= rule.least) if rule.least else (lambda h: F.lit(True))
            sized = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(
                F.length(g).alias("g"), F.length(h).alias("h"), ok(h).alias("ok")))
            return let(sized, lambda x: _laid(F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(RUN)), lambda at: F.transform(
                F.sequence(at, F.least(at + (RUN - 1), F.size(x) - 1)), lambda i: F.get(x, i)))))  # slice would read all of x
        return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), found)

    return F.when(text.rlike(rule.pattern), let(F.split(text, rule.pattern, -1), placed)).otherwise(F.array().cast(SPANS))


def blob_of(text: Column) -> Column:
    """The name of a content. Null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def unseen(versions: DataFrame, ledger: str, rules: Sequence[Rule], content: str) -> DataFrame:
    """``blob, text, todo``: one row for each blob that lacks a rule version in the ledger, and the names it lacks."""
    spark = versions.sparkSession
    rows = versions.select(blob_of(F.col(content)).alias("blob"), F.coalesce(content, F.lit("")).alias("text"))
    every = F.array(*[F.lit(f"{r.name}@{r.version}") for r in rules])
    if is_folder(spark, ledger):
        seen = spark.read.parquet(ledger).select("blob", F.explode("pairs").alias("p")).select(
            F.col("blob").alias("known"), F.concat_ws("@", "p.rule", "p.version").alias("pair"))
        seen = seen.groupBy("known").agg(F.collect_set("pair").alias("done"))  # at most a pair for each rule version
        rows = rows.join(seen, F.col("blob") == F.col("known"), "left")
        rows = rows.withColumn("todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
        rows = rows.filter(F.size("todo") > 0).select("blob", "text", "todo")
    else:
        rows = rows.withColumn("todo", every)
    return rows.dropDuplicates(["blob"])


def scan(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, content: str = "text") -> None:
    """Scan what the ledger lacks and add it. A run that fails adds nothing; one that is repeated scans nothing twice.
    No version adds no row, and a null content is the empty one."""
    todo = unseen(versions, ledger, rules, content)
    pairs = [F.when(F.array_contains("todo", f"{r.name}@{r.version}"), F.struct(
        F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r in rules]
    found = F.filter(F.array(*pairs), lambda p: p.isNotNull()).cast(PAIRS)
    todo.select("blob", found.alias("pairs")).write.mode("append").parquet(ledger)


def findings(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, content: str = "text") -> DataFrame:
    """Every version's columns as a struct ``version``, with ``spans``: array<struct<start, rank, kind, end>> of the given
    rule versions, by start and then in the order of the rules. Repeated rows come back as often; no version gives no row."""
    order = {(r.name, r.version): k for k, r in enumerate(rules)}
    spark = versions.sparkSession
    ranked = F.lit(None).cast("int")
    for (name, version), k in order.items():
        ranked = F.when((F.col("p.rule") == name) & (F.col("p.version") == version), k).otherwise(ranked)
    known = spark.read.schema(f"blob binary, pairs {PAIRS}").parquet(ledger).select("blob", F.explode("pairs").alias("p"))
    known = known.select("blob", ranked.alias("rank"), F.col("p.rule").alias("kind"), F.col("p.spans").alias("spans"))
    known = known.filter(F.col("rank").isNotNull() & (F.size("spans") > 0)).dropDuplicates(["blob", "rank"])
    known = known.groupBy(F.col("blob").alias("found_blob")).agg(F.sort_array(F.flatten(F.collect_list(F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), F.col("kind").alias("kind"),
                                    s["end"].alias("end")))))).alias("spans"))
    paths = versions.select(F.struct(*[c for c in versions.columns if c != content]).alias("version"), blob_of(F.col(content)).alias("blob"))
    none = F.array().cast("array<struct<start: int, rank: int, kind: string, end: int>>")
    return paths.join(known, F.col("blob") == F.col("found_blob"), "left").select(
        "version", "blob", F.coalesce("spans", none).alias("spans"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _sql_kind(rank: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    kept = f"length(regexp_extract(hit, '{pattern}', {rule.group})) >= {rule.least}"
    return f"""
SELECT r, {rank} AS rank, '{rule.name}' AS kind, stop - length(hit) AS s, stop AS e FROM (
  SELECT r, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY k) AS stop FROM (
    SELECT r, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS k FROM (
      SELECT r, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM t)))
WHERE {kept}"""


ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_sql_kind(k, r) for k, r in enumerate(RULES))}),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (r)
"""
