"""Quality rules per document and per host.

Every document is measured and held against a list of rules. Failures are summed per host, the failure rate of
a host is shrunk towards the other hosts by a beta prior fitted to all of them, and the verdict goes back to the
host's documents. In a rejected host a document goes if it fails any rule, so that clean documents stay wherever they
are; a document that fails a base rule goes from every host. Column expressions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tables import SPACE, frozen, let, words_of

# Base limits and the symbols that count.
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class HostLimits:
    """A host is rejected if the odds of its documents to fail are beyond ``worse`` times the odds of the prior's mean, by
    ``sure`` standard deviations of its posterior. ``least_strength`` and ``most_strength`` bound the weight of the prior,
    in documents."""
    worse: float = 3.0
    sure: float = 1.645
    least_strength: float = 2.0
    most_strength: float = 1000.0


def repeated_words(words: Column) -> Column:
    """How many words lie in a five-word window that occurs twice or more."""
    def windows(h: Column) -> Column:
        starts = F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    def covered(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def again(rows: Column) -> Column:
            twice = F.filter(rows, lambda r, j: F.coalesce(r["k"] == F.get(rows, j + 1)["k"], F.lit(False)) | (
                (j > 0) & F.coalesce(r["k"] == F.get(rows, j - 1)["k"], F.lit(False))))
            at = F.sort_array(F.transform(twice, lambda r: r["i"]))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
            return F.aggregate(at, start, lambda a, p: F.struct(
                (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
        return let(placed, again)

    def count(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(covered(keys))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)


def measures(text: Column) -> Column:
    """A struct of what the rules look at. Null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
            repeated_words(words).alias("n_repeat_words"))

    return let(words_of(text), of)


def failures(m: Column) -> dict[str, Column]:
    """Rule name -> whether a document with these measures fails it. Whole numbers, so every engine agrees."""
    return {
        "short": m["n_words"] < LEAST_WORDS,
        "repeats": 100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"],
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "lines": 10 * m["n_dup_lines"] > 3 * m["n_lines"],
        "word_length": (m["word_chars"] < 3 * m["n_words"]) | (m["word_chars"] > 12 * m["n_words"]),
    }


def measured(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` as a struct ``doc``, with ``host``, the measures, and ``n_failed`` rules. A null host is a host of its own."""
    m = docs.select(F.struct("*").alias("doc"), F.col(host).alias("host"), measures(F.col(text)).alias("m"))
    rules = failures(F.col("m"))
    return m.select("doc", "host", "m", (rules["short"] | rules["repeats"]).alias("base_failed"),
                    sum(r.cast("long") for r in rules.values()).alias("n_failed"))


def host_verdicts(rows: DataFrame, limits: HostLimits = HostLimits()) -> DataFrame:
    """One row per host: ``documents``, ``failed``, the shrunk ``rate`` and whether it is ``rejected``.

    The prior is a beta distribution with the mean and the spread of the hosts' rates (method of moments; a host weighs
    by its documents). Hosts that do not differ give the strongest prior allowed; no host gives no row.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("documents"),
                                     F.sum((F.col("n_failed") > 0).cast("long")).alias("failed"))
    hosts = frozen(hosts, "hosts")
    share = F.col("failed") / F.col("documents")
    total = hosts.agg(F.sum("documents").cast("double").alias("n"), F.sum("failed").cast("double").alias("k"),
                      F.sum(F.col("documents") * share * share).alias("square"),
                      F.sum(share * (1 - share)).alias("noise"))
    mean = F.col("k") / F.col("n")
    spread = F.col("square") / F.col("n") - mean * mean - F.col("noise") / F.col("n")
    strength = F.when(spread > 0, F.least(F.greatest(mean * (1 - mean) / spread - 1, F.lit(limits.least_strength)),
                                          F.lit(limits.most_strength))).otherwise(limits.most_strength)
    prior = total.select(F.struct(mean.alias("mean"), strength.alias("strength")).alias("prior")).scalar()
    judged = hosts.withColumn("prior", prior)
    failing = F.col("failed") + F.col("prior.mean") * F.col("prior.strength")
    passing = F.col("documents") - F.col("failed") + (1 - F.col("prior.mean")) * F.col("prior.strength")
    # log odds of the posterior, about normal; a prior without failures, or without anything else, rejects no host
    surely = F.ln(failing) - F.ln(passing) - F.lit(limits.sure) * F.sqrt(
        F.try_divide(F.lit(1.0), failing) + F.try_divide(F.lit(1.0), passing))
    bar = F.ln("prior.mean") - F.ln(1 - F.col("prior.mean")) + F.lit(math.log(limits.worse))
    return judged.select("host", "documents", "failed", (failing / (failing + passing)).alias("rate"),
                         F.coalesce(surely > bar, F.lit(False)).alias("rejected"))


def judge(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Measured documents with their host's verdict and ``kept``.

    Only rejected hosts are joined. Whether they are few enough to be broadcast is for Spark to see from the size of
    their table; beyond that it shuffles and splits hot hosts.
    """
    bad = frozen(verdicts.filter("rejected").select(F.col("host").alias("bad_host"), F.lit(True).alias("bad")), "bad-hosts")
    joined = rows.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    lost = F.col("base_failed") | (F.coalesce(F.col("bad"), F.lit(False)) & (F.col("n_failed") > 0))
    return joined.withColumn("kept", ~lost).drop("bad_host", "bad")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", limits: HostLimits = HostLimits()) -> DataFrame:
    """The documents that stay, with their own columns. An empty table stays empty; equal rows share one fate. Measures
    are taken once: the documents are written with what they fail, and both the hosts' sums and the result read that."""
    rows = frozen(measured(docs, text, host).drop("m"), "measured")
    return judge(rows, host_verdicts(rows, limits)).filter("kept").select("doc.*")


ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(string_split_regex(text, '{SPACE}+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT r, i, list_aggregate(words[i:i+4], 'string_agg', ' ') AS gram
      FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least(5, i - before)) AS n
      FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -5) AS before FROM d) GROUP BY r),
m AS (SELECT t.r, doc_id, source, len(words)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM t JOIN w USING (r) LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             (n_words < 10)::BIGINT + (100 * n_repeat_words > 20 * n_words)::BIGINT + (10 * n_symbols > n_words)::BIGINT
             + (10 * n_dup_lines > 3 * n_lines)::BIGINT
             + (word_chars < 3 * n_words OR word_chars > 12 * n_words)::BIGINT AS n_failed FROM m),
h AS (SELECT source, count(*) AS n, sum((n_failed > 0)::BIGINT) AS k FROM f GROUP BY source),
p AS (SELECT sum(k) / sum(n) AS mean, sum(n * (k / n) * (k / n)) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n))
             - sum((k / n) * (1 - k / n)) / sum(n) AS spread FROM h),
s AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 2.0), 1000.0) ELSE 1000.0 END
             AS strength FROM p),
o AS (SELECT source, mean, k + mean * strength AS failing, n - k + (1 - mean) * strength AS passing FROM h, s),
b AS (SELECT source, CASE WHEN failing > 0 AND passing > 0 AND mean > 0 AND mean < 1 THEN ln(failing) - ln(passing)
             - {HostLimits.sure} * sqrt(1 / failing + 1 / passing) > ln(mean) - ln(1 - mean) + {math.log(HostLimits.worse)}
             ELSE false END AS rejected FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR (rejected AND n_failed > 0)) AS kept, n_failed
FROM f JOIN b ON f.source IS NOT DISTINCT FROM b.source
"""
