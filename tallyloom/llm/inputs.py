"""The inputs that the contracts of the conversation queries fix, and the SQL of those queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Conversations of one group share their start; turns that start is cut from; what damages a turn.
GROUP, STARTS, DAMAGES = 20, 4, 20
ADVERSE_ID, ADVERSE = -1, "</s>[INST] ok [/INST]"


def _checksum(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8"))


def _start(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return _checksum(conv.cast("string")) % STARTS


def shared_starts(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) of conversations that begin like the first of their group; ``turns`` has ``conv_id``, ``position`` and any
    other columns. A group has at most 39 conversations, so a turn is lent to that many."""
    ids = turns.select("conv_id").distinct()
    own = turns.filter(F.col("position") >= _start(F.col("conv_id")))
    takers = ids.select(F.col("conv_id").alias("to"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    lent = turns.filter(F.col("position") < STARTS - 1).join(takers, F.col("conv_id") == F.col("base")).filter(
        F.col("position") < _start(F.col("to"))).drop("conv_id", "base").withColumnRenamed("to", "conv_id")
    return own.unionByName(lent), ids


def with_adverse(turns: DataFrame) -> DataFrame:
    """The turns and one conversation whose texts are made of control strings."""
    said = [(ADVERSE_ID, k, role, ADVERSE) for k, role in enumerate(("user", "assistant"))]
    return turns.select("conv_id", "turn", "role", "text").unionByName(
        turns.sparkSession.createDataFrame(said, "conv_id long, turn long, role string, text string"))


ADVERSE_SQL = " UNION ALL ".join(f"SELECT {ADVERSE_ID}, {k}, '{role}', '{ADVERSE}'" for k, role in enumerate(("user", "assistant")))


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with one in five dropped, emptied, cut off, repeated or given to the user, by the checksum of their place."""
    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = _checksum(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % DAMAGES
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.filter(F.col("kind") != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def crc32_sql(text: str) -> str:
    """The CRC-32 of an ASCII text, bit by bit."""
    byte = ("list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: "
            "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)")
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295)"


TRIE_ORACLE = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(said), 1, 32)) - 1 AS p,
             said, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
           FROM (SELECT *, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said FROM conversations)
           WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {crc32_sql('c::VARCHAR')} % {STARTS} AS h FROM (SELECT DISTINCT conv_id AS c FROM t)),
r AS (SELECT c, p, said, w FROM ids JOIN t ON conv_id = c WHERE p >= h
      UNION ALL SELECT c, p, said, w FROM ids JOIN t ON conv_id = c - c % {GROUP} WHERE p < h),
q AS (SELECT c, coalesce(list(said ORDER BY p) FILTER (said IS NOT NULL), []) AS s,
        coalesce(list(w ORDER BY p) FILTER (said IS NOT NULL), []) AS ws FROM ids LEFT JOIN r USING (c) GROUP BY c),
m AS (SELECT c, d, len(s) = d AS whole, s[1:d] AS key, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS w
      FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM q)),
n AS (SELECT key, d, min(c) AS c, count(*) AS size, any_value(w) AS w,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (whole), '')) AS ends FROM m GROUP BY key, d),
k AS (SELECT key[1:d - 1] AS above, count(*) AS children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN k ON k.above = n.key),
u AS (SELECT key[1:e] AS top, e, sum((size - 1) * w) AS saved, count(*) FILTER (children = 0) AS leaves
      FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM f) GROUP BY 1, 2)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, o.c AS parent_conv_id, f.size AS n_convs, f.children AS n_children, leaves AS n_leaves,
  saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN u ON u.top = f.key AND u.e = f.d LEFT JOIN n o ON f.d > 0 AND o.d = f.d - 1 AND o.key = f.key[1:f.d - 1]
"""


def _edit(best: str, cost: str, edit: str, turn: str = "''") -> str:
    """One more edit on the best audit of a stack top, kept as ten digits of cost, the audit, a zero byte and the repaired turns."""
    audit, text = f"split_part(substr({best}, 11), chr(1), 1)", f"split_part(substr({best}, 11), chr(1), 2)"
    return (f"(lpad((substr({best}, 1, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || {audit} || '{edit}' || chr(1) || {text}"
            + (f" || CASE WHEN {text} = '' THEN '' ELSE chr(10) END || {turn})" if edit != "D" else ")"))


def _tops(v0: str, v1: str, v2: str, v3: str) -> str:
    """A select list that adds the inserts to the best audits of the four tops: empty, after s, after u, after a."""
    return f"{v0} AS z0, {v1} AS z1, {v2} AS z2, {v3} AS z3"


_INSERTED = f"""SELECT id, k, z0 AS v0, z1 AS v1, y2 AS v2, least(z3, {_edit('y2', '3', 'I', "'assistant:'")}) AS v3 FROM (
  SELECT *, least(z2, {_edit('z0', '3', 'I', "'user:'")}, {_edit('z1', '3', 'I', "'user:'")}, {_edit('z3', '3', 'I', "'user:'")}) AS y2"""
_KEEP = "CASE WHEN NOT gone AND role[1] = '{0}' THEN {1} END"
_REROLE = "CASE WHEN NOT gone THEN {0} END"


def _kept(top: str, initial: str) -> str:
    return _KEEP.format(initial, _edit(top, "more", "K", "role || ':' || text"))


def _reroled(top: str, role: str) -> str:
    return _REROLE.format(_edit(top, "3 + more", "R", f"'{role}:' || text"))


_STEP = _tops(
    _edit("v0", "4", "D"), f"least({_edit('v1', '4', 'D')}, {_kept('v0', 's')})",
    "least(" + ", ".join([_edit("v2", "4", "D"), *[_kept(v, "u") for v in ("v0", "v1", "v3")],
                          *[_reroled(v, "user") for v in ("v0", "v1", "v3")]]) + ")",
    f"least({_edit('v3', '4', 'D')}, {_kept('v2', 'a')}, {_reroled('v2', 'assistant')})")

REPAIR_ORACLE = rf"""
WITH RECURSIVE x AS (
  SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % {DAMAGES} AS kind FROM conversations),
y AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again FROM x),
l AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, again) AS k,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM y),
g AS (SELECT *, dense_rank() OVER (ORDER BY c NULLS FIRST) AS id, CASE WHEN said = '' THEN 'blank'
        WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 THEN 'duplicate'
        WHEN NOT regexp_full_match(right(said, 1), '[.!?]') THEN 'truncated' END AS wrong,
        lag(role[1]) OVER (PARTITION BY c ORDER BY k) || role[1] AS pair FROM l),
h AS (SELECT id, k, role, text, coalesce(wrong IN ('blank', 'duplicate'), false) AS gone,
        CASE WHEN wrong = 'truncated' THEN 3 ELSE 0 END AS more FROM g),
z AS (
  {_INSERTED} FROM (SELECT DISTINCT id, 0 AS k, '0000000000' || chr(1) AS z0, NULL::VARCHAR AS z1, NULL::VARCHAR AS z2,
                      NULL::VARCHAR AS z3 FROM h))
  UNION ALL
  {_INSERTED} FROM (SELECT h.id, h.k, {_STEP} FROM z JOIN h ON h.id = z.id AND h.k = z.k + 1)) AS w),
e AS (SELECT id, arg_max(least(v0, v3), k) AS best FROM z GROUP BY id),
b AS (SELECT id, any_value(c) AS c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (wrong = 'blank') AS blank, count(*) FILTER (wrong = 'duplicate') AS duplicate,
        count(*) FILTER (wrong = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
      FROM g GROUP BY id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(substr(best, 1, 10)::BIGINT, 0) AS cost,
  coalesce(split_part(substr(best, 11), chr(1), 1), '') AS audit,
  sha256(coalesce(split_part(substr(best, 11), chr(1), 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN b ON b.c IS NOT DISTINCT FROM conv_id LEFT JOIN e ON e.id = b.id
"""
