"""Conversations of typed content parts as training text, with a loss mask and attachment references.

A visitor turns each part into text: words stay, escaped; an image, a sound or a document becomes a placeholder, and its
reference and the tokens it will expand to are recorded in the order of the placeholders. A turn is an opening mark, its
parts with ``<part>`` between them, and a closing mark. Inside texts a control string gets one backslash after its first
character, and one more if it has some already, so that no text ever holds a mark and reading back is exact. Column
expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of a turn by role, for any other role, between parts, and in place of an attachment by its kind.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<sys>", "</sys>")}
OTHER_OPENS, OTHER_CLOSES = "[TURN:", "[/TURN]"
PART = "<part>"
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
UNKNOWN = "<file>"
LOSS_ROLE = "assistant"
#: Signs of a role name that would end its mark, by what stands for them.
ROLE_SIGNS = {"%": "%25", "]": "%5D", "[": "%5B", "<": "%3C"}
#: The control strings without their first character, as a pattern.
REST = r"/?INST\]|/?s>|/?sys>|TURN:|/TURN\]|part>|image>|audio>|document>|file>"
CLOSES = r"\[/INST\]|</s>|</sys>|\[/TURN\]"
PART_TYPE = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


@dataclass(frozen=True)
class Expansion:
    """Tokens of an attachment: ``patch`` pixels a side make one, a second makes ``second``, a page makes ``page``."""
    patch: int = 28
    second: int = 25
    page: int = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({REST})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({REST})", "$1$2$3")


def _named(role: Column, back: bool = False) -> Column:
    for sign, code in reversed(ROLE_SIGNS.items()) if back else ROLE_SIGNS.items():
        role = F.replace(role, F.lit(code if back else sign), F.lit(sign if back else code))
    return role


def _by_role(role: Column, side: int, other: Column) -> Column:
    return F.coalesce(*[F.when(role == name, F.lit(marks[side])) for name, marks in MARKS.items()], other)


def visit(part: Column) -> Column:
    """The text of one part: escaped words, or a placeholder. A part without a kind is text; null text is empty."""
    words = F.when(F.coalesce(part["kind"], F.lit("text")) == "text", escape(F.coalesce(part["text"], F.lit(""))))
    holders = [F.when(part["kind"] == kind, F.lit(holder)) for kind, holder in PLACEHOLDERS.items()]
    return F.coalesce(words, *holders, F.lit(UNKNOWN))


def n_tokens(part: Column, costs: Expansion) -> Column:
    """What a placeholder expands to. Sizes that are null or under one count as one; an unknown kind expands to one token."""
    def size(name: str) -> Column:
        return F.greatest(F.coalesce(part[name], F.lit(1)).cast("double"), F.lit(1.0))

    tiles = F.ceil(size("width") / costs.patch) * F.ceil(size("height") / costs.patch)
    return F.when(part["kind"] == "image", tiles).when(part["kind"] == "audio", F.ceil(size("seconds") * costs.second)).when(
        part["kind"] == "document", F.ceil(size("pages")) * costs.page).otherwise(1).cast("long")


def text_part(text: Column) -> Column:
    """One part that is text."""
    names = [f.split(":")[0].strip() for f in PART_TYPE[len("struct<"):-1].split(",")]
    values = {"kind": F.lit("text"), "text": text}
    return F.struct(*[values.get(n, F.lit(None)).alias(n) for n in names]).cast(PART_TYPE)


def formatted(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", parts: str = "parts",
              costs: Expansion = Expansion()) -> DataFrame:
    """One row a conversation: ``n_turns``, ``segments`` (text, loss), ``attachments`` (turn number from 0, kind, reference, tokens)
    in the order of their placeholders, and ``attachment_tokens``.

    The training text is the segments one after another (``whole_text``); those with ``loss`` are what is learned, the assistant's
    content without its marks. ``parts`` is an array of ``PART_TYPE``; one that is null or empty reads back as one
    empty text, a null role is an empty one.
    Turns go by ``order``, null first, then by role and content; repeated rows stay. Null conversations are one conversation. An empty
    table gives no row. A conversation is one cell and must stay under Spark's 2 GB.
    """
    content = F.coalesce(F.col(parts), F.array().cast(f"array<{PART_TYPE}>"))
    held = F.filter(content, lambda p: F.coalesce(p["kind"], F.lit("text")) != "text")
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.struct(
            F.col(order).alias("at"), F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.array_join(F.transform(content, visit), PART).alias("flat"),
            F.transform(held, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"),
                                                 n_tokens(p, costs).alias("n_tokens"))).alias("held")).alias("turn"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def marked(t: Column) -> Column:
        opens = _by_role(t["role"], 0, F.concat(F.lit(OTHER_OPENS), _named(t["role"]), F.lit("]")))
        closes = _by_role(t["role"], 1, F.lit(OTHER_CLOSES))
        return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in (
            (opens, F.lit(False)), (t["flat"], t["role"] == LOSS_ROLE), (closes, F.lit(False)))])

    attached = F.flatten(F.transform("turns", lambda t, i: F.transform(t["held"], lambda a: F.struct(
        i.cast("long").alias("turn_no"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens")))))
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", marked)).alias("segments"),
        attached.alias("attachments")).withColumn("attachment_tokens", F.aggregate(
            F.transform("attachments", lambda a: a["n_tokens"]), F.lit(0).cast("long"), lambda a, b: a + b))


def whole_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learned_text(segments: Column) -> Column:
    """All content under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_back(text: Column) -> Column:
    """The turns of a training text: an array of ``role, parts``, where a part is its kind (``file`` for an unknown one) and text."""
    def turn(piece: Column) -> Column:
        named = rf"(?s)^\{OTHER_OPENS}([^\]]*)\](.*)"
        role, body = _named(F.regexp_extract(piece, named, 1), True), F.regexp_extract(piece, named, 2)
        for name, (opens, _) in MARKS.items():
            role = F.when(piece.startswith(opens), name).otherwise(role)
            body = F.when(piece.startswith(opens), F.substring(piece, len(opens) + 1, 2 ** 31 - 1)).otherwise(body)
        return F.struct(role.alias("role"), F.transform(F.split(body, PART), part).alias("parts"))

    def part(flat: Column) -> Column:
        known = {**PLACEHOLDERS, "file": UNKNOWN}
        kind = F.coalesce(*[F.when(flat == holder, F.lit(name)) for name, holder in known.items()], F.lit("text"))
        return F.struct(kind.alias("kind"), F.when(kind == "text", unescape(flat)).alias("text"))

    pieces = F.split(text, CLOSES)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def oracle(extra: str) -> str:
    """The digests of the query over ``conversations`` and the rows of ``extra`` in SQL; lengths come from the marks alone."""
    def sizes(role: str) -> str:
        known = " ".join(f"WHEN '{name}' THEN {sum(map(len, marks))}" for name, marks in MARKS.items())
        name = role
        for sign, code in ROLE_SIGNS.items():
            name = f"replace({name}, '{sign}', '{code}')"
        return f"CASE {role} {known} ELSE {len(OTHER_OPENS) + 1 + len(OTHER_CLOSES)} + length({name}) END"

    return rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL {extra}),
s AS (SELECT *, {sizes('role')} + length(regexp_replace(text, '([<\[])(\\*)({REST})', '\1\\\2\3', 'g')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
