"""Text columns: cleaning, splitting, identifiers, file names, markers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters that count as white space.
WHITE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
         "\u2028\u2029\u202f\u205f\u3000")
# The fragments that are taken out of a text, in this order.
RISKY_FRAGMENTS = (
    r"--.*",
    r"/\*.*?\*/",
    rf";[{WHITE}]*$",
    rf"union[{WHITE}]+select",
    rf"drop[{WHITE}]+table",
    rf"delete[{WHITE}]+from",
    rf"insert[{WHITE}]+into",
    rf"update[{WHITE}]+set",
    rf"exec[{WHITE}]*\(",
    rf"execute[{WHITE}]*\(",
)
# A text with none of these, in small letters, holds no such fragment.
RISKY_WORDS = ("--", "/*", ";", "union", "drop", "delete", "insert", "update", "exec")
IDENTIFIER = r"^[a-zA-Z_][a-zA-Z0-9_.]*$"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(WHITE))


def sanitize(text: Column) -> Column:
    """A text without risky SQL fragments and with quotes doubled; null becomes empty.

    Most texts hold no fragment. A search for plain words finds that out, and no pattern is tried on them.
    """
    def doubled(c: Column) -> Column:
        return F.replace(c, F.lit("'"), F.lit("''"))

    plain = strip(F.coalesce(text, F.lit("")))
    out = plain
    for fragment in RISKY_FRAGMENTS:
        out = F.regexp_replace(out, f"(?id){fragment}", "")  # d: a line ends at a line feed only
    cleared = strip(F.regexp_replace(doubled(out), rf"(?d);[{WHITE}]*$", ""))
    return F.when(contains_any(text, RISKY_WORDS), cleared).otherwise(doubled(plain))


def is_identifier(text: Column) -> Column:
    return F.coalesce(strip(text).rlike(IDENTIFIER), F.lit(False))


def split_list(text: Column) -> Column:
    """The items between commas, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda item: F.trim(item)), lambda item: item != "")


def is_number(text: Column) -> Column:
    """Only digits once dots and dashes are gone."""
    return F.coalesce(F.regexp_replace(text, r"[.\-]", "").rlike(r"^[0-9]+\z"), F.lit(False))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def clean(text: Column) -> Column:
    """Without NUL characters and outer blanks."""
    return F.trim(F.replace(text, F.lit("\u0000"), F.lit("")))


def truncate(text: Column, size: int = 100) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def id_prefix(text: Column, size: int = 8) -> Column:
    return F.concat(F.substring(text, 1, size), F.lit("..."))


def base_name(path: Column) -> Column:
    """Last part of a path up to its first dot."""
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)


def extension(path: Column) -> Column:
    """From the last dot of the last part on; a leading dot starts no extension."""
    return F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1)


def contains_any(text: Column, markers: Sequence[str]) -> Column:
    """Whether any marker occurs, in capitals or not."""
    lowered = F.lower(text)
    return F.coalesce(reduce(lambda a, b: a | b, [lowered.contains(m.lower()) for m in markers]), F.lit(False))


def search_row(columns: Sequence[Column], term: str) -> Column:
    """Whether a term occurs anywhere in the row, in capitals or not."""
    row = F.lower(F.concat_ws(" ", *[c.cast("string") for c in columns]))
    return row.contains(term.lower())
