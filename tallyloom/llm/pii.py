"""Personal data: anchors found by one automaton, boundaries by local parsers.

An Aho-Corasick automaton runs over a text once and reports anchors: at-signs, plus signs, digits, ``://`` and cue words
such as IBAN or account. At each anchor a parser of that kind reads the few characters around it and
validates what it has read (number ranges, digit counts, Luhn, mod 97). Matches of a kind never overlap. Nothing is
shuffled; a task holds one batch of texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in the order that counts for equal starts, and what they look like around an anchor.
BASE = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Kinds beyond the base, told by a cue, and the cues (any letter case) with what may stand after them.
MORE = ("userinfo", "iban", "account", "ssn")
USERINFO = re.compile(r"[^\s/?#@:]++(:[^\s/?#@]*+)?@(?=[A-Za-z0-9\[])")
IBAN = re.compile(r"[^0-9A-Za-z\n]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
ACCOUNT = re.compile(r"(?:\x20?(?i:number|no\.?|nr\.?|#))?[\x20:=#]{1,3}([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])")
SSN = re.compile(r"[^0-9A-Za-z\n]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
CUES = {"iban": "iban", "account": "account", "acct": "account", "konto": "account", "ssn": "ssn",
        "social security number": "ssn"}
KINDS = BASE + MORE
#: How long an IBAN is in its country.
IBAN_SIZES = {country: size for size, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}

Span = tuple[int, int, int]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def iban_holds(text: str) -> bool:
    compact = text.replace(" ", "")
    turned = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int | None:
    """Where the number that starts here ends: at its country's size, or else at the last end of a group, up to ``end``, whose
    check digits hold. Words and amounts that follow are no part of it."""
    size, ends = 0, []
    for p in range(start, end):
        size += text[p] != " "
        after = text[p + 1:p + 2]
        if size >= 15 and text[p] != " " and not (after.isascii() and after.isalnum()):
            ends.append((size != IBAN_SIZES.get(text[start:start + 2]), -size, p + 1))
    return next((p for *_, p in sorted(ends) if iban_holds(text[start:p])), None)


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for key, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"), *[(str(d), "digit") for d in range(10)]]:
        made.add_word(key, (kind, len(key)))
    for cue, kind in CUES.items():
        made.add_word(cue, (kind, len(cue)))
    made.make_automaton()
    return made


@dataclass
class _Reader:
    """One pass over a text. ``past`` holds per kind where the last match of it ended, kept or not."""
    text: str
    past: dict[str, int] = field(default_factory=lambda: dict.fromkeys(KINDS, 0))
    spans: list[Span] = field(default_factory=list)

    def _take(self, kind: str, start: int, end: int, good: bool) -> None:
        self.past[kind] = end
        if good:
            self.spans.append((start, KINDS.index(kind), end))

    def at(self, p: int, end: int) -> None:
        text, start, floor = self.text, p, self.past["email"]
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if p >= floor and start < p and (m := DOMAIN.match(text, p + 1)):
            self._take("email", start, m.end(), True)

    def digit(self, p: int, end: int) -> None:
        text = self.text
        first = p == 0 or not "0" <= text[p - 1] <= "9"
        if (first or p == self.past["ip"]) and p >= self.past["ip"] and (m := ADDRESS.match(text, p)):
            self._take("ip", p, m.end(), all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")))
        if (first or p == self.past["card"]) and p >= self.past["card"] and (m := CARD.match(text, p)):
            digits = _digits(m[0])
            self._take("card", p, m.end(), 14 <= len(digits) <= 19 and luhn(digits))

    def plus(self, p: int, end: int) -> None:
        if p >= self.past["phone"] and (m := PHONE.match(self.text, p)):
            self._take("phone", p, m.end(), 10 <= len(_digits(m[0])) <= 15)

    def scheme(self, p: int, end: int) -> None:
        if end >= self.past["userinfo"] and (m := USERINFO.match(self.text, end)):
            self._take("userinfo", end, m.end() - 1, True)

    def iban(self, p: int, end: int) -> None:
        if end >= self.past["iban"] and (m := IBAN.match(self.text, end)) and (last := iban_end(self.text, m.start(1), m.end(1))):
            self._take("iban", m.start(1), last, True)

    def account(self, p: int, end: int) -> None:
        self._cued("account", ACCOUNT, end, lambda _: True)

    def ssn(self, p: int, end: int) -> None:
        self._cued("ssn", SSN, end, lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000")

    def _cued(self, kind: str, pattern: re.Pattern[str], end: int, good: Callable[[str], bool]) -> None:
        if end >= self.past[kind] and (m := pattern.match(self.text, end)):
            self._take(kind, m.start(1), m.end(1), good(m[1]))


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of the kinds. Null has none."""
    if not text:
        return []
    reader = _Reader(text)
    lower = text.replace("\u0130", "i").lower()  # as long as the text: no other letter becomes two
    for last, (kind, length) in _anchors().iter(lower):
        getattr(reader, kind)(last + 1 - length, last + 1)
    return [(KINDS[kind], start, end) for start, kind, end in sorted(reader.spans)]


def spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of a text column; empty for null."""
    @F.pandas_udf("array<struct<kind: string, start: int, end: int>>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in texts], dtype="object")
    return of(text)


def masked(text: str | None) -> str | None:
    """The text with every found span, or run of overlapping spans, replaced by its first kind in brackets."""
    found = find(text)
    if not found:
        return text
    out, last, k = [], 0, 0
    while k < len(found):
        kind, start, end = found[k]
        while k + 1 < len(found) and found[k + 1][1] < end:
            k += 1
            end = max(end, found[k][2])
        out += [text[last:start], f"[{kind.upper()}]"]
        last, k = end, k + 1
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with masked texts, and ``length`` (if there is such a column) set anew where a text has changed.

    Null and empty texts stay. Every row stays, repeated ones too.
    """
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([masked(t) for t in texts], dtype="object")

    rows = docs.select(F.struct("*").alias("doc"), of(F.col(text)).alias("masked"))
    changed = F.col("doc")[text] != F.col("masked")
    fields = {c: F.col("doc")[c] for c in docs.columns}
    fields[text] = F.col("masked")
    if length in fields:
        kind = docs.schema[length].dataType
        fields[length] = F.when(changed, F.length("masked").cast(kind)).otherwise(fields[length])
    return rows.select(*[value.alias(name) for name, value in fields.items()])


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
