"""Benchmark passages in documents, found with a suffix automaton of the test items.

The automaton holds every run of words of every item. A document streams through it word by word and the state says
how long a run of some item ends here; at thirteen words, or at a whole shorter item, the run is a hit. Items go in
blocks of a bounded number of words, one automaton a block. With a single block nothing is shuffled. With more, the
documents are measured against one block after another, and only rows with hits are kept of each and added up at the end; so
neither what a task holds nor what the driver holds grows with the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tables import frozen
from tallyloom.session import work_path

# The window, the coverage that makes a document contaminated (one in twenty words), and what is a word.
WINDOW = 13
COVERAGE = 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of benchmark items in one automaton; about 300 bytes a word in a worker.
BLOCK_WORDS = 200_000

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Limits:
    """A document is contaminated if a hit covers at least one in ``coverage`` of its words."""
    window: int = WINDOW
    coverage: int = COVERAGE
    block_words: int = BLOCK_WORDS


def words_in(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


class Automaton:
    """Generalised suffix automaton over words, with the items that end in each state."""

    def __init__(self, items: tuple[tuple[str, tuple[bytes, ...]], ...], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.longest = [0]
        self.word: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        runs = [[self.word.setdefault(w, len(self.word)) for w in words] for _, words in items]
        for run in runs:
            last = 0
            for c in run:
                last = self._extend(last, c)
        self.owner: list[int] = []
        self.hits: list[tuple[int, ...]] = []
        self._mark(runs)

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return known if self.longest[known] == self.longest[last] + 1 else self._clone(last, c, known)
        made = self._state({}, self.longest[last] + 1, 0)
        at = last
        while at != -1 and c not in self.next[at]:
            self.next[at][c] = made
            at = self.link[at]
        if at != -1:
            known = self.next[at][c]
            self.link[made] = known if self.longest[known] == self.longest[at] + 1 else self._clone(at, c, known)
        return made

    def _state(self, moves: dict[int, int], longest: int, link: int) -> int:
        self.next.append(moves)
        self.longest.append(longest)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, at: int, c: int, known: int) -> int:
        copy = self._state(dict(self.next[known]), self.longest[at] + 1, self.link[known])
        self.link[known] = copy
        while at != -1 and self.next[at].get(c) == known:
            self.next[at][c] = copy
            at = self.link[at]
        return copy

    def _mark(self, runs: list[list[int]]) -> None:
        """``owner``: the state of the last ``window`` words of a state. ``hits``: items of such a state, as numbers;
        ``shorts``: (length, item) of whole short items that end a state's words."""
        within: list[set[int]] = [set() for _ in self.next]
        ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for item, run in enumerate(runs):
            at = 0
            for c in run:
                at = self.next[at][c]
                up = at
                while up > 0 and item not in within[up] and self.longest[up] >= self.window:
                    within[up].add(item)
                    up = self.link[up]
            if 0 < len(run) < self.window:
                while self.longest[self.link[at]] >= len(run):
                    at = self.link[at]
                ends[at].append((len(run), item))
        order = sorted(range(1, len(self.next)), key=self.longest.__getitem__)
        self.owner = [0] * len(self.next)
        self.shorts: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for state in order:
            up = self.link[state]
            self.shorts[state] = self.shorts[up] + tuple(ends[state])
            if self.longest[state] >= self.window:
                self.owner[state] = self.owner[up] if self.longest[up] >= self.window else state
        self.hits = [tuple(x) for x in within]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges [start, end) that are hit, one for each window that occurs, and the names of their items."""
        moves, link, longest, window = self.next, self.link, self.longest, self.window
        shorts, spans, found = self.shorts, [], set()
        get = self.word.get
        state = run = 0
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                state = run = 0
                continue
            to = moves[state].get(c)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = moves[state].get(c)
                run = longest[state]
            if to is None:
                state = run = 0
                continue
            state = to
            run += 1
            if run >= window:
                spans.append((i + 1 - window, i + 1))
                found.update(self.hits[self.owner[state]])
            if shorts[state]:
                for size, item in shorts[state]:
                    if size <= run:
                        spans.append((i + 1 - size, i + 1))
                        found.add(item)
        return spans, {self.names[k] for k in found}


@lru_cache(maxsize=1)
def _automaton(items: tuple[tuple[str, tuple[bytes, ...]], ...], window: int) -> Automaton:
    return Automaton(items, window)


def item_blocks(benchmark: DataFrame, limits: Limits, item_id: str = "item_id",
                text: str = "text") -> Iterator[tuple[tuple[str, tuple[bytes, ...]], ...]]:
    """The items in blocks of at most ``block_words`` words (a longer item is a block of its own), read one at a time.
    Items without words can hit nothing and are left out; a null id is called null."""
    block: list[tuple[str, tuple[bytes, ...]]] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), F.col(text))
    for name, body in rows.toLocalIterator():
        words = tuple(words_in(body))
        if not words:
            continue
        if block and size + len(words) > limits.block_words:
            yield tuple(block)
            block, size = [], 0
        block.append((name, words))
        size += len(words)
    if block:
        yield tuple(block)


HITS = "struct<n_words: bigint, n_hit: bigint, hit: binary, items: array<string>>"


def _scanner(items: tuple[tuple[str, tuple[bytes, ...]], ...], window: int):
    @F.pandas_udf(HITS)
    def scan(texts: pd.Series) -> pd.DataFrame:
        machine = _automaton(items, window)
        out = []
        for text in texts:
            words = words_in(text)
            spans, found = machine.scan(words)
            n_hit, hit = 0, b""
            if spans:
                mask = np.zeros(len(words) + 1, dtype=np.int64)
                at = np.array(spans)
                np.add.at(mask, at[:, 0], 1)
                np.add.at(mask, at[:, 1], -1)
                mask = np.cumsum(mask[:-1]) > 0
                n_hit, hit = int(mask.sum()), np.packbits(mask).tobytes()
            out.append((len(words), n_hit, hit, sorted(found)))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "hit", "items"])
    return scan


def _either(masks: Column) -> Column:
    """The bits that are set in any of the masks, which are equally long."""
    @F.pandas_udf("binary")
    def of(groups: pd.Series) -> pd.Series:
        return pd.Series([np.bitwise_or.reduce([np.frombuffer(m, dtype=np.uint8) for m in g]).tobytes() for g in groups], dtype="object")
    return of(masks)


def _added_up(docs: DataFrame, blocks: Iterator[tuple[tuple[str, tuple[bytes, ...]], ...]], limits: Limits, text: str) -> DataFrame:
    """What ``hits`` gives, block after block. What a block finds is written before the next one is read."""
    @F.pandas_udf("bigint")
    def n_words(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words_in(t)) for t in texts], dtype="int64")

    @F.pandas_udf("bigint")
    def n_set(masks: pd.Series) -> pd.Series:
        return pd.Series([int(np.unpackbits(np.frombuffer(m, dtype=np.uint8)).sum()) for m in masks], dtype="int64")

    whole = frozen(docs.select(F.struct("*").alias("doc"), n_words(F.col(text)).alias("n_words"),
                               F.monotonically_increasing_id().alias("row_id")), "documents")
    path = work_path(docs.sparkSession, "hits")
    for items in blocks:
        found = whole.select("row_id", _scanner(items, limits.window)(F.col("doc")[text]).alias("m")).filter("m.n_hit > 0")
        found.select("row_id", "m.hit", "m.items").write.mode("append").parquet(path)
    found = docs.sparkSession.read.schema("row_id long, hit binary, items array<string>").parquet(path)
    each = found.groupBy(F.col("row_id").alias("r")).agg(
        F.collect_list("hit").alias("masks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    each = each.select("r", "items", _either(F.col("masks")).alias("hit"))
    each = each.select("r", "items", "hit", n_set("hit").alias("n_hit"))
    none = {"n_hit": F.lit(0).cast("long"), "hit": F.lit(b""), "items": F.array().cast("array<string>")}
    return whole.join(each, F.col("row_id") == F.col("r"), "left").select(
        "doc", "n_words", *[F.coalesce(name, value).alias(name) for name, value in none.items()])


def hits(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """``docs`` as a struct ``doc`` with ``n_words``, ``n_hit``, ``hit`` (a bit for each word; empty if none) and the names of
    ``items`` found. Null text has no words; an empty benchmark hits nothing."""
    blocks = item_blocks(benchmark, limits)
    first, second = next(blocks, ()), next(blocks, None)
    if second is not None:
        return _added_up(docs, chain([first, second], blocks), limits, text)
    rows = docs.select(F.struct("*").alias("doc"), _scanner(first, limits.window)(F.col(text)).alias("m"))
    return rows.select("doc", *[F.col(f"m.{n}").alias(n) for n in ("n_words", "n_hit", "hit", "items")])


def measured(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """``docs`` as a struct ``doc`` with ``n_words, n_hit, items`` and ``contaminated``."""
    return hits(docs, benchmark, limits, text).withColumn("contaminated", (F.col("n_hit") > 0) & (limits.coverage * F.col("n_hit") >= F.col("n_words")))


def cut_spans(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """``docs`` in which contaminated documents lose the hit words, with what stands between them; one line end is
    left in the place of a span. Other documents stay as they are."""
    found = measured(docs, benchmark, limits, text)
    fields = [_without(F.col("doc")[text], F.col("hit"), F.col("contaminated")).alias(c) if c == text
              else F.col("doc")[c].alias(c) for c in docs.columns]
    return found.select(*fields)


def _without(text: Column, hit: Column, cut: Column) -> Column:
    @F.pandas_udf("string")
    def of(texts: pd.Series, masks: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, m) if c else t for t, m, c in zip(texts, masks, cuts, strict=True)], dtype="object")
    return of(text, hit, cut)


def _cut(text: str, mask: bytes) -> str:
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    at = [m.span() for m in re.finditer(WORD, lowered)]
    gone = np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=len(at)).astype(bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    out, last = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out += [text[last:at[a][0]], "\n"]
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def keep_clean(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns and unchanged."""
    return measured(docs, benchmark, limits, text).filter(~F.col("contaminated")).select("doc.*")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS name, regexp_extract_all({_LOW}, '{WORD}') AS w FROM benchmark),
g AS (SELECT DISTINCT name, size, list_aggregate(w[k:k + size - 1], 'string_agg', ' ') AS gram
      FROM (SELECT name, w, least({WINDOW}, len(w)) AS size, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS k
            FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT size FROM g),
p AS (SELECT r, size, k, list_aggregate(w[k:k + size - 1], 'string_agg', ' ') AS gram
      FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, s)),
h AS (SELECT r, k, size, name FROM p JOIN g USING (size, gram)),
n AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS w FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
      FROM (SELECT DISTINCT r, name FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {COVERAGE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
