"""Packing of token sequences by a non-negative least-squares plan over the length histogram.

A document is cut into whole windows and a rest. Rests are counted by length; that histogram, at most one bin a
length, is all the driver sees. Over it the driver enumerates combinations of two and three lengths that fill a window
exactly, solves for how often each is to be repeated, rounds down, and lays what is left end to end, cutting a rest where
a window ends and the last window into powers of two, so that nothing is padded. Each rest then finds its sequence from its
length and its running number among the rests of that length, in parallel.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.tables import frozen

WINDOW = 1024
# Fixed value: the token that ends a document.
END = 0
# Fixed value: the signs that the pattern of the tokenizer takes for white space, as a class.
WHITE = "[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Runs of white space from this length on are cut out of a text by hand: the pattern goes back over them one sign at a time, and
#: the library's stack ends at some hundred thousand.
LONG_RUN = 10_000
#: Word spellings a worker remembers.
REMEMBERED = 500_000
ROUNDS = 400


@dataclass(frozen=True)
class Packer:
    """``tokenizer`` names a file of ranks that ``public_tokenizers.path`` knows, or is a path. ``added`` is the same for the
    file that declares the added tokens, or empty. ``window`` is a power of two. A token id needs 16 bits."""
    tokenizer: str = "byte_bpe_50k.tiktoken"
    window: int = WINDOW
    added: str = "byte_bpe_50k.json"


def _place(name: str) -> str:
    return name if os.path.sep in name else public_tokenizers.path(name)


def added_tokens(name: str) -> dict[str, int]:
    """Literals that are one token wherever they stand, and their ids."""
    with open(_place(name), encoding="utf-8") as file:
        declared = json.load(file)["added_tokens"]
    assert not any(t[x] for t in declared for x in ("single_word", "lstrip", "rstrip", "normalized"))
    return {t["content"]: t["id"] for t in declared}


class Speller:
    """Texts to token ids. Texts are cut at added tokens, if a file of these is given. Words with the space before them are
    looked up; only new ones are taken apart."""

    def __init__(self, tokenizer: str, added: str = ""):
        with open(_place(tokenizer), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.added = added_tokens(added) if added else {}
        assert max([*ranks.values(), *self.added.values()]) < 1 << 16
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        self.coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        # Where a run of white space goes on past a blank, its tokens depend on what stands on both sides.
        self.crossing = re.compile(r"\s \s|\s $")
        self.long_run = re.compile(f"{WHITE}{{{LONG_RUN},}}")
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), dtype="<u2").tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of the text and then the end token, as 16-bit numbers."""
        out = []
        for k, part in enumerate(self.cut.split(text or "") if self.cut else [text or ""]):
            out += [np.array([self.added[part]], dtype="<u2").tobytes()] if k % 2 else self._plain(part)
        out.append(np.array([END], dtype="<u2").tobytes())
        return np.frombuffer(b"".join(out), dtype="<u2")

    def _plain(self, text: str) -> list[bytes]:
        """The ids of a text without added tokens. The pattern makes a long run of white space one piece, but for its last sign if
        something follows, and a piece before such a run ends where it begins."""
        out, at = [], 0
        for run in self.long_run.finditer(text) if len(text) >= LONG_RUN else ():
            stop = run.end() - (run.end() < len(text))
            out += self._short(text[at:run.start()])
            out.append(np.array(self.coder._core_bpe.encode_single_piece(text[run.start():stop].encode()), dtype="<u2").tobytes())
            at = stop
        return out + self._short(text[at:])

    def _short(self, text: str) -> list[bytes]:
        out = []
        if self.crossing.search(text):
            out.append(self._ids(text))
        else:
            known = self.known
            if len(known) > REMEMBERED:
                known.clear()
            first = True
            for part in text.split(" "):
                key = part if first else " " + part
                first = False
                got = known.get(key)
                if got is None:
                    got = self._ids(key)
                    if len(key) < 64:
                        known[key] = got
                out.append(got)
        return out


@lru_cache(maxsize=2)
def _speller(tokenizer: str, added: str) -> Speller:
    return Speller(tokenizer, added)


def crc(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def spelled(docs: DataFrame, packer: Packer, text: str = "text") -> DataFrame:
    """``docs`` with ``t``: the number of tokens, the checksums of whole windows and of the rest, and the ids of the rest."""
    @F.pandas_udf("struct<n: bigint, crcs: array<bigint>, rest_crc: bigint, rest: binary>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                ids = _speller(packer.tokenizer, packer.added).ids(text)
                whole = len(ids) // packer.window
                rest = ids[whole * packer.window:]
                out.append((len(ids), [crc(x) for x in ids[:whole * packer.window].reshape(whole, packer.window)], crc(rest),
                            rest.tobytes()))
            yield pd.DataFrame(out, columns=["n", "crcs", "rest_crc", "rest"])
    return docs.withColumn("t", of(F.col(text)))


@dataclass(frozen=True)
class Plan:
    """Where rests go. Per length: edges of ranges of running numbers, and for each range the first sequence, how many
    pieces of the length a sequence takes, and their offset. Numbers beyond the last edge lie in the stream of the rest."""
    window: int
    ranges: dict[int, np.ndarray]
    stream_from: dict[int, tuple[int, int]]
    stream_total: int
    first_stream: int
    sequences: int

    def place(self, length: int, number: int) -> list[tuple[int, int, int, int]]:
        """(start within the rest, length, sequence, offset) of each piece of a rest."""
        rows = self.ranges.get(length)
        if rows is not None and number < rows[-1][1]:
            low, _, first, times, offset = (int(x) for x in rows[np.searchsorted(rows[:, 1], number, side="right")])
            turn, which = divmod(number - low, times)
            return [(0, length, first + turn, offset + which * length)]
        base, skipped = self.stream_from[length]
        return list(self._laid(base + (number - skipped) * length, length))

    def _laid(self, at: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """Cut [at, at + length) of the stream at window ends, and inside the last window at powers of two."""
        whole, tail = divmod(self.stream_total, self.window)
        start = 0
        while start < length:
            sequence, offset = divmod(at + start, self.window)
            size, base = self.window, 0
            if sequence == whole:
                left = tail
                while True:
                    size = 1 << (left.bit_length() - 1)
                    if offset < base + size:
                        break
                    base, left, sequence = base + size, left - size, sequence + 1
            take = min(length - start, base + size - offset)
            yield start, take, self.first_stream + sequence, offset - base
            start += take


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths, descending and 0 for none, that add up to the window."""
    held = np.zeros(window + 1, dtype=bool)
    held[lengths] = True
    pairs = [(b, a, 0) for a in lengths for b in [window - a] if b >= a and held[b]]
    small = lengths[lengths <= window // 3]
    triples = []
    for a in small:
        b = lengths[(lengths >= a) & (window - a - lengths >= lengths)]
        b = b[held[window - a - b]]
        triples.append(np.stack([window - a - b, b, np.full(len(b), a)], axis=1))
    found = [np.array(pairs, dtype=np.int64).reshape(-1, 3), *triples]
    return np.concatenate(found)


def solved(combos: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the sum of x times the combinations near the histogram in least squares, by
    accelerated projected gradient steps."""
    flat = combos.T
    x = y = np.zeros(len(combos))
    target = histogram.astype(float)
    uses = np.bincount(flat.ravel(), minlength=len(histogram)).astype(float)
    step = 1.0 / max(9.0, 3.0 * uses[1:].max(initial=1.0))
    t = 1.0
    for _ in range(rounds):
        made = sum(np.bincount(row, weights=y, minlength=len(histogram)) for row in flat)
        miss = made - target
        miss[0] = 0.0
        new = np.maximum(y - step * sum(miss[row] for row in flat), 0.0)
        faster = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / faster * (new - x), new, faster
    return x


def planned(counts: dict[int, int], window: int) -> Plan:
    """A plan for so many rests of each length below the window."""
    left = np.zeros(window + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros_like(left)
    lengths = np.flatnonzero(left)
    combos = combinations(lengths, window) if len(lengths) else np.zeros((0, 3), dtype=np.int64)
    weights = solved(combos, left) if len(combos) else np.zeros(0)
    ranges: dict[int, list[tuple[int, int, int, int, int]]] = {}
    sequence = 0
    # Rounded down first; a second turn in the same order gives a combination whatever its lengths still allow.
    for wanted in (np.floor(weights).astype(np.int64), np.full(len(combos), np.iinfo(np.int64).max)):
        for k in np.lexsort((np.arange(len(combos)), -weights)):
            parts = [int(p) for p in combos[k] if p]
            times = {p: parts.count(p) for p in parts}
            repeats = min([int(wanted[k]), *(int(left[p]) // m for p, m in times.items())])
            if repeats <= 0:
                continue
            offset = 0
            for p, m in times.items():
                ranges.setdefault(p, []).append((int(used[p]), int(used[p]) + repeats * m, sequence, m, offset))
                used[p] += repeats * m
                left[p] -= repeats * m
                offset += p * m
            sequence += repeats
    stream, total = {}, 0
    for p in sorted((int(p) for p in np.flatnonzero(left)), reverse=True):
        stream[p] = (total, int(used[p]))
        total += p * int(left[p])
    whole, tail = divmod(total, window)
    return Plan(window, {p: np.array(rows, dtype=np.int64) for p, rows in ranges.items()}, stream, total, sequence,
                sequence + whole + bin(tail).count("1"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``row_id`` (partition number in the high bits, as Spark gives it), ``whole`` and ``rest_length``: adds
    ``number``, unique from 0 among rests of a length, and ``first``, the number of whole windows of rows before.

    A partition counts its own rows; only counts per partition and length are added up across partitions, so no length
    however frequent meets in one task.
    """
    part = F.shiftright("row_id", 33).alias("part")
    rows = rows.withColumn("part", part)
    counts = rows.groupBy("part", "rest_length").agg(F.count("*").alias("n"))
    wholes = rows.groupBy("part").agg(F.sum("whole").alias("n")).select("part", F.lit(-1).cast("long").alias("rest_length"), "n")
    before = F.sum("n").over(Window.partitionBy("rest_length").orderBy("part")) - F.col("n")
    offsets = frozen(counts.unionByName(wholes).select("part", "rest_length", before.alias("before")), "offsets")
    own = Window.partitionBy("part", "rest_length").orderBy("row_id")
    running = Window.partitionBy("part").orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("first", F.sum("whole").over(running) - F.col("whole")).withColumn(
        "number", (F.row_number().over(own) - 1).cast("long"))
    each = offsets.filter("rest_length >= 0").select(F.col("part").alias("p"), F.col("rest_length").alias("r"), "before")
    whole = offsets.filter("rest_length < 0").select(F.col("part").alias("q"), F.col("before").alias("windows"))
    rows = rows.join(each, (F.col("part") == F.col("p")) & (F.col("rest_length") == F.col("r")))
    rows = rows.join(whole, F.col("part") == F.col("q"))
    return rows.withColumn("number", F.col("number") + F.col("before")).withColumn(
        "first", F.col("first") + F.col("windows")).drop("part", "p", "r", "q", "before", "windows")


def pack(docs: DataFrame, packer: Packer = Packer(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null and empty texts are the end token alone. Repeated rows are packed as often as they come. No document, no row.
    """
    rows = spelled(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                               F.monotonically_increasing_id().alias("row_id")), packer)
    tokens = frozen(rows.select("row_id", "doc_id", "t.*"), "tokens")
    lengths = tokens.select("row_id", (F.col("n") % packer.window).alias("rest_length"),
                            F.floor(F.col("n") / packer.window).alias("whole"))
    histogram = lengths.filter("rest_length > 0").groupBy("rest_length").count().collect()  # at most a row per length
    plan = planned({r["rest_length"]: r["count"] for r in histogram}, packer.window)

    @F.pandas_udf("array<struct<start: bigint, length: bigint, sequence_id: bigint, offset: bigint>>")
    def placed(rest: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "length": n, "sequence_id": s, "offset": o} for a, n, s, o in plan.place(r, k)]
                          if r else [] for r, k in zip(rest.tolist(), number.tolist(), strict=True)], dtype="object")

    found = frozen(numbered(lengths).select(
        F.col("row_id").alias("at_row"), "first", placed("rest_length", "number").alias("places")), "places")
    laid = tokens.select("row_id", "doc_id", "n", "crcs", "rest_crc").join(found, F.col("row_id") == F.col("at_row"))
    windows = laid.select("doc_id", "n", "first", F.posexplode("crcs").alias("k", "ids_crc32")).select(
        "doc_id", (F.col("k") * F.lit(packer.window).cast("long")).alias("start"), F.lit(packer.window).cast("long").alias("length"),
        "ids_crc32", F.col("n").alias("doc_tokens"), (F.col("first") + F.col("k") + plan.sequences).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    base = F.floor(F.col("n") / packer.window) * packer.window
    uncut = laid.filter(F.size("places") == 1).select("doc_id", "n", "rest_crc", F.col("places")[0].alias("p")).select(
        "doc_id", (base + F.col("p.start")).alias("start"), "p.length", F.col("rest_crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), "p.sequence_id", "p.offset")
    return windows.unionByName(uncut).unionByName(_cut_pieces(tokens, found, base))


def _cut_pieces(tokens: DataFrame, found: DataFrame, base: Column) -> DataFrame:
    """Pieces of the rests that a window end cuts; only their ids are read again."""
    @F.pandas_udf("long")
    def crc_of(rest: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([crc(np.frombuffer(r, dtype="<u2")[a:a + n]) for r, a, n in zip(rest, start, length, strict=True)],
                         dtype="int64")

    cut = frozen(found.filter(F.size("places") > 1).select(F.col("at_row").alias("cut_row"), "places"), "cuts")
    rows = tokens.join(cut, F.col("row_id") == F.col("cut_row")).select("doc_id", "n", "rest", F.explode("places").alias("p"))
    return rows.select("doc_id", (base + F.col("p.start")).alias("start"), "p.length",
                       crc_of("rest", "p.start", "p.length").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
                       "p.sequence_id", "p.offset")
