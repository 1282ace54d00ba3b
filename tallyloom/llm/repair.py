"""Conversation structure repair: a generalised LR parse that may delete, rerole and insert turns.

The grammar of roles gives the states of an LR automaton. A conversation is parsed turn by turn on a graph-structured stack:
nodes of equal state and equal rest are one object, and every edit of a turn is tried on every live top. Tops of equal state
are merged and the least (cost, audit) stays. Spark lays each conversation's turns in order and finds repeated ones; a task
then reads them as a stream. What all live tops agree on is settled at once, so a task mostly holds a few turns, however long
the conversation is; where two readings stay open for long (no turn has a known role), it holds the turns since they parted.
One conversation is read by one task, since its digest must take the turns in order.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from itertools import takewhile
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# The grammar of role initials, (s?(ua)+)?, and the price of each edit.
GRAMMAR = (("C", ""), ("C", "P"), ("P", "sE"), ("P", "E"), ("P", "PE"), ("E", "ua"))
ROLE_OF = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3
SPACE = " \t\n\x0b\x0c\r"
#: Any top can go on as any other by one insert and one delete, so one that is dearer by more never wins.
SLACK = INSERT + DELETE

Item = tuple[int, int]


def _remembered(function: Callable) -> Callable:
    """What was found once is looked up from then on. A plain function, so that it travels to the tasks with its code."""
    known: dict = {}

    def call(*key):
        if key not in known:
            known[key] = function(*key)
        return known[key]

    return call


def _closed(items: frozenset[Item]) -> frozenset[Item]:
    found, todo = set(items), list(items)
    while todo:
        rule, dot = todo.pop()
        after = GRAMMAR[rule][1][dot:dot + 1]
        for k, (head, _) in enumerate(GRAMMAR):
            if head == after and (k, 0) not in found:
                found.add((k, 0))
                todo.append((k, 0))
    return frozenset(found)


@_remembered
def _moved(state: frozenset[Item], symbol: str) -> frozenset[Item] | None:
    kernel = frozenset((r, d + 1) for r, d in state if GRAMMAR[r][1][d:d + 1] == symbol)
    return _closed(kernel) if kernel else None


class Node(NamedTuple):
    """A stack from its top: the automaton's state and the node below."""
    state: frozenset[Item]
    below: Node | None


@_remembered
def _node(state: frozenset[Item], below: Node | None) -> Node:
    return Node(state, below)


BOTTOM = _node(_closed(frozenset((k, 0) for k, (head, _) in enumerate(GRAMMAR) if head == "C")), None)


@_remembered
def after(top: Node, symbol: str) -> Node | None:
    """The stack after a symbol and all reductions that follow, or None where the grammar does not allow the symbol."""
    state = _moved(top.state, symbol)
    if state is None:
        return None
    top = _node(state, top)
    while True:
        done = [GRAMMAR[r] for r, d in top.state if d == len(GRAMMAR[r][1]) and GRAMMAR[r][0] != "C"]
        if not done:
            return top
        head, body = done[0]
        for _ in body:
            top = top.below
        top = _node(_moved(top.state, head), top)


@_remembered
def complete(top: Node) -> bool:
    return any(GRAMMAR[r][0] == "C" and d == len(GRAMMAR[r][1]) for r, d in top.state)


@_remembered
def _inserted(top: Node) -> str:
    """The only turn that can be inserted here."""
    return next(s for s in ROLE_OF if after(top, s) is not None)


class Parse:
    """One conversation. ``add`` takes its turns in order, ``settled`` gives (edit, role, text, given role) as they become sure."""

    def __init__(self) -> None:
        self.live = self._with_inserts({BOTTOM.state: (0, "", BOTTOM)})
        self.cost, self.at = 0, BOTTOM
        self.waiting: deque[tuple[str, str]] = deque()

    @staticmethod
    def _offer(tops: dict, cost: int, audit: str, top: Node | None) -> bool:
        if top is None or (top.state in tops and tops[top.state][:2] <= (cost, audit)):
            return False
        tops[top.state] = (cost, audit, top)
        return True

    def _with_inserts(self, tops: dict) -> dict:
        todo = list(tops.values())
        while todo:
            cost, audit, top = todo.pop()
            for symbol in ROLE_OF:
                if self._offer(tops, cost + INSERT, audit + "I", after(top, symbol)):
                    todo.append(tops[after(top, symbol).state])
        least = min(cost for cost, _, _ in tops.values())
        return {k: v for k, v in tops.items() if v[0] <= least + SLACK}

    def add(self, role: str, text: str, must_go: bool, cut_off: bool) -> Iterator[tuple[str, str, str]]:
        tops: dict = {}
        extra = CUT_OFF if cut_off else 0
        for cost, audit, top in self.live.values():
            self._offer(tops, cost + DELETE, audit + "D", top)
            if not must_go:
                if role[:1]:
                    self._offer(tops, cost + extra, audit + "K", after(top, role[:1]) if role[0] in "sua" else None)
                for symbol in ROLE_OF:
                    self._offer(tops, cost + extra + REROLE, audit + "R", after(top, symbol))
        self.live = self._with_inserts(tops)
        self.waiting.append((role, text))
        audits = [audit for _, audit, _ in self.live.values()]
        return self._settled(sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(min(audits), max(audits)))))

    def end(self) -> Iterator[tuple[str, str, str]]:
        self.cost, audit, top = min(v for v in ((c, a, t) for c, a, t in self.live.values()) if complete(v[2]))
        self.live = {top.state: (self.cost, audit, top)}
        return self._settled(len(audit))

    def _settled(self, size: int) -> Iterator[tuple[str, str, str]]:
        """The first edits of all live audits, taken off them."""
        if not size:
            return
        edits = next(iter(self.live.values()))[1][:size]
        self.live = {k: (cost, audit[size:], top) for k, (cost, audit, top) in self.live.items()}
        for edit in edits:
            role, text = ("", "") if edit == "I" else self.waiting.popleft()
            if edit != "D":
                symbol = role[:1] if edit == "K" else _inserted(self.at)
                role = role if edit == "K" else ROLE_OF[symbol]
                self.at = after(self.at, symbol)
            yield edit, role, text


def in_order(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """``conv_id, turn, role, text, position, repeated``: the turns of each conversation one after another in one partition.

    Turns go by ``order``, null first, equal ones by role and text; null roles and texts are one space. ``repeated`` says whether
    an earlier turn has the same role and text. One shuffle serves both windows and the parse, and every sort spills.
    """
    named = turns.select(F.col(conv).alias("conv_id"), F.col(order).cast("long").alias("turn"),
                         *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    line = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("conv_id", "said").orderBy("position")
    return named.repartition("conv_id").withColumn("position", F.row_number().over(line)).withColumn("said", said).withColumn(
        "repeated", F.row_number().over(same) > 1).drop("said").sortWithinPartitions("conv_id", "position")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)))


def _rows(made: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in made:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def fault(text: str, repeated: bool) -> str | None:
    """The first fault of a turn: blank, duplicate or truncated."""
    said = text.rstrip(SPACE)
    if not said:
        return "blank"
    return "duplicate" if repeated else None if said[-1] in ".!?" else "truncated"


def _parsed(turns: Iterator[tuple]) -> Iterator[tuple]:
    """(conversation, event, values) of every conversation: ``turn`` for a turn read, ``edit`` for an edit settled, ``end``."""
    conv = parse = None
    for conv_id, turn, role, text, position, repeated in turns:
        if position == 1:
            if parse is not None:
                yield from ((conv, "edit", e) for e in parse.end())
                yield conv, "end", parse.cost
            conv, parse = conv_id, Parse()
        wrong = fault(text, repeated)
        yield conv, "turn", (turn, role, wrong)
        yield from ((conv, "edit", e) for e in parse.add(role, text, wrong in ("blank", "duplicate"), wrong == "truncated"))
    if parse is not None:
        yield from ((conv, "edit", e) for e in parse.end())
        yield conv, "end", parse.cost


def _repaired(turns: Iterator[tuple]) -> Iterator[tuple]:
    at = 0
    for conv, event, value in _parsed(turns):
        if event == "end":
            at = 0
        elif event == "edit":
            at += 1
            yield conv, at, *value


class Account:
    """Counts and digests of one conversation."""

    def __init__(self) -> None:
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = self.before = None
        self.distinct = self.illegal = self.kept = 0
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def turn(self, turn: int | None, role: str, wrong: str | None) -> None:
        if wrong:
            self.faults[wrong] += 1
        if turn is not None and turn != self.last:
            self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
        if self.before is not None and self.before + role[:1] not in LEGAL_PAIRS:
            self.illegal += 1
        self.before = role[:1]

    def edit(self, edit: str, role: str, text: str) -> None:
        self.audit.append(edit)
        if edit != "D":
            self.digest.update((("\n" if self.kept else "") + f"{role}:{text}").encode())
            self.kept += 1

    def row(self, cost: int) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (min(gaps, 2 ** 63 - 1), *self.faults.values(), self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


def _accounts(turns: Iterator[tuple]) -> Iterator[tuple]:
    account = Account()
    for conv, event, value in _parsed(turns):
        if event == "turn":
            account.turn(*value)
        elif event == "edit":
            account.edit(*value)
        else:
            yield conv, *account.row(value)
            account = Account()


def _streamed(turns: DataFrame, conv: str, order: str, rows: Callable, columns: str) -> DataFrame:
    ordered = in_order(turns, conv, order)
    schema = f"conv_id {ordered.schema['conv_id'].dataType.simpleString()}, {columns}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return ordered.mapInArrow(lambda batches: _rows(rows(_turns(batches)), arrow), schema)


def repaired(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """``conv_id, at, edit, role, text``: the cheapest edits of every conversation in order, deleted turns (``D``) included.

    Null conversations are one conversation. Equal turns go by role and text; a repeated row is a duplicate of the first and
    must go. Blank turns must go. A role that starts with none of s, u and a can only be reroled or deleted. An empty table
    gives no row. Other columns are not read.
    """
    return _streamed(turns, conv, order, _repaired, "at long, edit string, role string, text string")


def accounts(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row a conversation: ``gaps`` in the turn numbers, turns by first fault, ``illegal`` pairs of neighbours, the ``cost`` and
    ``audit`` of the cheapest edits, and the SHA-256 of the repaired conversation as ``role:text`` lines.

    Odd rows as in ``repaired``. Null turn numbers leave no gap; a gap beyond a long is the largest long.
    """
    return _streamed(turns, conv, order, _accounts, "gaps long, blank long, duplicate long, truncated long, illegal long, "
                                                    "cost long, audit string, repaired_sha256 string")
