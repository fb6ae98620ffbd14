"""Conversation structure repair: the cheapest edits after which a conversation's roles alternate.

A conversation is well formed when its roles are an optional system turn and then one or more pairs of user and
assistant, or when it is empty. Turns are kept, given another role, deleted or inserted. The edits of a conversation
are a shortest path over a lattice: a node is a number of turns behind and the role of the last turn written, an arc is
one edit with its cost in whole numbers.

The path is found by **auction**. Every node has a price, never above the cost of an arc plus the price at its other
end. A path starts at an origin; at its last node it is *extended* along the cheapest arc if that arc's cost and price
add up to the node's own price, else the price is raised to that sum and the path is *contracted* by that node. When it
arrives, the prices along it are exact. Origins are taken from the last turn backwards, so each auction arrives at
prices that have converged, and the number of steps grows with the turns alone. Converged prices tell which arcs are
tight; the edits are traced from the start along tight arcs, the least letter first.

Prices of a layer matter only up to a common amount, and so few different layers occur that each is priced once and
remembered. Turns stream through the tasks in order, by batches: what a task holds does not grow with a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Costs of the edits, and what a truncated turn costs more wherever it stays.
COSTS = {"D": 3, "I": 2, "K": 0, "R": 2}
TRUNCATED = 1
BLANKS = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
# The one role that may come next by insertion or a changed role, after each role.
NEXT = (USER, USER, ASSISTANT, USER)
# Where keeping a turn of this initial leads.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
# Kinds of layers: after the last turn, a turn that must go; else initial of the role and a mark of truncation.
END, GOES = "", "x"
STOP = "."


def arcs(kind: str, state: int) -> list[tuple[str, int, int, bool]]:
    """(letter, cost, state it leads to, whether that is in the next layer), letters in order."""
    inserted = ("I", COSTS["I"], NEXT[state], False)
    if kind == END:
        return [(STOP, 0, state, True), inserted] if state in (START, ASSISTANT) else [inserted]
    found = [("D", COSTS["D"], state, True), inserted]
    if kind == GOES:
        return found
    more = TRUNCATED * kind.endswith("t")
    kept = KEPT.get(kind[0], {}).get(state)
    if kept is not None:
        found.append(("K", COSTS["K"] + more, kept, True))
    return [*found, ("R", COSTS["R"] + more, NEXT[state], True)]


@lru_cache(maxsize=1 << 16)
def auction(kind: str, later: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """Exact prices of a layer's four nodes and the least letter among the tight arcs of each, from the next layer's prices."""
    prices = [min(later)] * 4
    worth = lambda arc: arc[1] + (later if arc[3] else prices)[arc[2]]
    for origin in range(4):
        path = [origin]
        while True:
            at = path[-1]
            best = min(arcs(kind, at), key=worth)
            if prices[at] < worth(best):
                prices[at] = worth(best)
                if len(path) > 1:
                    path.pop()
            elif best[3]:
                break
            else:
                path.append(best[2])
    letters = (next(arc[0] for arc in arcs(kind, state) if worth(arc) == prices[state]) for state in range(4))
    return tuple(prices), "".join(letters)


def _turns(rows: DataFrame, present: Column | None) -> DataFrame:
    """Turns with their faults, all of a conversation in one partition; ``present`` false leaves only the conversation's id."""
    present = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    role, text = (F.when(present, F.coalesce(F.col(c), F.lit(" "))).alias(c) for c in ("role", "text"))
    dealt = rows.select("conv_id", F.when(present, F.col("turn")).alias("turn"), role, text, present.alias("present")).repartition("conv_id")
    # The window needs no shuffle of its own: its rows are dealt by a part of its key already.
    same = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.asc_nulls_first("turn"))
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", "blank").when(F.col("again") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), GOES).otherwise(
        F.concat(F.when(initial.isin(*KEPT), initial).otherwise("o"), F.when(F.col("fault") == "truncated", "t").otherwise(""))
    )
    return dealt.withColumn("again", F.row_number().over(same)).withColumn("fault", fault).withColumn("kind", kind)


ORDER = ("turn", "role", "text", "again")


def _priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the four letters of every turn's layer; turns of a conversation come from the last to the first."""
    current, later = object(), ()
    for batch in batches:
        found = []
        for conv, kind, present in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "present"))):
            if conv != current:
                current, (later, _) = conv, auction(END, (0, 0, 0, 0))
            if not present:
                found.append("")
                continue
            prices, letters = auction(kind, later)
            later = tuple(price - min(prices) for price in prices)
            found.append(letters)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "letters"])


class _Trace:
    """One conversation on its way: edits so far, the digest of what is repaired, and counts."""

    def __init__(self, conv):
        self.conv, self.state, self.edits, self.cost = conv, START, [], 0
        self.first = self.last = None
        self.turns, self.counts, self.illegal, self.before = 0, dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, None
        self.digest, self.written = hashlib.sha256(), 0

    def write(self, letter: str, role: str, text: str) -> tuple:
        if self.written:
            self.digest.update(b"\n")
        self.digest.update(f"{role}:{text}".encode())
        self.written += 1
        return self.conv, self.written, letter, role, text

    def insert(self, letters: str) -> list[tuple]:
        written = []
        while letters[self.state] == "I":
            self.state = NEXT[self.state]
            self.edits.append("I")
            self.cost += COSTS["I"]
            written.append(self.write("I", ROLE[self.state], ""))
        return written

    def turn(self, turn, role: str, text: str, fault: str, kind: str, letters: str) -> list[tuple]:
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        written = self.insert(letters)
        letter = letters[self.state]
        self.edits.append(letter)
        self.cost += COSTS[letter] + (TRUNCATED if letter != "D" and fault == "truncated" else 0)
        if letter == "K":
            self.state = KEPT[kind[0]][self.state]
            written.append(self.write("K", role, text))
        elif letter == "R":
            self.state = NEXT[self.state]
            written.append(self.write("R", ROLE[self.state], text))
        return written

    def closed(self) -> tuple[list[tuple], tuple]:
        """What is inserted after the last turn, and the conversation's row."""
        written = self.insert(auction(END, (0, 0, 0, 0))[1])
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        row = self.conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.edits), self.digest.hexdigest()
        return written, row


COLUMNS = ("conv_id", "turn", "role", "text", "present", "fault", "kind", "letters")


def _traced(schema: T.StructType, audits: bool):
    """Follows the letters from the start of each conversation: its repaired turns, or one row for it."""
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(target)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, target)], schema=target)

        def closed(trace: _Trace | None) -> list[tuple]:
            if trace is None:
                return []
            written, row = trace.closed()
            return [row] if audits else written

        trace = None
        for batch in batches:
            rows = []
            for conv, *turn in zip(*(batch.column(c).to_pylist() for c in COLUMNS)):
                if trace is None or conv != trace.conv:
                    rows += closed(trace)
                    trace = _Trace(conv)
                *turn, present, fault, kind, letters = turn
                if present:
                    written = trace.turn(*turn, fault, kind, letters)
                    rows += [] if audits else written
            yield out(rows)
        yield out(closed(trace))

    return run


def _run(rows: DataFrame, present: Column | None, fields: str, audits: bool) -> DataFrame:
    turns = _turns(rows, present)
    letters = T.StructType([*turns.schema.fields, T.StructField("letters", T.StringType())])
    last_first = [F.desc_nulls_last("turn"), *[F.desc_nulls_last(c) for c in ORDER[1:]]]
    priced = turns.sortWithinPartitions(F.col("conv_id"), *last_first).mapInArrow(_priced, letters)
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T.StructType.fromDDL(fields).fields])
    return priced.sortWithinPartitions("conv_id", *[F.asc_nulls_first(c) for c in ORDER]).mapInArrow(_traced(schema, audits), schema)


def repaired(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """The turns of well-formed conversations: conv_id, place (from 1), edit (K, R or I), role, text.

    ``rows`` has conv_id, turn, role and text; other columns are ignored. Turns go by ``turn``, null first, and those with the
    same number by role and text. Null role and text count as one blank, a null conv_id as a conversation of its own; repeated
    rows are duplicates; only initials s, u and a of a role can be kept. ``present`` false leaves a row out, but not its conversation.
    """
    return _run(rows, present, "place bigint, edit string, role string, text string", False)


def audits(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conversation, also for those without a turn present, from the same repair.

    gaps (missing numbers between the least and the greatest turn), blank, duplicate, truncated (a turn's first fault),
    illegal (neighbours whose initials are not su, ua or au), cost, audit (initials of the edits in order) and
    repaired_sha256 (of the repaired ``role:text``, joined by newlines).
    """
    counts = ", ".join(f"{c} bigint" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return _run(rows, present, f"{counts}, audit string, repaired_sha256 string", True)
