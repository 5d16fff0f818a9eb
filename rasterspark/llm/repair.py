"""Repair of conversations by the cheapest edits, found by A* on the edit lattice.

A conversation's rows, in the order of turn (nulls first, then role and the text's digest), have to become a
sequence of role initials `(s?(ua)+)?`. A row is kept (0), gets the role that has to stand there (1) or is
deleted (2); an empty turn can be inserted anywhere (5). Blank rows and repeats have to be deleted, a row that
ends in mid-sentence costs 5 more unless it is deleted. Of equally cheap edits the ASCII-least string of their
initials (the audit) counts.

The lattice has a node for each row and state of the pattern. `search` is A* on it, ordered by (cost so far
plus bound, audit); the bound is the suffix sum of 2 for each row that has to be deleted or is truncated,
which every repair pays. Keys of one node never are prefixes of each other at equal cost, so the first way
to a node is the cheapest and the ASCII-least.

No conversation has to fit in a task. Rows are dealt by ranges of (conversation, turn, role, digest), as small
facts without texts, so a conversation of a third of all rows lies in many tasks. A task streams over its
rows; a stretch of over `BLOCK` rows, and one that may go on in another task, is a table: for every state
at its start and end the cheapest edits. Tables of neighbours compose (and associate), and what they hold of
a conversation is as large as its audit. At last rows and audits meet in the order of rows, and each
conversation is written as a stream. (A SHA-256 is one chain, so that stream is one task's.)

Null roles and texts are one space, so such a text is blank; an empty role has no
initial and cannot be kept; a null conv_id is a conversation of its own, null
turns come first and count in no gap. Repeated rows are repeats. Other columns are ignored, whatever their
names. A long text passes as a row. An empty table gives an empty one; a conversation without rows after
damage has zeros, an empty audit and the hash of nothing.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterspark.llm.common import buckets, scratch

START, SYSTEM, USER, ASSISTANT = range(4)  # what stands last in the repaired sequence
ENDS = (START, ASSISTANT)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEEP = {(START, "s"): SYSTEM} | {(s, "a" if s == USER else "u"): t for s, t in NEXT.items()}
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
BLOCK = 256
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

#: initial of the role, whether the row has to go, whether it ends in mid-sentence
Fact = tuple[str, bool, bool]
Table = dict[tuple[int, int], tuple[int, str]]


def search(rows: list[Fact], entry: int, close: bool) -> dict[int, tuple[int, str]]:
    """The cheapest (cost, audit) from the entry state over all rows: to each state, or (close) to the first that may end, inserting after the last row too."""
    bound = [0]
    for _, gone, cut in reversed(rows):
        bound.append(bound[-1] + DELETE * (gone or cut))
    bound.reverse()
    found, done = {}, set()
    waiting = [(bound[0], "", 0, entry, 0)]
    while waiting:
        _, audit, i, state, cost = heapq.heappop(waiting)
        if (i, state) in done:
            continue
        done.add((i, state))
        steps = []
        if i == len(rows):
            if not close or state in ENDS:
                found[state] = (cost, audit)
                if close or len(found) == 4:
                    break
        else:
            initial, gone, cut = rows[i]
            steps.append(("D", i + 1, state, DELETE))
            if not gone:
                if (kept := KEEP.get((state, initial))) is not None:
                    steps.append(("K", i + 1, kept, CUT * cut))
                steps.append(("R", i + 1, NEXT[state], REROLE + CUT * cut))
        if i < len(rows) or close:
            steps.append(("I", i, NEXT[state], INSERT))
        for letter, j, to, price in steps:
            if (j, to) not in done:
                heapq.heappush(waiting, (cost + price + bound[j], audit + letter, j, to, cost + price))
    return found


def table_of(rows: list[Fact], entries=(START, SYSTEM, USER, ASSISTANT)) -> Table:
    return {(s, t): way for s in entries for t, way in search(rows, s, close=False).items()}


def compose(a: Table, b: Table) -> Table:
    """The table of two neighbouring stretches."""
    out: Table = {}
    for (s, m), (cost, audit) in a.items():
        for (m2, t), (more, rest) in b.items():
            if m == m2:
                out[s, t] = min(out.get((s, t), (1 << 62, "")), (cost + more, audit + rest))
    return out


def composed(tables: list[Table]) -> Table:
    """All tables in order, halves first, so that an audit is copied a logarithmic number of times."""
    while len(tables) > 1:
        tables = [compose(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0]


def closed(table: Table) -> tuple[int, str]:
    """The cheapest way from the start through a table to an end, inserting after the last row too."""
    return min((cost + more, audit + rest) for (s, t), (cost, audit) in table.items() if s == START for more, rest in search([], t, close=True).values())


def damaged(turns: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> the same with faults by crc32 of 'conv_id:turn' modulo 20; nulls of role and text are one space."""
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(spelled[0], F.lit(":"), spelled[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return (
        turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), fault.alias("_fault"))
        .filter("_fault <> 0")
        .withColumn("text", F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")))
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1))))
        .select("conv_id", "turn", "role", "text", F.sha2("text", 256).alias("digest"))
    )


ORDER = ["conv_id", "turn", "role", "digest"]
COUNTS = ("blank", "duplicate", "truncated", "illegal")
STRETCH = "conv_id long, task int, n long, first string, last string, low long, high long, distinct_turns long, " + ", ".join(f"{c} long" for c in COUNTS) + ", ways array<struct<s:int,t:int,cost:long,audit:string>>"
SOLVED = "conv_id long, gaps long, " + ", ".join(f"{c} long" for c in COUNTS) + ", cost long, audit string"


class _Stretch:
    """The rows of a conversation that a task has, as they come."""

    def __init__(self, conv):
        self.conv, self.n, self.first, self.last, self.turn = conv, 0, None, None, None
        self.low = self.high = None
        self.turns, self.rows, self.tables, self.counts, self.key = 0, [], [], dict.fromkeys(COUNTS, 0), None

    def add(self, turn, role: str, digest: str, initial: str, blank: bool, cut: bool, again: bool) -> None:
        again = again or self.key == (turn, role, digest)
        self.key = (turn, role, digest)
        self.counts["blank"] += blank
        self.counts["duplicate"] += again and not blank
        self.counts["truncated"] += cut and not blank and not again
        self.counts["illegal"] += self.n > 0 and (self.last, initial) not in LEGAL
        if turn is not None and turn != self.high:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        self.first, self.last = initial if self.first is None else self.first, initial
        self.n += 1
        self.rows.append((initial, blank or again, cut and not blank and not again))
        if len(self.rows) == BLOCK:
            self.tables.append(table_of(self.rows))
            self.rows = []

    def out(self, task: int, whole: bool) -> tuple:
        """whole: no other task has rows of the conversation."""
        if whole and not self.tables:
            table = {(START, t): way for t, way in search(self.rows, START, close=True).items()}
        else:
            table = composed([*self.tables, *([table_of(self.rows)] if self.rows else [])])
        ways = [{"s": s, "t": t, "cost": c, "audit": a} for (s, t), (c, a) in table.items()]
        return (self.conv, task, self.n, self.first, self.last, self.low, self.high, self.turns, *self.counts.values(), ways)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


_WAYS = pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_STRETCH = pa.schema([("conv_id", pa.int64()), ("task", pa.int32()), ("n", pa.int64()), ("first", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in ("low", "high", "distinct_turns", *COUNTS)), ("ways", _WAYS)])
_SOLVED = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("cost", pa.int64()), ("audit", pa.string())])


def _stretches(batches):
    """Streams over sorted facts: a row for each conversation of the task. Its first and last may go on elsewhere."""
    task, held, first = TaskContext.get().partitionId(), None, True
    for batch in batches:
        out = []
        for conv, *fact in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or held.conv != conv:
                if held is not None:
                    out.append(held.out(task, whole=not first))
                    first = False
                held = _Stretch(conv)
            held.add(*fact)
        yield _table(out, _STRETCH)
    if held is not None:
        yield _table([held.out(task, whole=False)], _STRETCH)


def _joined(group: pa.Table) -> pa.Table:
    """All stretches of a conversation -> its counts and its cheapest audit."""
    rows = sorted(group.to_pylist(), key=lambda r: r["task"])
    counts = {c: sum(r[c] for r in rows) for c in COUNTS}
    for a, b in zip(rows, rows[1:]):
        counts["illegal"] += (a["last"], b["first"]) not in LEGAL
    own = [r for r in rows if r["low"] is not None]
    distinct = sum(r["distinct_turns"] for r in own) - sum(a["high"] == b["low"] for a, b in zip(own, own[1:]))
    gaps = own[-1]["high"] - own[0]["low"] + 1 - distinct if own else 0
    cost, audit = closed(composed([{(w["s"], w["t"]): (w["cost"], w["audit"]) for w in r["ways"]} for r in rows]))
    return pa.Table.from_batches([_table([(rows[0]["conv_id"], gaps, *counts.values(), cost, audit)], _SOLVED)])


def solved(rows: DataFrame, n: int) -> DataFrame:
    """Rows as of `damaged` -> conv_id, gaps, counts of faults, cost and audit of each conversation that has any."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    facts = rows.select(*ORDER, F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("cut"))
    # a repeat: the same role and text at an earlier turn, or beside it in the order (seen where rows are streamed)
    same = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.count("*").alias("_n"), F.min(F.struct("turn")).alias("_first"))
    match = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    again = F.coalesce(~F.col("turn").eqNullSafe(F.col("_first.turn")) & F.col("_n").isNotNull(), F.lit(False))
    facts = facts.join(same.filter("_n > 1"), match, "left").select(*facts.columns, again.alias("again"))
    stretches = facts.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).mapInArrow(_stretches, STRETCH)
    return stretches.groupBy("conv_id").applyInArrow(_joined, SOLVED)


class _Writer:
    """A conversation's repaired turns as its rows come, by its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield "I", ROLES[self.state], ""

    def row(self, role: str, text: str):
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEEP[self.state, role[:1]]
            yield letter, role, text
        elif letter == "R":
            self.state = NEXT[self.state]
            yield letter, ROLES[self.state], text


def _in_order(rows: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Each conversation's line of `found`, then its rows, together and in order."""
    both = found.withColumn("_row", F.lit(False)).unionByName(rows.withColumn("_row", F.lit(True)), allowMissingColumns=True)
    return both.repartition(n, "conv_id").sortWithinPartitions("conv_id", "_row", *ORDER[1:])


def _turns(batches):
    """(line of the conversation, None), then (line, repaired turn) for each turn, then (line, 'end')."""
    line = writer = None
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns)):
            row = dict(zip(names, values))
            if not row["_row"]:
                if line is not None:
                    yield from ((line, t) for t in writer.inserts())
                    yield line, "end"
                line, writer = row, _Writer(row["audit"])
                yield line, None
            else:
                yield from ((line, t) for t in writer.row(row["role"], row["text"]))
        yield None, "batch"
    if line is not None:
        yield from ((line, t) for t in writer.inserts())
        yield line, "end"


def _lines(turns: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """A line for every conversation of the input, found or not."""
    found = solved(rows, n).withColumnRenamed("conv_id", "_conv")
    every = turns.select(F.col("conv_id").cast("long")).distinct()
    numbers = ["gaps", *COUNTS, "cost"]
    held = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return held.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"))


def audit(turns: DataFrame, damage: bool = False) -> DataFrame:
    """conversations -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    damage: of the conversations as `damaged` leaves them.
    """
    n = buckets(turns)
    rows = scratch(damaged(turns)) if damage else scratch(_plain(turns))
    schema = pa.schema([*_SOLVED, ("repaired_sha256", pa.string())])

    def run(batches):
        out, sha, written = [], None, False
        for line, turn in _turns(batches):
            if turn == "batch" and len(out) >= 1000:
                yield _table(out, schema)
                out = []
            elif line is None:
                continue
            elif turn is None:
                sha, written = hashlib.sha256(), False
            elif turn == "end":
                out.append((*(line[c] for c in _SOLVED.names), sha.hexdigest()))
            else:
                sha.update(f"{chr(10) * written}{turn[1]}:{turn[2]}".encode())
                written = True
        yield _table(out, schema)

    return _in_order(rows, _lines(turns, rows, n), n).mapInArrow(run, SOLVED + ", repaired_sha256 string")


def repair(turns: DataFrame, damage: bool = False) -> DataFrame:
    """conversations -> the repaired turns: conv_id, place (from 0), edit (K, R or I), role, text."""
    n = buckets(turns)
    rows = scratch(damaged(turns)) if damage else scratch(_plain(turns))
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        out, place = [], 0
        for line, turn in _turns(batches):
            if turn == "batch":
                yield _table(out, schema)
                out = []
            elif turn is None:
                place = 0
            elif turn != "end":
                out.append((line["conv_id"], place, *turn))
                place += 1
        yield _table(out, schema)

    return _in_order(rows, _lines(turns, rows, n), n).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def _plain(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role, text).withColumn("digest", F.sha2("text", 256))
