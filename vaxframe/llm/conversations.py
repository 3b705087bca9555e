"""Repair of conversation structure by iterative-deepening A*.

A conversation is its rows by turn (nulls first; rows of one turn by role, then by a hash of the text, so repeats stand side
by side). Edits: D deletes a row (3; required for blank rows and duplicates), I inserts an empty user or assistant
row (2), K keeps a row, R gives it the role user or assistant (2); a truncated row that is not deleted adds 1. The
result's role initials must be nothing, or an optional s and one or more times ua.

Search: depth first, edits in ASCII order, within a cost bound that rises to the least cost that was cut off. The estimate
of what is left is 3 for each row that must go, 1 for each truncated one, and 1 for each illegal pair of neighbours among
the others (no edit repairs more of them than it costs). A table of failed states keeps the least cost that each is
known to need. The first accepting path is the cheapest, and the least in ASCII order among the cheapest.

Scale: rows are sorted over all tasks by conversation and turn, so a long conversation is spread over tasks. A task cuts
what it has of one into segments of SEGMENT rows and searches each from every state that it can begin in to every state
that it can end in; the cheapest path through all segments is the cheapest of the conversation, since equal costs between the
same states never give audits of which one begins the other. A conversation that lies inside one task is settled there. Of
the others (at most two a task, and long ones) the tasks' parts are joined, and their texts run once past the chosen audit in order.
Equal rows are counted before the sort, and duplicates are found by hash, not by holding a conversation together.

Defined results: null role or text is one space; a null conv_id is one conversation; gaps ignore null turns; a
conversation without rows has zeros, an empty audit and the hash of the empty string; any other columns are unused.
"""

from __future__ import annotations

import hashlib
import json
import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaxframe.sources.scratch import stage

BLANKS = " \t\n\x0b\f\r"
SEGMENT = 64
#: Text bytes of one conversation that a task holds until it knows the audit.
HELD_BYTES = 4 << 20
#: Grammar states: nothing yet, after s, after u, after a. What follows by keeping an initial, and by a user or assistant row.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEEDED = (2, 2, 3, 2)
REACHED = ({0, 1, 2, 3}, {1, 2, 3}, {2, 3}, {2, 3})
ENDS = (0, 3)
LEGAL = {"su", "ua", "au"}
NAMES = {2: "user", 3: "assistant"}

KEY = ["conv", "turn", "role", "h1", "h2"]
PARTS = ("conv string, conv_id long, kind int, part int, seq int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
         "audit string, repaired_sha256 string, summary string, roles array<string>, texts array<string>")
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COLUMNS = [x.split()[0] for x in RESULT.split(", ")]


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, chosen by crc32 of ``conv_id:turn``; a conversation that loses all rows keeps one with copies = 0."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"),
                       F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def search(rows: list[tuple], start: int, goals: set[int]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest path over rows (initial, must go, truncated) from a state to one of the goals."""
    end = len(rows)
    rest, after = [0] * (end + 1), ""
    for i in range(end - 1, -1, -1):
        initial, gone, truncated = rows[i]
        rest[i] = rest[i + 1] + (3 if gone else truncated + (after != "" and initial + after not in LEGAL))
        after = after if gone else initial or " "
    known: dict[int, float] = {}
    path: list[str] = []

    def failed(i: int, state: int, budget: float) -> float:
        """0 if a path was found, else a cost above the budget that is needed at least."""
        if i == end and state in goals:
            return 0
        if not goals & REACHED[state]:
            return math.inf
        least = known.get(4 * i + state, rest[i])
        if least > budget:
            return least
        least = math.inf
        moves = [("I", 2, i, NEEDED[state])]
        if i < end:
            initial, gone, truncated = rows[i]
            moves.insert(0, ("D", 3, i + 1, state))
            if not gone:
                if initial in STEPS[state]:
                    moves.append(("K", int(truncated), i + 1, STEPS[state][initial]))
                moves.append(("R", 2 + truncated, i + 1, NEEDED[state]))
        for letter, cost, to, then in moves:
            if cost > budget:
                least = min(least, cost + rest[to])
                continue
            path.append(letter)
            need = failed(to, then, budget - cost)
            if need == 0:
                return 0
            path.pop()
            least = min(least, cost + need)
        known[4 * i + state] = least = max(least, budget + 1)
        return least

    bound: float = rest[0]
    while need := failed(0, start, bound):
        if need == math.inf:
            return None
        bound = need
    return int(bound), "".join(path)


def advance(front: dict[int, tuple[int, str]], rows: list[tuple]) -> dict[int, tuple[int, str]]:
    """The best (cost, audit) to every state after a further segment."""
    out: dict[int, tuple[int, str]] = {}
    for state, (cost, audit) in front.items():
        for goal in REACHED[state]:
            if found := search(rows, state, {goal}):
                best = (cost + found[0], audit + found[1])
                out[goal] = min(out.get(goal, best), best)
    return out


class Writer:
    """Runs rows past an audit and hashes the repaired ones."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.empty = audit, 0, 0, hashlib.sha256(), True

    def _line(self, role: str, text: str) -> None:
        self.sha.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = NEEDED[self.state]
            self._line(NAMES[self.state], "")
            self.at += 1

    def add(self, role: str, text: str | None) -> None:
        self._insert()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = STEPS[self.state][role[:1]]
            self._line(role, text or "")
        elif letter == "R":
            self.state = NEEDED[self.state]
            self._line(NAMES[self.state], text or "")

    def digest(self) -> str:
        self._insert()
        return self.sha.hexdigest()


class Tally:
    """Counts over rows in order; parts add up in order."""

    FIELDS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "low", "high")

    def __init__(self, values: list | None = None):
        for name, value in zip(self.FIELDS, values or [0, 0, 0, 0, 0, 0, "", "", None, None], strict=True):
            setattr(self, name, value)

    def values(self) -> list:
        return [getattr(self, name) for name in self.FIELDS]

    def add(self, other: Tally) -> None:
        if not other.rows:
            return
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.illegal += bool(self.rows) and self.last + other.first not in LEGAL
        self.turns -= self.high is not None and self.high == other.low
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high
        self.first, self.last, self.rows = self.first if self.rows else other.first, other.last, self.rows + other.rows

    def columns(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


class Conversation:
    """What a task has of one conversation."""

    def __init__(self, conv: str, conv_id: int | None, begins: bool):
        self.conv, self.conv_id, self.begins = conv, conv_id, begins
        self.fronts = {s: {s: (0, "")} for s in ((0,) if begins else (0, 1, 2, 3))}
        self.tally, self.segment, self.held, self.size, self.spilled = Tally(), [], [], 0, 0

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        stripped = text.strip(BLANKS)
        blank = not stripped
        again = seen and not blank
        cut = not blank and not again and stripped[-1] not in ".!?"
        self.tally.add(Tally([1, int(blank), int(again), int(cut), 0, int(turn is not None), role[:1], role[:1], turn, turn]))
        self.segment.append((role[:1], blank or again, int(cut)))
        self.held.append((role, None if blank or again else text))
        self.size += 0 if blank or again else len(text)
        if len(self.segment) == SEGMENT:
            self.flush()

    def flush(self) -> None:
        if self.segment:
            self.fronts = {s: advance(front, self.segment) for s, front in self.fronts.items()}
            self.segment = []

    def texts(self, part: int):
        """The held rows as a row of a further part."""
        if self.held:
            self.spilled += 1
            roles, texts = zip(*self.held, strict=True)
            yield {"conv": self.conv, "conv_id": self.conv_id, "kind": 2, "part": part, "seq": self.spilled, "roles": list(roles), "texts": list(texts)}
        self.held, self.size = [], 0

    def close(self, part: int, ends: bool):
        """The result, if the conversation lies here; else its summary and texts."""
        if self.begins and ends and not self.spilled:
            if self.tally.rows <= SEGMENT and len(self.segment) == self.tally.rows:
                cost, audit = search(self.segment, 0, set(ENDS))
            else:
                self.flush()
                cost, audit = min(self.fronts[0][s] for s in ENDS if s in self.fronts[0])
            writer = Writer(audit)
            for role, text in self.held:
                writer.add(role, text)
            yield {"conv": self.conv, "conv_id": self.conv_id, "kind": 0, **self.tally.columns(), "cost": cost, "audit": audit, "repaired_sha256": writer.digest()}
            return
        self.flush()
        yield from self.texts(part)
        fronts = [[s, t, *best] for s, front in self.fronts.items() for t, best in front.items()]
        yield {"conv": self.conv, "conv_id": self.conv_id, "kind": 1, "part": part, "seq": 0, "summary": json.dumps([self.tally.values(), fronts])}


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _written(rows, schema: pa.Schema, most_bytes: int = 4 << 20):
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 200 + sum(len(x or "") for x in row.get("texts", ())) + len(row.get("audit", "")) + len(row.get("summary", ""))
        if size > most_bytes:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _part_rows(batches):
    """Results of the conversations that lie inside the task, parts of the others."""
    task = TaskContext.get()
    part = task.partitionId() if task else 0

    def run():
        now, first, mark = None, True, None
        for conv, conv_id, turn, role, h1, h2, text, copies, order in _rows(batches):
            if now is None or conv != now.conv:
                if now is not None:
                    yield from now.close(part, ends=True)
                    first = False
                now, mark = Conversation(conv, conv_id, begins=not first), None
            if order == 0:  # the conversation exists
                continue
            if order == 1:  # the next row repeats an earlier one
                mark = (turn, role, h1, h2)
                continue
            for k in range(copies):
                now.add(turn, role, text, seen=k > 0 or mark == (turn, role, h1, h2))
                if now.size > HELD_BYTES or len(now.held) >= 64 * SEGMENT:
                    yield from now.texts(part)
        if now is not None:
            yield from now.close(part, ends=False)

    yield from _written(run(), _arrow(PARTS))


def _joined_rows(batches):
    """Results from the parts of each conversation: summaries first, then texts, each in order."""

    def result(conv_id, tally, cost, writer):
        return {"conv_id": conv_id, **tally.columns(), "cost": cost, "audit": writer.audit, "repaired_sha256": writer.digest()}

    def run():
        now, conv_id, tally, front, writer, cost = None, None, Tally(), {}, None, 0
        for conv, own_id, kind, summary, roles, texts in _rows(batches):
            if conv != now:
                if now is not None:
                    cost, audit = (cost, None) if writer else min(front[s] for s in ENDS if s in front)
                    yield result(conv_id, tally, cost, writer or Writer(audit))
                now, conv_id, tally, front, writer = conv, own_id, Tally(), {0: (0, "")}, None
            if kind == 1:
                values, paths = json.loads(summary)
                tally.add(Tally(values))
                after: dict[int, tuple[int, str]] = {}
                for s, t, c, a in paths:
                    if s in front:
                        best = (front[s][0] + c, front[s][1] + a)
                        after[t] = min(after.get(t, best), best)
                front = after
                continue
            if writer is None:
                cost, audit = min(front[s] for s in ENDS if s in front)
                writer = Writer(audit)
            for role, text in zip(roles, texts, strict=True):
                writer.add(role, text)
        if now is not None:
            cost, audit = (cost, None) if writer else min(front[s] for s in ENDS if s in front)
            yield result(conv_id, tally, cost, writer or Writer(audit))

    yield from _written(run(), _arrow(RESULT))


def repair(rows: DataFrame) -> DataFrame:
    """A row per conversation of (conv_id, turn, role, text) and, where given, copies: how often the row stands there."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    one = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), F.col("conv_id").cast("long").alias("conv_id"),
                       F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), copies.cast("long").alias("copies"))
    exists = rows.select("conv", "conv_id").distinct().selectExpr(
        "conv", "conv_id", "cast(null as long) as turn", "cast(null as string) as role", "0L as h1", "0L as h2", "cast(null as string) as text", "0L as copies", "0 as order")
    there = rows.where("copies > 0").select("conv", "conv_id", "turn", "role", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("text"), "text").alias("h2"), "text", "copies")
    words = there.where(F.btrim("text", F.lit(BLANKS)) != "").select(*KEY, F.expr("struct(turn is not null as b, turn)").alias("at")).distinct()
    first = words.groupBy("conv", "role", "h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = words.join(first, ["conv", "role", "h1", "h2"]).where("at <> first").select(*KEY)
    again = again.selectExpr("conv", "cast(null as long) as conv_id", "turn", "role", "h1", "h2", "cast(null as string) as text", "0L as copies", "1 as order")
    each = there.groupBy("conv", "conv_id", *KEY[1:], "text").agg(F.sum("copies").alias("copies")).withColumn("order", F.lit(2))
    every = exists.unionByName(again).unionByName(each)
    order = [F.asc_nulls_first(c) for c in KEY]
    dealt = every.repartitionByRange(*order).sortWithinPartitions(*order, "order")
    parts = stage(dealt.select("conv", "conv_id", *KEY[1:], "text", "copies", "order").mapInArrow(_part_rows, PARTS), "conversations")
    rest = parts.where("kind > 0").repartition("conv").sortWithinPartitions("conv", "kind", "part", "seq")
    joined = rest.select("conv", "conv_id", "kind", "summary", "roles", "texts").mapInArrow(_joined_rows, RESULT)
    return parts.where("kind = 0").select(*COLUMNS).unionByName(joined)


def repair_digest(conversations: DataFrame) -> DataFrame:
    """The repair of the damaged table."""
    return repair(damage(conversations))
