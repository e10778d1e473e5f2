"""Repair of conversation structure by A* on the edit lattice.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles.  Rows are judged in SQL functions (one
shuffle by conversation; the sort inside it also tells repeated rows); a task then streams each conversation
in order.  The lattice has a node for each number of rows read and each state of that pattern; edits lead from
node to node.  The heuristic is a suffix sum of what every repair must still pay: three for a row that has to
go, one for a truncated one (kept, it is charged one, deleted three).  It is admissible and consistent, so the
first goal taken from the heap, keyed (cost plus heuristic, audit), is the cheapest and of those the least audit.

Long conversations are cut into segments of ``SEGMENT`` rows.  A* gives for every state before a segment the best
edits to every state after it, and the best path to each state is carried on with its running SHA-256; two
audits of equal cost to one node are never prefixes of each other, so the least of a whole is made of least
parts.  A task holds one segment's texts and four audits of a byte or so a row, whatever a conversation's size.

Defined results: null role and text are one space, so is a null id or turn in the damage key; rows with a null
``conv_id`` are one conversation; rows of one turn go by role, then text; an empty role has no initial and can't
stay; repeated rows are duplicates; a conversation without rows left gives zeros and the hash of nothing; other
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SEGMENT = 256
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States of the pattern: nothing yet, after the system row, within a pair, after a pair.  The role that may follow, and where it leads.
START, SYSTEM, ASKED, ANSWERED = range(4)
FOLLOWS = {START: ("user", ASKED), SYSTEM: ("user", ASKED), ASKED: ("assistant", ANSWERED), ANSWERED: ("user", ASKED)}
WHOLE = (START, ANSWERED)
LEGAL = {"su", "ua", "au"}
#: A row as the search sees it: initial of its role, fault (b, d, t or none), role, text.
Row = tuple[str, str, str, str]


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, gone, turn, role, text: the rows after damage, each repeated one twice; dropped ones are marked ``gone``."""
    name = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" "))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"),
        (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20).alias("hit"),
    )
    rows = rows.withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        "conv_id", (F.col("hit") == 0).alias("gone"), "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit").isin(0, 1), "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
    )


def judged(rows: DataFrame) -> DataFrame:
    """The rows with their first fault, each conversation in one partition and in order."""
    seen = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(said == "", "b").when(F.col("seen") > 1, "d").when(~F.substring(said, -1, 1).isin(".", "!", "?"), "t").otherwise("")
    # the window needs no exchange of its own: rows that agree in its keys share a conversation
    rows = rows.repartition("conv_id").withColumn("seen", F.row_number().over(seen)).withColumn("fault", fault)
    return rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "seen").drop("seen")


def search(rows: list[Row], entry: int, goals: tuple[int, ...], every: bool = False) -> dict[int, tuple[int, str]]:
    """Cost and audit from the state ``entry`` to the best of ``goals``, or with ``every`` to each that can be reached."""
    ahead = [0]
    for _, fault, _, _ in reversed(rows):
        ahead.append(ahead[-1] + {"b": DELETE, "d": DELETE, "t": TRUNCATED}.get(fault, 0))
    ahead.reverse()
    heap, closed, found, n = [(ahead[0], "", 0, entry)], set(), {}, len(rows)
    while heap:
        total, audit, i, state = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n and state in goals:
            found[state] = total, audit
            if not every or len(found) == len(goals):
                break
        paid = total - ahead[i]
        role, after = FOLLOWS[state]
        heapq.heappush(heap, (total + INSERT, audit + "I", i, after))
        if i == n:
            continue
        initial, fault, _, _ = rows[i]
        rest = ahead[i + 1]
        heapq.heappush(heap, (paid + DELETE + rest, audit + "D", i + 1, state))
        if fault in ("b", "d"):
            continue
        charge = paid + (TRUNCATED if fault else 0) + rest
        heapq.heappush(heap, (charge + REROLE, audit + "R", i + 1, after))
        if initial == role[0]:
            heapq.heappush(heap, (charge, audit + "K", i + 1, after))
        elif initial == "s" and state == START:
            heapq.heappush(heap, (charge, audit + "K", i + 1, SYSTEM))
    return found


def replay(rows: list[Row], entry: int, audit: str) -> list[tuple[str, str]]:
    """Role and text of what the edits leave; the pattern leaves no choice of roles."""
    out, left, state = [], iter(rows), entry
    for edit in audit:
        role, after = FOLLOWS[state]
        if edit == "I":
            out.append((role, ""))
        else:
            initial, _, own, text = next(left)
            if edit == "D":
                continue
            if edit == "K":
                role, after = own, SYSTEM if initial == "s" else after
            out.append((role, text))
        state = after
    return out


class Digest:
    """SHA-256 of ``role:text`` lines, joined by newlines, that can be carried on in copies."""

    def __init__(self):
        self.hash, self.lines = hashlib.sha256(), 0

    def after(self, turns: list[tuple[str, str]]) -> Digest:
        out = Digest()
        out.hash, out.lines = self.hash.copy(), self.lines + len(turns)
        for k, (role, text) in enumerate(turns):
            out.hash.update(f"{chr(10) if k or self.lines else ''}{role}:{text}".encode())
        return out


@dataclass
class Conversation:
    """What is known of one conversation while its rows pass."""

    conv_id: int | None
    low: int | None = None
    high: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    before: str | None = None
    segment: list[Row] = field(default_factory=list)
    paths: dict[int, tuple[int, str, Digest]] = field(default_factory=lambda: {START: (0, "", Digest())})

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        if len(self.segment) == SEGMENT:
            self.step((START, SYSTEM, ASKED, ANSWERED), True)
        self.segment.append((initial, fault, role, text))

    def step(self, goals: tuple[int, ...], every: bool) -> None:
        """Carry the best paths over the segment."""
        best: dict[int, tuple[int, str, int, str]] = {}
        for entry, (cost, audit, _) in self.paths.items():
            for state, (more, edits) in search(self.segment, entry, goals, every).items():
                path = cost + more, audit + edits, entry, edits
                best[state] = min(path, best.get(state, path))
        self.paths = {state: (cost, audit, self.paths[entry][2].after(replay(self.segment, entry, edits))) for state, (cost, audit, entry, edits) in best.items()}
        self.segment = []

    def result(self) -> tuple:
        self.step(WHOLE, False)
        cost, audit, digest = min(self.paths.values(), key=lambda p: p[:2])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.hash.hexdigest()


SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of every conversation of ``rows`` (conv_id, gone, turn, role, text)."""
    bounded_batches(rows.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
        for batch in batches:
            for conv, gone, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "gone", "turn", "role", "text", "fault"))):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv)
                if not gone:
                    now.add(turn, role, text, fault)
            if done:
                yield flush()
                done = []
        if now is not None:
            done.append(now.result())
            yield flush()

    return judged(rows).mapInArrow(run, SCHEMA)


def repair(turns: DataFrame) -> DataFrame:
    """Damage the rows as the contract says, then repair each conversation."""
    return repaired(damaged(turns))
