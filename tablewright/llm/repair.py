"""Conversation repair: the cheapest edits that make the roles of a conversation take turns.

Rows of one conversation come to one task in the order of their turns (a secondary sort) and stream through a dynamic
program over four states: nothing yet, after the system turn, after a user turn, after an assistant turn. It carries
from one Arrow batch to the next, per state, the least cost and how the edits so far rank among the other states'; what
led there is one byte per row and state. These bytes, and the rows to write once the end decides, lie in memory up to a
bound and in a file of the task beyond, so a conversation of any length needs no more memory than a short one.

Ties go to the edits that read least as text. That is decided as the rows come: edits end in that of the latest row, so
two states' edits are equal or differ at a place that no later edit changes, and their order stays.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
import tempfile
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Costs of the edits and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Bytes of rows and of backpointers that a task holds before they go to a file.
SPILL = 8 << 20

START, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow in each state: the initial and the next state.
_NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_TURN = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
_AFTER_INSERT = {state: _NEXT[state][_TURN[state][0]] for state in _NEXT}
_END = (START, ASSISTANT)
#: Edits of one row: up to two inserted turns, which lead from any state to any that one may need, and what becomes of it.
_STEPS = [(k, edit) for k in range(3) for edit in "DKR"]

REPAIRED = "at long, edit string, fault string, turn long, was string, role string, text string, cost long"
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _inserted(state: int, k: int) -> int:
    for _ in range(k):
        state = _AFTER_INSERT[state]
    return state


def _reach() -> dict[tuple[str, bool], list[tuple[int, int, int, int]]]:
    """Per initial and fault (``must go``, else whatever) the transitions: from, step, to, cost without truncation."""
    out: dict[tuple[str, bool], list[tuple[int, int, int, int]]] = {}
    for initial in ("s", "u", "a", ""):
        for gone in (False, True):
            found = []
            for state in _NEXT:
                for number, (k, edit) in enumerate(_STEPS):
                    at, cost = _inserted(state, k), k * INSERT
                    if edit == "D":
                        found.append((state, number, at, cost + DELETE))
                    elif gone:
                        continue
                    elif edit == "K" and initial in _NEXT[at]:
                        found.append((state, number, _NEXT[at][initial], cost + KEEP))
                    elif edit == "R":
                        found.append((state, number, _AFTER_INSERT[at], cost + REROLE))
            out[initial, gone] = found
    return out


_REACH = _reach()
_TEXT = ["I" * k + edit for k, edit in _STEPS]


class Program:
    """The dynamic program; :meth:`add` takes rows one by one, :meth:`edits` gives the steps of all, once."""

    def __init__(self, spill: int = SPILL) -> None:
        self.live = {START: (0, 0)}  # state: least cost, rank of its edits
        self.back = tempfile.SpooledTemporaryFile(max_size=spill)
        self.rows = 0

    def add(self, initial: str, fault: str) -> None:
        gone, late = fault in ("blank", "duplicate"), TRUNCATED * (fault == "truncated")
        best: dict[int, tuple[int, int, str, int, int]] = {}
        for state, step, to, cost in _REACH[initial if initial in ("s", "u", "a") else "", gone]:
            if state not in self.live:
                continue
            before, rank = self.live[state]
            way = (before + cost + (late if _STEPS[step][1] != "D" else 0), rank, _TEXT[step], state, step)
            if to not in best or way < best[to]:
                best[to] = way
        order = {edits: i for i, edits in enumerate(sorted({(w[1], w[2]) for w in best.values()}))}
        self.live = {to: (w[0], order[w[1], w[2]]) for to, w in best.items()}
        self.back.write(bytes(best[s][3] * len(_STEPS) + best[s][4] if s in best else 255 for s in range(4)))
        self.rows += 1

    def end(self) -> tuple[int, int, int]:
        """Cost, last state before the inserts at the end, and their number."""
        ways = [(cost + k * INSERT, rank, k, state) for state, (cost, rank) in self.live.items() for k in range(3) if _inserted(state, k) in _END]
        cost, _, k, state = min(ways)
        return cost, state, k

    def edits(self) -> Iterator[int]:
        """The step of every row, first to last: the backpointers are followed block by block into another such file."""
        _, state, _ = self.end()
        steps, size = tempfile.SpooledTemporaryFile(max_size=SPILL), 1 << 16
        starts = range(0, self.rows, size)
        for start in reversed(starts):
            n = min(size, self.rows - start)
            self.back.seek(4 * start)
            block, out = self.back.read(4 * n), bytearray(n)
            for i in range(n - 1, -1, -1):
                state, out[i] = divmod(block[4 * i + state], len(_STEPS))
            steps.write(out)
        for start in starts:  # the last block lies first
            n = min(size, self.rows - start)
            steps.seek(self.rows - start - n)
            yield from steps.read(n)
        steps.close()

    def close(self) -> None:
        self.back.close()


class _Spool:
    """Rows in the order they came, in memory up to a bound and in a file beyond."""

    def __init__(self, spill: int) -> None:
        self.file = tempfile.SpooledTemporaryFile(max_size=spill)

    def add(self, row: tuple) -> None:
        raw = pickle.dumps(row, pickle.HIGHEST_PROTOCOL)
        self.file.write(struct.pack("<q", len(raw)) + raw)

    def __iter__(self) -> Iterator[tuple]:
        self.file.seek(0)
        while head := self.file.read(8):
            yield pickle.loads(self.file.read(struct.unpack("<q", head)[0]))

    def close(self) -> None:
        self.file.close()


def repair_rows(rows: Iterable[tuple], spill: int = SPILL) -> Iterator[tuple]:
    """Rows of ``REPAIRED`` for one conversation's rows (turn, role, text, fault) in order.

    A row's edit is K, R or D, and I is one put in; a deleted row has no role and text. No rows need no edits.
    """
    program, spool = Program(spill), _Spool(spill)
    try:
        for turn, role, text, fault in rows:
            program.add(role[:1], fault)
            spool.add((turn, role, text, fault))
        at, state = 0, START
        last = program.end()[2]

        def put_in() -> tuple:
            return (at, "I", None, None, None, _TURN[state], "", INSERT)

        for (turn, role, text, fault), step in zip(spool, program.edits(), strict=True):
            k, edit = _STEPS[step]
            for _ in range(k):
                yield put_in()
                at, state = at + 1, _AFTER_INSERT[state]
            late = TRUNCATED * (fault == "truncated")
            if edit == "D":
                yield (at, edit, fault, turn, role, None, None, DELETE)
            elif edit == "K":
                yield (at, edit, fault, turn, role, role, text, KEEP + late)
                state = _NEXT[state][role[:1]]
            else:
                yield (at, edit, fault, turn, role, _TURN[state], text, REROLE + late)
                state = _AFTER_INSERT[state]
            at += 1
        for _ in range(last):
            yield put_in()
            at, state = at + 1, _AFTER_INSERT[state]
    finally:
        program.close()
        spool.close()


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, alive``: rows with faults put in by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 makes it the user's. Null roles,
    texts and, in the key, ids and turns count as one space. A dropped row stays as a mark without role and text, so that
    its conversation is known to exist.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("__kind"))
    kind = F.col("__kind")
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 0, "").when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("alive"), copies.alias("__copy")).drop("__copy")


def _fault(text: Column, seen: Column) -> Column:
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return F.when(last == "", "blank").when(seen > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")


def mark_faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``, a row's first one: ``blank``, ``duplicate`` (role and text came before in the conversation) or
    ``truncated`` (no sentence end); null for none. Copies are numbered per conversation, role and text, so no task holds them.
    """
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "alive").orderBy("turn"))
    return rows.withColumn("__seen", seen).withColumn("fault", F.when(F.col("alive"), _fault(F.col("text"), F.col("__seen")))).drop("__seen")


def repair(rows: DataFrame, spill: int = SPILL) -> DataFrame:
    """``conv_id`` and ``REPAIRED``: the edits that give each conversation roles ``(system? (user assistant)+)?`` at the least cost.

    ``rows`` has ``conv_id, turn, role, text, fault`` (:func:`mark_faults`) and maybe ``alive``; other columns are
    dropped. Rows are taken by turn (nulls first), then by role and text. A system, user or assistant row is one whose
    role begins so. Keeping costs 0, a new role (user or assistant) 2, deleting 3, inserting an empty turn 2, and a
    truncated row that stays 1; blank and duplicate rows are deleted. Of equally cheap edits those whose initials read
    least count. Null roles, texts and faults count as empty; null ids form one conversation. A conversation without
    living rows gives one row without an edit. Conversations come out whole, in order, each within one partition.
    """
    kind = rows.schema["conv_id"].dataType
    alive = F.coalesce("alive", F.lit(True)) if "alive" in rows.columns else F.lit(True)
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text", "fault")]
    placed = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *texts, alive.alias("alive"))
    names = ["conv_id", *(f.name for f in T._parse_datatype_string(REPAIRED).fields)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        stream = _rows(batches, kinds)
        out: list[tuple] = []
        for conv, turns in groupby(stream, key=itemgetter(0)):
            empty = True
            for row in repair_rows((r[1:5] for r in turns if r[5]), spill):
                out.append((conv, *row))
                empty = False
                if len(out) >= 2048:
                    yield _batch(out, names, kinds[0])
                    out = []
            if empty:
                out.append((conv, 0, None, None, None, None, None, None, 0))
        if out:
            yield _batch(out, names, kinds[0])

    schema = T.StructType([T.StructField("conv_id", kind), *T._parse_datatype_string(REPAIRED).fields])
    return placed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(scan, schema)


_TEXTS = {"edit", "fault", "was", "role", "text", "audit", "repaired_sha256"}


def _rows(batches: Iterator[pa.RecordBatch], kinds: list[pa.DataType]) -> Iterator[tuple]:
    """The rows of all batches; the type of their first column goes into ``kinds``."""
    for batch in batches:
        kinds[:] = [batch.schema.field(0).type]
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batch(rows: list[tuple], names: list[str], first: pa.DataType) -> pa.RecordBatch:
    kinds = [first, *(pa.string() if n in _TEXTS else pa.int64() for n in names[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def summarise(repaired: DataFrame) -> DataFrame:
    """``conv_id`` and ``SUMMARY`` of what :func:`repair` gave, read in its order.

    ``gaps`` are the turns missing between the first and the last, ``illegal`` the neighbours whose roles don't follow,
    both before the repair; ``audit`` is the edits' initials, the digest that of ``role:text`` lines after it.
    """
    kind = repaired.schema["conv_id"].dataType
    names = ["conv_id", *(f.name for f in T._parse_datatype_string(SUMMARY).fields)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        stream = _rows(batches, kinds)
        out: list[tuple] = []
        for conv, edits in groupby(stream, key=itemgetter(0)):
            out.append((conv, *_summary(r[1:] for r in edits)))
            if len(out) >= 2048:
                yield _batch(out, names, kinds[0])
                out = []
        if out:
            yield _batch(out, names, kinds[0])

    schema = T.StructType([T.StructField("conv_id", kind), *T._parse_datatype_string(SUMMARY).fields])
    return repaired.select("conv_id", "edit", "fault", "turn", "was", "role", "text", "cost").mapInArrow(scan, schema)


def _summary(edits: Iterable[tuple]) -> tuple:
    faults = {"blank": 0, "duplicate": 0, "truncated": 0}
    first = last = before = None
    turns = illegal = cost = 0
    audit, digest, lines = bytearray(), hashlib.sha256(), 0
    for edit, fault, turn, was, role, text, price in edits:
        if edit is None:
            continue
        audit += edit.encode()
        cost += price
        if fault:
            faults[fault] += 1
        if edit != "I":
            if turn is not None and turn != last:
                first, last, turns = turn if first is None else first, turn, turns + 1
            if before is not None and before[:1] + was[:1] not in ("su", "ua", "au"):
                illegal += 1
            before = was
        if edit != "D":
            digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
            lines += 1
    gaps = last - first + 1 - turns if first is not None else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit.decode(), digest.hexdigest()
