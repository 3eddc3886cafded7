"""Chat formatting in budgeted windows.

The turns of a conversation become training windows of at most ``budget`` tokens, cut only between turns. Running sums
of turn tokens give each window its span: the system turn at its head, as much of the latest history as ``history``
tokens hold, repeated and not trained on, then new turns while they fit. Every assistant turn is new in exactly one
window and is its target there; a repeated one is masked. A turn longer than the budget has a window of its own.

A window's text is ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Control strings inside roles and texts are
escaped by a backslash after ``<``, which :func:`unescape` takes out again.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
BUDGET = 1024
HISTORY = 256
TOKENIZER = "byte_bpe_50k.json"
_opening = re.compile(r"<(\\*)\|")
_escaped = re.compile(r"<\\(\\*)\|")

WINDOW_SCHEMA = "window int, text string, loss array<struct<start:int,end:int>>, new_from int, n_tokens int, n_new int, over_budget boolean"
DIGEST_SCHEMA = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def escape(text: str) -> str:
    """No ``<|`` is left: each gets one more backslash than it had."""
    return _opening.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"<\1|", text)


def _role_in(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _role_out(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def _pieces(role: str, text: str) -> tuple[str, str, str]:
    return f"{START}{_role_in(role)}\n", escape(text), f"{END}\n"


def windows(turns: Iterable[tuple[str, str]], count, budget: int = BUDGET, history: int = HISTORY) -> Iterator[tuple]:
    """Rows of ``WINDOW_SCHEMA`` for one conversation's turns (role, text) in order."""
    return _windows(((role, text, count("".join(_pieces(role, text)))) for role, text in turns), budget, history)


def _windows(turns: Iterable[tuple[str, str, int]], budget: int, history: int) -> Iterator[tuple]:
    """:func:`windows` of turns with their tokens, read once: held are the system turn, the latest ``history`` tokens
    and the window that is being filled."""
    lead: list[tuple] = []
    tail: deque[tuple] = deque()  # the latest turns of at most ``history`` tokens before the window's new ones
    held = number = 0
    back: list[tuple] = []
    new: list[tuple] = []
    filled = head = 0
    for i, (role, text, size) in enumerate(turns):
        turn = (*_pieces(role, text), role, size)
        if i == 0 and role == "system":
            lead, head = [turn], size
            continue
        if new and filled + size > budget:
            yield _window(number, lead, back, new, filled, budget)
            number += 1
            for old in new:
                tail.append(old)
                held += old[4]
                while tail and held > history:
                    held -= tail.popleft()[4]
            new = []
        if not new:  # history gives way to the new turn
            back, filled = list(tail), head + held + size
            drop = 0
            while drop < len(back) and filled > budget:
                filled -= back[drop][4]
                drop += 1
            back = back[drop:]
        else:
            filled += size
        new.append(turn)
    if new or lead and not number:
        yield _window(number, lead, back, new, filled if new else head, budget)


def _window(number: int, lead: list[tuple], back: list[tuple], new: list[tuple], tokens: int, budget: int) -> tuple:
    text, loss, at, new_from = [], [], 0, 0
    fresh = [number == 0] * len(lead) + [False] * len(back) + [True] * len(new)
    for is_new, (opening, body, closing, role, _) in zip(fresh, (*lead, *back, *new), strict=True):
        if not is_new:
            new_from = at + len(opening) + len(body) + len(closing)
        elif role == "assistant":
            loss.append((at + len(opening), at + len(opening) + len(body)))
        text += (opening, body, closing)
        at += len(opening) + len(body) + len(closing)
    return number, "".join(text), loss, new_from, tokens, len(new) + len(lead) * (number == 0), tokens > budget


def parse(text: str) -> Iterator[tuple[str, str]]:
    """The turns of formatted text."""
    at = 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(END, line)
        yield _role_out(text[at + len(START) : line]), unescape(text[line + 1 : end])
        at = end + len(END) + 1


def _turns_in_order(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Whole conversations in a partition, turns in order; ties by role and text, so every run agrees.

    Tokens are counted before the shuffle, so a long conversation's turns are counted by many tasks.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import counter

        count = counter(tokenizer)
        for batch in batches:
            found = [count("".join(_pieces(r.as_py(), t.as_py()))) for r, t in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "size"])

    counted = rows.mapInArrow(sizes, T.StructType([*rows.schema.fields, T.StructField("size", T.LongType())]))
    return counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple[str, str, int]]]]:
    """Conversations one at a time, from sorted rows; their turns are read as they are asked for."""
    rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True))
    for conv, turns in groupby(rows, key=itemgetter(0)):
        yield conv, (turn[1:] for turn in turns)


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str = TOKENIZER) -> DataFrame:
    """``conv_id`` and ``WINDOW_SCHEMA``: the windows of every conversation, in order within their partition.

    Null texts and roles count as empty; rows with a null ``conv_id`` form one conversation, a null turn comes first,
    and repeated rows are turns of their own. Other columns are dropped. A task
    formats one conversation at a time and holds none of it but the window, its history and the system turn.
    """
    kind = conversations.schema["conv_id"].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for conv, turns in _conversations(batches):
            for window in _windows(turns, budget, history):
                rows.append((conv, *window))
                if len(rows) == 256:
                    yield _batch(rows, fields)
                    rows = []
        if rows:
            yield _batch(rows, fields)

    fields = ["conv_id", *(f.name for f in T._parse_datatype_string(WINDOW_SCHEMA).fields)]
    return _turns_in_order(conversations, tokenizer).mapInArrow(scan, T.StructType([T.StructField("conv_id", kind), *T._parse_datatype_string(WINDOW_SCHEMA).fields]))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = dict(zip(names, zip(*rows, strict=True), strict=True))
    ints = {"window", "new_from", "n_tokens", "n_new"}
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    arrays = [
        pa.array([[{"start": a, "end": b} for a, b in x] for x in v], pair) if k == "loss" else pa.array(v, pa.int32() if k in ints else None)
        for k, v in columns.items()
    ]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id`` and ``DIGEST_SCHEMA``, parsed from the windows of :func:`format_windows` in their order.

    New turns are read behind ``new_from``; the text under the loss spans is unescaped.
    """
    kind = formatted.schema["conv_id"].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        current, state, rows = None, None, []

        def close() -> None:
            rows.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        for batch in batches:
            for conv, text, loss, new_from in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3)), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        close()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body in parse(text[new_from:]):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
                state[5] += 1
            if len(rows) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
                rows = []
        if state is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    schema = T.StructType([T.StructField("conv_id", kind), *T._parse_datatype_string(DIGEST_SCHEMA).fields])
    return formatted.select("conv_id", "text", "loss", "new_from").mapInArrow(scan, schema)
