"""Secret scan: fixed credential patterns plus sliding-window entropy.

Base kinds (leftmost, non-overlapping per kind, failing matches dropped): assign, a credential name with a value of
six characters or more; access, ``AKIA`` identifiers of 20 or more; hex, 24 or more lower-case hexadecimal digits.
The method adds the kind ``entropy``: over every maximal run of each character class in a candidate string a window
slides by one character, its Shannon entropy is kept up to date from the counts of the character that leaves and the one
that enters, and the stretch of windows above the class's threshold is reported, unless an allow-list pattern explains
the run or the stretch. Stretches of several classes that overlap are one span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "entropy")
_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{24,}")  # a run's match starts where the run starts, so the length can be asked for at once
SHORTEST = 24
_candidate = re.compile(r"[A-Za-z0-9+/_=-]{24,}")

#: Runs, window width and least entropy in bits per character class: digits of base 16, letters of one case (which
#: one in three strings of nine English words reaches too), letters and digits, base 64
#: with ``=`` as padding only (what stands behind a name and ``=``), base 64 with all that is glued to it.
CLASSES = {
    "hex": (re.compile(r"[0-9A-Fa-f]{24,}"), 24, 3.0),
    "letters": (re.compile(r"[a-z]{32,}|[A-Z]{32,}"), 24, 3.8),
    "alnum": (re.compile(r"[A-Za-z0-9]{24,}"), 24, 3.9),
    "value": (re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}"), 24, 4.1),
    "base64": (re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 4.1),
}
#: Words that mark what they are glued to, without a separator, as no secret.
PLACEHOLDER = re.compile(r"EXAMPLE|example")
#: Fillers that are no part of a secret: what stands before and behind them is judged by itself.
FILLER = re.compile(r"placeholder|PLACEHOLDER|x{6,}|X{6,}")
_letters_digits = re.compile(r"[A-Za-z0-9]+")
#: Strings that look random and are not secret: one case only without digits (words, names) of under 32 letters, dates,
#: UUIDs, paths of words.
ALLOWED = (
    re.compile(r"[A-Z]?[a-z]{1,31}\Z|[A-Z]{1,32}\Z"),
    re.compile(r"[0-9_-]+\Z"),
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z"),
    re.compile(r"(?:[A-Z]?[a-z]{1,31}|[A-Z]{1,32}|[0-9]{1,4})(?:[/_=-]+(?:[A-Z]?[a-z]{1,31}|[A-Z]{1,32}|[0-9]{1,4}))*[/_=-]*\Z"),
)


def hot_stretches(text: str, width: int, least: float) -> list[tuple[int, int]]:
    """Maximal stretches covered by windows of ``width`` characters whose entropy is ``least`` bits or more.

    The entropy of a window is ``log2(w) - S / w`` with ``S`` the sum of ``c * log2(c)`` over its counts ``c``; moving
    by one character changes two terms.
    """
    if len(text) < width:
        return []
    term = [0.0, *(c * log2(c) for c in range(1, width + 1))]
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, char in enumerate(text):
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += term[c + 1] - term[c]
        if i >= width:
            old = text[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - term[c]
        if i >= width - 1 and log2(width) - total / width >= least - 1e-9:
            start = i - width + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def allowed(text: str) -> bool:
    return any(p.match(text) for p in ALLOWED)


def parts_between(candidate: str) -> list[tuple[int, str]]:
    """The parts of a candidate between fillers, each with its place."""
    found = [(m.start(), m.end()) for m in FILLER.finditer(candidate)]
    starts, ends = [0, *(b for _, b in found)], [*(a for a, _ in found), len(candidate)]
    return [(a, candidate[a:b]) for a, b in zip(starts, ends, strict=True) if b - a >= SHORTEST]


def _marked_pieces(candidate: str) -> tuple[list[int], list[int], list[int]]:
    """Where the runs of letters and digits begin and end, and how many before each hold a placeholder; none without one."""
    if not PLACEHOLDER.search(candidate):
        return [], [], [0]
    pieces = [m.span() for m in _letters_digits.finditer(candidate)]
    marks = [PLACEHOLDER.search(candidate, a, b) is not None for a, b in pieces]
    return [a for a, _ in pieces], [b for _, b in pieces], [0, *accumulate(marks)]


def random_stretches(candidate: str) -> list[tuple[int, int]]:
    """The hot stretches of the runs of every class, merged where they overlap.

    A run that is a UUID or a path of words as a whole is allowed with all that it holds; a word such as ``example``
    explains only the stretch it stands in, widened to whole runs of letters and digits.
    """
    if allowed(candidate):
        return []
    found = []
    starts, ends, marked = _marked_pieces(candidate)
    for runs, width, least in CLASSES.values():
        for run in runs.finditer(candidate):
            if allowed(run.group()):
                continue
            for a, b in hot_stretches(run.group(), width, least):
                a, b = run.start() + a, run.start() + b
                first, last = bisect_right(ends, a), bisect_left(starts, b)  # the runs of letters and digits that it touches
                if marked[first] == marked[max(first, last)]:
                    found.append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans per kind, in code points, end exclusive. None counts as empty."""
    text = text or ""
    spans = {
        "assign": [m.span() for m in _assign.finditer(text) if len(m.group(2)) >= 6],
        "access": [m.span() for m in _access.finditer(text) if m.end() - m.start() >= 20],
        "hex": [m.span() for m in _hex.finditer(text)],
        "entropy": [],
    }
    for m in _candidate.finditer(text):
        for at, part in parts_between(m.group()):
            spans["entropy"] += [(m.start() + at + a, m.start() + at + b) for a, b in random_stretches(part)]
    return spans


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then kind in the order given."""
    found = sorted((a, i, b) for i, k in enumerate(kinds) for a, b in spans[k])
    return ",".join(f"{kinds[i]}:{a}:{b}" for a, i, b in found)


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans`` for every row, in one narrow pass.

    A null or empty text has no span; repeated rows are repeated.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digest, spans = [], []
            for text in batch.column(1):
                found = find(text.as_py())
                for i, kind in enumerate(KINDS):
                    counts[i].append(len(found[kind]))
                digest.append(hashlib.sha256(joined(found, BASE).encode()).hexdigest())
                spans.append(joined(found, KINDS))
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)
