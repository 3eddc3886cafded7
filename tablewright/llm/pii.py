"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, digits, plus signs, schemes and identifier cues, the
last two in any mixture of cases.
From each anchor a small deterministic parser reads left and right to the boundary of the candidate and validates
it. Parsers never look beyond the run of characters that a kind may hold.

The base kinds have the spans of these patterns, leftmost and non-overlapping per kind, failing matches dropped:
email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip four dotted numbers up to 255; card 13 to 19 digits
with single blanks or hyphens between, passing Luhn; phone ``+`` and 9 to 15 digits. Cues add the kinds iban (after
"IBAN", check digits valid), account (8 to 18 digits after an account cue) and login (``scheme://user:secret@host``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOCAL = frozenset(LETTERS + DIGITS + "._%+-")
LABEL = frozenset(LETTERS + DIGITS + "-")
DIGIT = frozenset(DIGITS)
PHONE = frozenset(DIGITS + " ().-")
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "account", "login")
KINDS = BASE + ADDED
IBAN_CUES = ("iban",)
ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")

_iban = re.compile(r"[\x20:=#.-]{1,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_account = re.compile(r"(?:\x20(?:number|no\.?|nr\.?|num\.?))?[\x20:=#]{1,3}([0-9](?:[\x20-]?[0-9]){7,17})(?![0-9A-Za-z])", re.IGNORECASE | re.ASCII)
_login = re.compile(r"[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+,;=-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")

SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, n_iban long, n_account long, n_login long, base_sha256 string, spans string"


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in DIGITS:
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, cues in (("iban", IBAN_CUES), ("account", ACCOUNT_CUES), ("login", SCHEMES)):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _run(text: str, at: int, of: frozenset) -> int:
    """The end of the run of characters of ``of`` from ``at`` on."""
    while at < len(text) and text[at] in of:
        at += 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Around the at-sign at ``at``: the local part leftwards, not past ``floor``, and two or more labels."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == "." and (to := _run(text, end + 1, LABEL)) > end + 1:
        end, labels = to, labels + 1
    return (start, end) if labels > 1 else None


def _ip(text: str, start: int) -> tuple[int, list[str]] | None:
    """Four dotted numbers from ``start``, where a run of digits begins."""
    parts, at = [], start
    for i in range(4):
        if i:
            if at >= len(text) or text[at] != ".":
                return None
            at += 1
        if (to := _run(text, at, DIGIT)) == at:
            return None
        parts.append(text[at:to])
        at = to
    return at, parts


def _card(text: str, start: int) -> int:
    """The end of digits from ``start`` on, single blanks or hyphens between them."""
    at = start + 1
    while at < len(text):
        if text[at] in DIGIT:
            at += 1
        elif text[at] in " -" and at + 1 < len(text) and text[at + 1] in DIGIT:
            at += 2
        else:
            break
    return at


def _phone(text: str, start: int) -> int | None:
    """The end of a number whose plus sign is at ``start``: up to the last digit of its run."""
    if start + 1 >= len(text) or text[start + 1] not in DIGIT:
        return None
    at = _run(text, start + 2, PHONE)
    while at > start and text[at - 1] not in DIGIT:
        at -= 1
    return at if at >= start + 4 else None


def _iban_ok(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans per kind, in code points, end exclusive. None counts as empty."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    text = text or ""
    mail_end = ip_end = card_end = phone_end = 0  # behind the last match of the kind, dropped ones too
    ip_run = -1  # the run of digits last tried as the start of an ip
    folded = text.replace("\u0130", "I").lower()  # the one letter that lower() makes longer goes first, so places agree
    for last, (kind, length) in _automaton().iter(folded):
        start = last - length + 1
        if kind == "digit":
            if start >= card_end:
                card_end = _card(text, start)
                digits = [c for c in text[start:card_end] if c in DIGIT]
                if 13 <= len(digits) <= 19 and luhn("".join(digits)):
                    spans["card"].append((start, card_end))
            if start >= ip_end and start > ip_run:
                ip_run = _run(text, start, DIGIT) - 1
                if (ip := _ip(text, start)) is not None:
                    ip_end = ip[0]
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in ip[1]):
                        spans["ip"].append((start, ip_end))
        elif kind == "at":
            if start >= mail_end and (span := _email(text, start, mail_end)):
                spans["email"].append(span)
                mail_end = span[1]
        elif kind == "plus":
            if start >= phone_end and (end := _phone(text, start)) is not None:
                phone_end = end
                if 9 <= sum(c in DIGIT for c in text[start:end]) <= 15:
                    spans["phone"].append((start, end))
        elif kind == "login":
            if m := _login.match(text, last + 1):
                spans["login"].append((start, m.end()))
        elif start == 0 or not text[start - 1].isalnum():
            if kind == "iban" and (m := _iban.match(text, last + 1)):
                value = m.group(1)
                while value and not _iban_ok(value) and " " in value:  # words in capitals may follow the number
                    value = value.rpartition(" ")[0]
                if _iban_ok(value):
                    spans["iban"].append((m.start(1), m.start(1) + len(value)))
            elif kind == "account" and (m := _account.match(text, last + 1)):
                spans["account"].append(m.span(1))
    return spans


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(spans[k]))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``SCHEMA`` for every row of ``docs``, in one narrow pass.

    ``base_sha256`` digests the base spans as ``kind:start:end`` by kind, then start; ``spans`` lists all. A null or
    empty text has no span; repeated rows are repeated.
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
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {SCHEMA}")
