"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A text longer than a chunk is encoded in overlapping chunks with offsets, and neighbours are spliced at a boundary
that both have and that is stable by proof: the pre-tokenizer cuts a text into pieces from left to right, looks
ahead by two characters at most, and merges never cross pieces. So a piece of the left chunk that ends two
characters or more before the chunk's end is a piece of the whole text, and if the right chunk starts a piece at the
same place, both agree from there on. Where an overlap holds no such place, it is doubled; one endless piece ends up
whole in one chunk.

The byte-level vocabulary has a twin list of ranks, which tiktoken encodes several times as fast as tokenizers, with
the same tokens; the tests hold both against each other, over every code point too.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 16_384
OVERLAP = 256
LIMIT = 1024
LOOK_AHEAD = 2


def _path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else str(public_tokenizers.path(name))


@cache
def _library(name: str):
    """The tokenizers library's own tokenizer, without truncation and padding."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(_path(name))
    found.no_truncation()
    found.no_padding()
    return found


@cache
def _ranked(name: str):
    """For a byte-level vocabulary with ranks beside it: encoding, bytes of each token, piece pattern, special strings."""
    import public_tokenizers
    import regex
    import tiktoken

    if not name.endswith("byte_bpe_50k.json"):
        return None
    with open(_path(name).removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = tuple(t.content for t in _library(name).get_added_tokens_decoder().values())
    return encoding, sizes, regex.compile(public_tokenizers.PATTERN), special


class Chunk(NamedTuple):
    """``text[low:high]`` encoded: where tokens start (characters of the whole text, ascending), and where pieces do."""

    low: int
    high: int
    tokens: np.ndarray
    pieces: np.ndarray

    def count(self, begin: int, end: int) -> int:
        """Tokens from ``begin`` up to ``end``."""
        return int(np.searchsorted(self.tokens, end) - np.searchsorted(self.tokens, begin))

    def stable(self) -> np.ndarray:
        """Starts of pieces that are pieces of the whole text too, if the chunk is in step at its beginning."""
        return self.pieces[:-1][self.pieces[1:] <= self.high - LOOK_AHEAD]


def splice_count(text: str, encode: Callable[[int, int], Chunk], chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a whole text, from encoded chunks of it."""
    total, at, left = 0, 0, encode(0, min(chunk, len(text)))
    while left.high < len(text):
        wide = overlap
        while True:
            low = max(at, left.high - wide)
            right = encode(low, min(len(text), low + max(chunk, 2 * wide)))
            both = np.intersect1d(left.stable(), right.pieces, assume_unique=True)
            both = both[both > at]
            if len(both) or low == at:
                break
            wide *= 2
        if len(both):
            total += left.count(at, int(both[-1]))
            at = int(both[-1])
        left = right  # without a boundary, the right chunk starts at the last splice and reaches further
    return total + left.count(at, len(text))


def counter(name: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Callable[[str], int]:
    """A function from a text to its number of tokens under the vocabulary file ``name`` (.json or .model)."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=_path(name))
        return lambda text: len(model.encode(text, num_threads=1))  # it normalises whole texts: never cut
    ranked = _ranked(name)
    if ranked is None:
        library = _library(name)
        return lambda text: len(library.encode(text, add_special_tokens=False).ids)
    encoding, sizes, pattern, special = ranked

    def chunks(text: str) -> Callable[[int, int], Chunk]:
        def encode(low: int, high: int) -> Chunk:
            part = text[low:high]
            starts = np.cumsum(sizes[encoding.encode_ordinary(part)])  # in bytes, of the tokens after the first
            starts = np.concatenate(([0], starts[:-1]))
            if not part.isascii():
                first = (np.frombuffer(part.encode(), np.uint8) & 0xC0) != 0x80  # bytes that begin a character
                starts = np.cumsum(first)[starts] - 1
            pieces = np.fromiter((m.start() for m in pattern.finditer(part)), np.int64)
            return Chunk(low, high, starts + low, np.append(pieces, len(part)) + low)

        return encode

    def count(text: str) -> int:
        parts, extra = [text], 0
        for token in special:  # inside a text such a string is one token and parts the text
            if token in text:
                extra += text.count(token)
                parts = [p for part in parts for p in part.split(token)]
        return extra + sum(len(encoding.encode_ordinary(p)) if len(p) <= chunk else splice_count(p, chunks(p), chunk, overlap) for p in parts)

    return count


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, in one narrow pass.

    Counts are those of the vocabulary's own library, without added special tokens; a special string inside a text
    is the special token, as by default. A null or empty text has none. Repeated rows are repeated.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, chunk, overlap)
        for batch in batches:
            sizes, counts = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                sizes.append(len(text.encode()))
                counts.append(count(text))
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
