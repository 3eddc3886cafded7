"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

Letters fall into groups, and a word's vector counts the letters of each group. Adding, deleting or replacing one
letter raises at most one count by one (the surplus) and lowers at most one by one (the deficit). The words hang in a
trie whose levels are the successive counts; a depth-first search follows a vector and leaves its path for one surplus
and one deficit at most. Words at the leaves it reaches are candidates, and each is verified letter by letter.

The trie is distributed: it is cut where a subtree holds few words, each subtree is a block that one task holds at a
time, and the top above the cuts, a bounded table, sends every word to the blocks that the search can reach.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written

#: Letter groups, that is levels of the trie: letters whose code points are equal modulo this.
GROUPS = 24
#: Words under a node of the trie that one task holds; beyond that the node is split at its next level.
BLOCK_WORDS = 5_000
#: Most blocks, whose keys every task gets. Blocks grow with the vocabulary so that there are never more.
MAX_BLOCKS = 100_000
#: A form must be this many times as frequent as its variant.
RATIO = 5
#: Letters at either end by which the words of a leaf are found, and by which a leaf with too many words is parted: one
#: edit leaves one of the two ends of a word as it is, if words have twice as many letters.
ENDS = 3

_HELD = 500_000  # words that a task counts before it passes them on
_LONG = 1 << 20  # texts beyond are scanned run by run

PARTIAL = "word string, n long, n_near long, best struct<rank:long,word:string>"


def vector(word: str) -> tuple[int, ...]:
    """Letters of each group. Counts stop at 255; vectors of near words are no further apart for that."""
    counts = [0] * GROUPS
    for letter in word:
        counts[ord(letter) % GROUPS] += 1
    return tuple(min(c, 255) for c in counts)


def is_near(a: str, b: str) -> bool:
    """Exactly one letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


class Trie:
    """Vectors by their successive counts from ``level`` on; nodes are dicts and leaves what :meth:`add` put there."""

    def __init__(self, level: int = 0) -> None:
        self.level, self.root = level, {}

    def add(self, counts: tuple[int, ...], leaf: object) -> None:
        node = self.root
        for c in counts[self.level : -1]:
            node = node.setdefault(c, {})
        node[counts[-1]] = leaf

    def search(self, counts: tuple[int, ...], surplus: int = 1, deficit: int = 1) -> Iterator[object]:
        """Leaves whose vector has, over all levels, at most ``surplus`` more and ``deficit`` less than ``counts``.

        Leaves may hang at any level.
        """
        stack = [(self.root, self.level, surplus, deficit)]
        while stack:
            node, level, more, less = stack.pop()
            if not isinstance(node, dict):
                yield node
                continue
            c = counts[level]
            if c in node:
                stack.append((node[c], level + 1, more, less))
            if more and c + 1 in node:
                stack.append((node[c + 1], level + 1, more - 1, less))
            if less and c - 1 in node:
                stack.append((node[c - 1], level + 1, more, less - 1))


def _counts(text: str, least: int, start: int, damage: int | None, held: Counter[str]) -> None:
    """Adds the runs of a text to ``held``, the damaged ones as what they became."""
    pattern = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
    found: Iterable[str]
    if len(text) <= _LONG:
        runs = pattern.findall(text)
        held.update(runs)
        found, count = set(runs), runs.count
    else:
        counted = Counter(m.group() for m in pattern.finditer(text))
        held.update(counted)
        found, count = counted, counted.__getitem__
    if not damage:
        return
    crc = zlib.crc32
    for run in [w for w in found if not crc(w.encode(), start) % damage]:
        n, at = count(run), crc(run.encode(), start) % len(run)
        held[run] -= n
        if len(run) > least:
            held[run[:at] + run[at + 1 :]] += n


def vocabulary(docs: DataFrame, least_letters: int = 6, least_count: int = 5, damage: int | None = 199) -> DataFrame:
    """``word, n``: the words of whole texts, A-Z in lower case, with their occurrences.

    ``damage`` plants misspellings: of a run whose crc32 together with its document's id it divides, one letter is left
    out. Null texts have no words, a null ``doc_id`` counts as empty. Each task counts what it reads before the shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                raw, name = text.as_py(), doc_id.as_py()
                if not raw:
                    continue
                start = zlib.crc32(f"{'' if name is None else name}:".encode())
                _counts(raw.lower().decode("utf-8", "replace"), least_letters, start, damage, held)
                if len(held) >= _HELD:
                    yield _counted(held)
                    held.clear()
        if held:
            yield _counted(held)

    counted = docs.select("doc_id", "text").mapInArrow(scan, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _counted(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def _with_vectors(words: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = pa.array([bytes(vector(w)) for w in batch.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=["word", "n", "vector"])

    return words.select("word", "n").mapInArrow(scan, "word string, n long, vector binary")


def blocks(vectors: DataFrame, block_words: int = BLOCK_WORDS) -> list[tuple[bytes, bool]]:
    """Where the trie is cut: the shortest beginnings of vectors that few enough words share, and whether a whole vector
    is still shared by too many.

    At most :data:`MAX_BLOCKS` of them reach the driver: a split node holds more words than ``most``, so a level splits
    fewer than words / ``most`` of them, and ``most`` doubles until the cuts are few enough.
    """
    at = [F.struct(F.lit(k).alias("level"), F.substring("vector", 1, k).alias("prefix")) for k in range(GROUPS + 1)]
    per = vectors.groupBy("vector").agg(F.count(F.lit(1)).alias("words"))
    nodes = cut(per.select(F.explode(F.array(*at)).alias("at"), "words").groupBy("at.level", "at.prefix").agg(F.sum("words").alias("words")))
    most = block_words
    while True:
        # a cut is a node with few words below a node with too many, or a whole vector
        above = nodes.filter((F.col("words") > most) & (F.col("level") < GROUPS)).select((F.col("level") + 1).alias("level"), F.col("prefix").alias("above"))
        found = nodes.withColumn("above", F.substring("prefix", 1, F.col("level") - 1)).join(above, ["level", "above"], "left_semi")
        found = found.unionByName(nodes.filter("level = 0").withColumn("above", F.lit(None).cast("binary")))
        cuts = found.filter((F.col("words") <= most) | (F.col("level") == GROUPS)).select("prefix", (F.col("words") > most).alias("crowded"))
        first = cuts.limit(MAX_BLOCKS + 1).collect()
        if len(first) <= MAX_BLOCKS:
            return sorted((bytes(r.prefix), r.crowded) for r in first)
        most *= 2


def _route(vectors: DataFrame, cuts: list[tuple[bytes, bool]], ends: int = ENDS) -> DataFrame:
    """``block, part, own, word, n, vector``: every word to its own block and to those that may hold words near it.

    Of two blocks one visits the other, by the parity of their numbers, so no block is visited by all around it. Crowded leaves are parted by the first and by the last letters of their words.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(cuts)
    names = ["block", "part", "own", "word", "n", "vector"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: object = Trie()
        for number, (prefix, crowded) in enumerate(shared.value):
            if prefix:
                node = top.root
                for c in prefix[:-1]:
                    node = node.setdefault(c, {})
                node[prefix[-1]] = (number, crowded)
            else:
                top.root = (number, crowded)
        reached: dict[bytes, tuple[int, list[tuple[int, bool]]]] = {}
        for batch in batches:
            rows: list[tuple] = []
            for word, n, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key not in reached:
                    if len(reached) >= 100_000:
                        reached.clear()
                    counts = tuple(key)
                    own = next(top.search(counts, 0, 0))[0]
                    reached[key] = own, [x for x in top.search(counts) if x[0] == own or (own < x[0]) == ((own + x[0]) % 2 == 0)]
                own, found = reached[key]
                for number, crowded in found:
                    for part in ("<" + word[:ends], ">" + word[len(word) - ends :]) if crowded else ("",):
                        rows.append((number, part, number == own, word, n, key))
                if len(rows) >= 8192:
                    yield _batch(rows, names)
                    rows = []
            if rows:
                yield _batch(rows, names)

    return vectors.mapInArrow(scan, "block int, part string, own boolean, word string, n long, vector binary")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"block": pa.int32(), "n": pa.int64(), "n_near": pa.int64(), "vector": pa.binary(), "word": pa.string(), "best": pa.struct([("rank", pa.int64()), ("word", pa.string())])}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k)) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


class _Leaf:
    """Words of one vector with what is known of each: count, near words so far, best one. Words one edit apart share
    their first or their last letters, so a word is compared with those only, and through masks where these are many."""

    FEW, MANY = 3, 64

    def __init__(self, ends: int) -> None:
        self.ends, self.words = ends, []
        self.keyed: dict[str, list[list]] | None = None
        self.masked: dict[str, dict[str, list[list]]] = {}

    def keys(self, word: str) -> tuple[str, str]:
        return "<" + word[: self.ends], ">" + word[len(word) - self.ends :]

    def candidates(self, word: str) -> Iterable[list]:
        if len(self.words) <= self.FEW:
            return self.words
        if self.keyed is None:
            self.keyed = defaultdict(list)
            for entry in self.words:
                for key in self.keys(entry[0]):
                    self.keyed[key].append(entry)
        first, last = self.keys(word)
        found = self._among(first, word)
        return found + [e for e in self._among(last, word) if e[0][: self.ends] != first[1:]]

    def _among(self, key: str, word: str) -> list[list]:
        entries = self.keyed.get(key, [])
        if len(entries) <= self.MANY:
            return entries
        if key not in self.masked:
            index = self.masked[key] = defaultdict(list)
            for entry in entries:
                for mask in set(_masks(entry[0])):
                    index[mask].append(entry)
        index = self.masked[key]
        return list({e[0]: e for mask in set(_masks(word)) for e in index.get(mask, ())}.values())


def _masks(word: str) -> Iterator[str]:
    """What words one edit apart share: the word with a letter masked, and with a gap masked in."""
    for i in range(len(word)):
        yield f"{word[:i]}*{word[i + 1 :]}"
        yield f"{word[:i]}*{word[i:]}"
    yield word + "*"


def _search_block(rows: Iterator[tuple], ends: int) -> Iterator[tuple]:
    """``PARTIAL`` of what meets in a block; its own words come first and are held, the visitors stream by.

    Every pair meets once, so both of its words get their share of it.
    """
    trie, leaves = Trie(), {}
    mine: list[tuple[bytes, list]] = []
    key_now, reached = None, []

    def meet(part: str, entry: list, key: bytes, own: bool) -> None:
        nonlocal key_now, reached
        if key != key_now:
            key_now, reached = key, list(trie.search(tuple(key)))
        word, n = entry[0], entry[1]
        for leaf in reached:
            for other in leaf.candidates(word):
                if own and other[0] <= word or not is_near(word, other[0]):
                    continue
                if part[:1] == ">" and word[:ends] == other[0][:ends]:  # these meet in the part of their first letters too
                    continue
                for x, y in ((entry, other), (other, entry)):
                    x[2] += 1
                    if x[3] is None or (-y[1], y[0]) < x[3]:
                        x[3] = (-y[1], y[0])

    def result(entry: list) -> tuple:
        return entry[0], entry[1], entry[2], {"rank": entry[3][0], "word": entry[3][1]}

    own_part, met = "", False
    for _, part, own, word, n, key in rows:
        entry = [word, n, 0, None]
        if own:
            if key not in leaves:
                leaves[key] = _Leaf(ends)
                trie.add(tuple(key), leaves[key])
            leaves[key].words.append(entry)
            mine.append((key, entry))
            own_part = part
            continue
        if not met:
            for k, e in mine:
                meet(own_part, e, k, True)
            met = True
        meet(part, entry, key, False)
        if entry[2]:
            yield result(entry)
    if not met:
        for k, e in mine:
            meet(own_part, e, k, True)
    yield from (result(e) for _, e in mine if e[2])


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``word, n, n_near, best`` for words (``word, n``, each once) with others one edit apart; ``best`` is the most
    frequent of these, of equals the first by code points.

    A task holds the words of one block at a time; only a crowded leaf's part, words of the same letter groups and the
    same letters at one end, can exceed ``block_words``, or what it has doubled to for a vocabulary of many million.
    """
    vectors = written(_with_vectors(words))
    ends = min(ENDS, (vectors.agg(F.min(F.length("word"))).first()[0] or 0) // 2)
    routed = _route(vectors, blocks(vectors, block_words), ends)
    names = ["word", "n", "n_near", "best"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True))
        out: list[tuple] = []
        for _, block in groupby(rows, key=lambda r: r[:2]):
            for found in _search_block(block, ends):
                out.append(found)
                if len(out) >= 8192:
                    yield _batch(out, names)
                    out = []
        if out:
            yield _batch(out, names)

    placed = routed.repartition("block", "part").sortWithinPartitions("block", "part", F.desc("own"), "vector")
    partial = placed.mapInArrow(scan, PARTIAL)
    return partial.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def group_variants(words: DataFrame, ratio: int = RATIO, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of ``words`` (``word, n``).

    A word's form is its most frequent near word if that is at least ``ratio`` times as frequent; ``root`` is the end of
    the chain of forms. Every step multiplies the count, so chains end, after log steps at most; each round doubles them.
    An empty vocabulary gives no rows.
    """
    words = written(words.select("word", "n"))
    near = near_words(words, block_words).select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.rank")).alias("best_n"))
    is_form = F.col("best_n") >= F.col("n") * ratio
    joined = words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    judged = written(joined)
    chain = judged.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        after = chain.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        longer = written(chain.join(after, F.col("root") == F.col("__at"), "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")))
        chain = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            break
    return judged.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
