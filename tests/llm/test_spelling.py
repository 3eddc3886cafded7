"""Spelling variants against comparisons of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words, ratio=5):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]])
    return out


def counted(docs, least=6, least_count=5):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= least_count}


def words_of(rng, n):
    stems = ["".join(rng.choice("aeinrstéàÿ") for _ in range(rng.randint(6, 9))) for _ in range(n // 6)]
    words = {}
    for _ in range(n):
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 1, 1, 2])):
            i = rng.randint(0, len(w))
            w = rng.choice([w[:i] + rng.choice("aeér") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("insz") + w[i + 1 :]])
        if len(w) >= 6:
            words[w] = rng.choice([5, 6, 7, 25, 30, 35, 150, 900, 5000])
    return words


@pytest.mark.parametrize("block_words", [1, 7, 100, 100_000])
def test_groups(spark, block_words):
    words = words_of(random.Random(block_words), 900)
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumns({"form": F.lit(1), "vector": F.lit("x")})
    got = {r.word: tuple(r)[1:] for r in spelling.group_variants(df, block_words=block_words).collect()}
    assert got == grouped(words)


def test_anagrams_in_a_crowded_leaf(spark):
    rng = random.Random(1)
    words = {"".join(rng.sample("abcdefgh", 8)): rng.choice([5, 50, 500]) for _ in range(400)}
    words |= {w[:i] + w[i + 1 :]: 7 for w in list(words)[:40] for i in (0, 4, 7)} | {w[:2] + "z" + w[3:]: 900 for w in list(words)[:40]}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    for block_words in (3, 1000):
        got = {r.word: tuple(r)[1:] for r in spelling.group_variants(df, block_words=block_words).collect()}
        assert got == grouped(words)


def test_many_words_at_both_ends():
    entries = [f"abc{a}{b}xyz" for a in "aeiourst" for b in "aeiourst" if a != b]
    leaf = spelling._Leaf(3)
    leaf.words = [[w, 1, 0, None] for w in entries]
    for few, many in ((3, 5), (1000, 64), (0, 1000)):
        leaf.FEW, leaf.MANY, leaf.keyed, leaf.masked = few, many, None, {}
        for w in (*entries, "abcaaxyz", "abcaxyz", "abcaeixyz"):
            assert {e[0] for e in leaf.candidates(w) if spelling.is_near(w, e[0])} == {x for x in entries if one_edit(w, x)}


@settings(max_examples=400, deadline=None)
@given(st.text("abé", max_size=7), st.text("abé", max_size=7))
def test_near_and_vectors(a, b):
    assert spelling.is_near(a, b) == one_edit(a, b)
    if one_edit(a, b):
        trie = spelling.Trie()
        trie.add(spelling.vector(a), a)
        assert list(trie.search(spelling.vector(b))) == [a]


def test_vocabulary_of_odd_texts(spark, odd):
    long = ("Vielgebrauchte Wörter " * 60_000) + "Straßenbahnén " * 7
    docs = [(None, "letters letters LETTERS letters letters"), (1, None), (2, ""), (3, long), (4, "x" * 300_000 + " " + "y" * 5), (4, "Ünter ünter ÜNTERS×÷ ÜNTERS×÷ ÜNTERS×÷ ÜNTERS×÷ ÜNTERS×÷")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("z")})
    assert {r.word: r.n for r in spelling.vocabulary(df).collect()} == counted(docs)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {r.word: r.n for r in spelling.vocabulary(odd).collect()} == counted(rows)
    assert spelling.group_variants(spelling.vocabulary(df.limit(0))).collect() == []


def test_damage_hits_every_occurrence(spark):
    docs = [(i, " ".join(f"wort{chr(97 + i % 26)}{chr(97 + j)}nde" for j in range(26)) * 3) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = counted(docs, least_count=1)
    assert {r.word: r.n for r in spelling.vocabulary(df, least_count=1).collect()} == want
    spelling._LONG, kept = 10, spelling._LONG
    try:
        held = Counter()
        for i, text in docs:
            spelling._counts(text, 6, zlib.crc32(f"{i}:".encode()), 199, held)
        assert {w: n for w, n in held.items() if n} == want
    finally:
        spelling._LONG = kept
