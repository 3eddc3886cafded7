"""Benchmark decontamination by spaced seeds.

A mask names the token offsets that count; the offsets it skips may differ. The masked tokens at every position of
every test item and every document are hashed, equal hashes are joined, each item's rarer ones first, and around each hit
the item is laid over the document along the hit's diagonal. A document leaks an item if enough of the item's tokens agree there, counted
together with those of near diagonals (words put in or left out), or if a long stretch of it does.
Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, unused, written

#: Token offsets that each mask keeps. A substitution at a skipped offset leaves the hash as it is. Agreement that holds
#: none of the three (no 111, 1101 or 1011) is at most every second token plus one or two at the ends, which is below
#: ``OVERLAP`` and ``LEAST`` for every length: each pair that meets them shares a seed.
MASKS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
SPAN = 4
#: Share of an item's tokens that must agree on one diagonal, and the least number of them.
OVERLAP = 0.6
LEAST = 8
#: Diagonals that are added up, to either side, and the stretch that leaks an item of any length: ``STRETCH`` of
#: ``WITHIN`` tokens in a row agree.
SHIFT = 8
STRETCH, WITHIN = 13, 16
#: Most seeds of the test items that are broadcast; more are joined by shuffle.
MAX_BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def seeds(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, pos, seed`` for each mask at each position of ``toks`` where the whole span fits.

    The tokens are hashed once; copies of the hash array, each shifted by an offset, are zipped and unrolled, so a
    row holds the few numbers that the masks need and never the document.
    """
    offsets = sorted({o for m in MASKS for o in m})
    hashed = df.select(*keys, F.transform("toks", lambda t: F.xxhash64(t)).alias("h")).filter(F.size("h") >= SPAN)
    n = F.size("h") - SPAN + 1
    zipped = F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("pos"), *[F.slice("h", o + 1, n).alias(f"h{o}") for o in offsets])
    rows = hashed.select(*keys, F.inline(zipped))
    each = F.array(*[F.xxhash64(F.lit(i), *[F.col(f"h{o}") for o in mask]) for i, mask in enumerate(MASKS)])
    return rows.select(*keys, "pos", F.explode(each).alias("seed"))


def fewest_hits(n: Column, overlap: float = OVERLAP) -> Column:
    """Places of an item of ``n`` tokens, an offset and a mask each, that an agreement of a share above one half hits at least,
    and a stretch more than ``STRETCH``. On one diagonal every hit takes another place."""
    return F.least(n * (2 * overlap - 1) - 2 - 1e-6, F.lit(float(STRETCH)))


def hits_of(met: DataFrame, item_seeds: DataFrame, sizes: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """``doc_id, text_hash, item_id, pos, item_pos``: the hits of all pairs that may leak, the rare seeds first.

    ``met`` has the documents' seeds that some item has (``doc_id, text_hash, pos, seed``). A leak hits :func:`fewest_hits`
    places of its item or more, so it hits one outside any smaller choice of them: the item's most frequent seeds, as long
    as they take fewer places, make no candidates. What all documents and items say in common falls under these, and is
    looked up for the pairs that met otherwise alone.
    """
    spot = ["doc_id", "text_hash", "item_id"]
    frequency = met.groupBy("seed").agg(F.count(F.lit(1)).alias("met"))
    per = item_seeds.groupBy("item_id", "seed").agg(F.count(F.lit(1)).alias("places")).join(frequency, "seed").join(sizes, "item_id")
    upto = Window.partitionBy("item_id").orderBy(F.desc("met"), "seed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frequent = per.withColumn("upto", F.sum("places").over(upto)).filter(F.col("upto") <= F.ceil(fewest_hits(F.col("n"), overlap)) - 1)
    frequent = small(cut(frequent.select("item_id", "seed")), MAX_BROADCAST_SEEDS)
    rare = small(cut(item_seeds.join(frequent, ["item_id", "seed"], "left_anti")), MAX_BROADCAST_SEEDS)
    first = written(met.join(rare, "seed").select(*spot, "pos", "item_pos"))
    asked = first.select(*spot).distinct().join(item_seeds.join(frequent, ["item_id", "seed"], "left_semi"), "item_id")
    again = met.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("seed").alias("s"), "pos")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("seed") == F.col("s"))
    return first.unionByName(asked.join(again, same).select(*spot, "pos", "item_pos"))


def _judged(docs: DataFrame, benchmark: DataFrame, overlap: float, least: int) -> DataFrame:
    """The places that leak, with the ``text_hash`` of the document's row."""
    items = benchmark.select("item_id", tokens(F.col("text")).alias("toks")).filter(F.size("toks") >= SPAN).distinct()
    item_seeds = cut(seeds(items, ["item_id"]).select("item_id", F.col("pos").alias("item_pos"), "seed"))
    values = small(cut(item_seeds.select("seed").distinct()), MAX_BROADCAST_SEEDS)
    sizes = small(cut(items.groupBy("item_id").agg(F.min(F.size("toks")).alias("n"))))
    text_hash = F.xxhash64("text")
    mine = docs.select("doc_id", text_hash.alias("text_hash"), tokens(F.col("text")).alias("toks"))
    # A row for each seed of a document that any item has, however many have it: the texts are read once for all that follows.
    met = written(seeds(mine, ["doc_id", "text_hash"]).join(values, "seed").select("doc_id", "text_hash", "pos", "seed"))
    # Diagonals of all hits: the few places where an item may lie over a document.
    spot = ["doc_id", "text_hash", "item_id"]
    places = hits_of(met, item_seeds, sizes, overlap).groupBy(*spot, (F.col("pos") - F.col("item_pos")).alias("doc_start")).agg(F.count(F.lit(1)).alias("hits"))
    near = Window.partitionBy(*spot).orderBy("doc_start").rangeBetween(-SHIFT, SHIFT)
    places = places.withColumn("around", F.sum("hits").over(near)).join(sizes, "item_id").filter(F.col("around") >= fewest_hits(F.col("n"), overlap))
    places = cut(places.select(*spot, "doc_start"))
    found = small(places.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct())
    suspects = docs.select("doc_id", "text", text_hash.alias("text_hash")).join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi")
    suspects = suspects.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", tokens(F.col("text")).alias("doc_toks"))
    # The tokens travel once per document and item; its diagonals are unrolled where they are compared.
    pairs = places.groupBy(*spot).agg(F.collect_list("doc_start").alias("starts"))
    same = pairs["doc_id"].eqNullSafe(suspects["doc_id"]) & (pairs["text_hash"] == suspects["text_hash"])
    laid = pairs.join(suspects, same).drop(suspects["doc_id"]).drop(suspects["text_hash"])
    laid = laid.join(items.withColumnRenamed("toks", "item_toks"), "item_id").withColumn("doc_start", F.explode("starts")).drop("starts")
    under = F.slice("doc_toks", F.greatest(F.col("doc_start"), F.lit(0)) + 1, F.size("item_toks") + F.least(F.col("doc_start"), F.lit(0)))
    over = F.slice("item_toks", F.greatest(-F.col("doc_start"), F.lit(0)) + 1, F.size("item_toks"))
    skipped = F.greatest(-F.col("doc_start"), F.lit(0))
    same_at = F.zip_with(under, over, lambda a, b: a == b)
    agree = F.filter(F.transform(same_at, lambda x, i: F.when(x, i + skipped)), lambda x: x.isNotNull())
    judged = laid.select(*spot, "doc_start", F.xxhash64("item_toks").alias("item_hash"), F.size("item_toks").alias("item_tokens"), agree.alias("at"))
    near = Window.partitionBy(*spot, "item_hash").orderBy("doc_start").rangeBetween(-SHIFT, SHIFT)
    judged = judged.withColumn("all_at", F.array_sort(F.array_distinct(F.flatten(F.collect_list("at").over(near)))))
    total = F.size("all_at")
    ends = F.sequence(F.lit(STRETCH), F.greatest(total, F.lit(STRETCH)))
    dense = F.exists(ends, lambda e: F.get("all_at", e - 1) - F.get("all_at", e - STRETCH) < WITHIN)
    enough = (total / F.col("item_tokens") >= overlap) & (total >= least)
    judged = judged.filter(enough | ((total >= STRETCH) & dense)).withColumn("matched", F.size("at"))
    return judged.withColumn("overlap", F.col("matched") / F.col("item_tokens"))


def leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, least: int = LEAST) -> DataFrame:
    """One row per leaked pair: ``doc_id, item_id, doc_start, item_tokens, matched, overlap``.

    ``doc_start`` is the token of the document under the item's first token (below 0 if the item begins before the
    text), ``matched`` the agreeing tokens on the best diagonal and ``overlap`` their share of the item. A pair is
    reported if, on a diagonal and its neighbours within ``SHIFT`` that were hit, the agreeing tokens of the item are
    ``overlap`` of it and ``least`` or more, or ``STRETCH`` of some ``WITHIN`` in a row; ``matched`` and ``overlap`` of
    one diagonal may then be lower. Parts that are added up must hit as many places of the item as :func:`fewest_hits` says. A null or empty text has no token, so it leaks
    nothing and is leaked nowhere; items of fewer than ``least`` tokens are never reported. Rows
    that repeat an id are judged by their own texts and reported once per id and item; null ids of documents are
    reported as null, items without an id never. Either table may be empty.
    """
    judged = _judged(docs, benchmark, overlap, least)
    best = F.max(F.struct("matched", (-F.col("doc_start")).alias("back"), "item_tokens", "overlap")).alias("best")
    return judged.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.back")).alias("doc_start"), "best.item_tokens", "best.matched", "best.overlap")


def clean_documents(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` whose own text leaks nothing, whatever other rows of their id (or without one) hold, with all
    their columns, whatever their names.
    """
    of_doc, of_text = unused(docs, "__bad", "__hash")
    bad = _judged(docs, benchmark, overlap, least).select(F.col("doc_id").alias(of_doc), F.col("text_hash").alias(of_text)).distinct()
    return docs.join(small(cut(bad)), F.col("doc_id").eqNullSafe(F.col(of_doc)) & (F.xxhash64("text") == F.col(of_text)), "left_anti")
