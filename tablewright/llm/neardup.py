"""Near-duplicate groups by b-bit MinHash.

1. ``features`` reads each text once: distinct word shingles, ``BANDS * ROWS`` minima, a key per band of full minima,
   and a signature of the low ``BITS`` bits of every minimum, packed.
2. Band buckets with two different sets or more tie their members to the bucket's smallest one. The connected
   components of these ties are candidate clusters: no two sets of different clusters share a bucket. Ties are linear in
   the rows, so a bucket of thousands makes thousands of rows, not their square.
3. Equal sets collapse into one class. Within a cluster, pairs whose collision-corrected similarity, estimated from the
   signatures by counting equal bits, may reach the threshold are confirmed on the full sets, and a task emits only which
   classes its links connect. Clusters beyond a block's size are dealt out in blocks, each with a few well connected
   pivots, which joins groups of true copies.
4. What such a cluster has not joined then meets by prefixes: with the shingles of every set in one order, those that most
   sets of the cluster hold last, two sets of the wanted similarity share one of their first few, at places that leave
   room for the shared rest. Pages of one template or section, far from each other, share none there and cost nothing more. Pairs that pass the estimate are
   confirmed on the full sets. So no link of a cluster is lost, in bounded tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, cut, small, together, unused, written

WORDS = 5
PERCENT = 80
BANDS = 40
ROWS = 5
BITS = 4
#: Rejections by the estimate lie this many standard errors below the threshold.
SIGMAS = 5.5
#: Most classes, and most shingles, of one block.
BLOCK = 256
BLOCK_SHINGLES = 1 << 19
PIVOTS = 16
#: Most shared bands, two numbers each, that are broadcast; more are joined by shuffle.
MAX_BROADCAST_BANDS = 500_000
HASHES = BANDS * ROWS

_random = np.random.default_rng(20_240_601)
_A = (_random.integers(0, 2**31, HASHES, dtype=np.uint32) * 2 + 1)[:, None]
_B = _random.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]
_FOLD = _random.integers(0, 2**63, (BANDS, ROWS + 1), dtype=np.uint64) * 2 + 1
_STEP = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(64)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one shingle, none without words.

    A-Z are lower-cased; words are parted by the six ASCII blanks.
    """
    found = (text or "").encode().lower().split()  # on bytes, both keep to ASCII
    if not found:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    width = min(words, len(found))
    n = len(found) - width + 1
    rolled = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        rolled += each[k : k + n] * _STEP[k]
    return np.unique(_mixed(rolled))


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over the shingles."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(out, (_A * low[at : at + 1024] + _B).min(axis=1), out=out)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    rows = mins.reshape(BANDS, ROWS).astype(np.uint64)
    return _mixed((rows * _FOLD[:, :ROWS]).sum(axis=1, dtype=np.uint64) + _FOLD[:, ROWS]).view(np.int64)


def packed(mins: np.ndarray) -> bytes:
    """The low ``BITS`` bits of every minimum."""
    bits = (mins[:, None] >> np.arange(BITS, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def estimated(mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity of unpacked signatures (uint64 rows of 4-bit fields), corrected for fields equal by chance."""
    x = mine ^ others
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    different = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1)
    chance = 2.0**-BITS
    return ((1 - different / HASHES) - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    chance = 2.0**-BITS
    equal = percent / 100 * (1 - chance) + chance
    return percent / 100 - SIGMAS * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - chance)


def features(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, set_key, bands, signature``; key and signature are null and bands empty without words.

    Bands and signature are given once for equal sets that a task meets again, so copies are thinned out before any
    shuffle. Rows without an id have neither, as they are linked with nothing.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, met = WordHashes(), set()
        for batch in batches:
            sizes, keys, bands, signatures = [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = shingles(text.as_py(), words, hashes)
                key = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                sizes.append(len(found))
                keys.append(key)
                if key is not None and doc_id.is_valid and key not in met:
                    if len(met) >= 100_000:
                        met.clear()
                    met.add(key)
                    mins = minima(found)
                    bands.append(band_keys(mins))
                    signatures.append(packed(mins))
                else:
                    bands.append(np.empty(0, np.int64))
                    signatures.append(None)
            offsets = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands) if bands else [], pa.int64()))
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), listed, pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_key", "bands", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>, signature binary")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` with the smallest node that the edges ``a, b`` connect; for every node of an edge.

    Each round hands labels over the edges and then to the label's own label, so paths halve. Every round is cut. Few edges
    are one partition.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    rows = both.count()
    both = cut(together(both, rows))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    while True:
        told = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("label"))
        hooked = cut(together(labels.union(told), rows).groupBy("node").agg(F.min("label").alias("label")))
        up = hooked.select(F.col("node").alias("up"), F.col("label").alias("above"))
        labels = cut(hooked.join(up, F.col("label") == F.col("up"), "left").select("node", F.coalesce(F.least("label", "above"), "label").alias("label")))
        last, total = total, labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == last:
            return labels


def set_number(key: Column) -> Column:
    """The first eight bytes of a set's key; sets that agree in them by chance are only clustered together."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def candidate_ties(found: DataFrame) -> DataFrame:
    """``a, b``: the smallest set that shares a bucket with a set, tied to that set and to its buckets' smallest ones.

    Sets go by their numbers. Each has ``BANDS`` buckets at most, and many sets have the same smallest ones.
    """
    rows = found.filter(F.size("bands") > 0).select(set_number(F.col("set_key")).alias("number"), F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("number").alias("centre"), F.max("number").alias("other")).filter("centre < other")
    shared = small(cut(shared.select("band", "centre")), MAX_BROADCAST_BANDS)
    per = rows.join(shared, "band").groupBy("number").agg(F.collect_set("centre").alias("centres"))
    least = F.least("number", F.array_min("centres"))
    return per.select(F.explode(F.array_union("centres", F.array("number"))).alias("a"), least.alias("b")).filter("a <> b").distinct()


class _Linker:
    """Connects the classes of one block. ``left`` marks those whose pairs with all others are wanted."""

    def __init__(self, percent: int) -> None:
        self.percent, self.least = percent, least_estimate(percent)

    def __call__(self, nodes: list[int], labels: list[int], left: list[bool], signatures: list[bytes], sets: list[bytes]) -> list[int]:
        """The smallest label that each class is connected to, given that equal labels are connected already."""
        m = len(nodes)
        label, wanted = np.array(labels, np.int64), np.array(left, bool)
        lists = [np.frombuffer(s, np.uint64) for s in sets]
        size = np.array([len(s) for s in lists], np.int64)
        width = -(-HASHES * BITS // 64) * 8
        sig = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in signatures), np.uint64).reshape(m, -1)
        _, ids = np.unique(np.concatenate(lists), return_inverse=True)
        begin = np.concatenate(([0], np.cumsum(size)))
        present = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)

        def may(i: int) -> np.ndarray:
            small_enough = 100 * np.minimum(size, size[i]) >= self.percent * np.maximum(size, size[i])
            return small_enough & (estimated(sig[i], sig) >= self.least) & (wanted | wanted[i])

        order = range(m) if m == 2 else np.argsort([-int(may(i).sum()) for i in range(m)], kind="stable").tolist()
        for i in order:
            others = np.flatnonzero((label != label[i]) & may(i)) if (label != label[i]).any() else ()
            if not len(others):
                continue
            mine = ids[begin[i] : begin[i + 1]]
            present[mine] = True
            for j in others.tolist():
                if label[j] == label[i]:
                    continue
                both = int(np.count_nonzero(present[ids[begin[j] : begin[j + 1]]]))
                if 100 * both >= self.percent * int(size[i] + size[j] - both):
                    low, high = sorted((int(label[i]), int(label[j])))
                    label[label == high] = low
            present[mine] = False
        return label.tolist()


def _linked(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b`` per class and block, of ``cluster, part, node, label, left, signature, shingles`` grouped by the first two.

    A block is read from sorted rows and held alone in memory.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link = _Linker(percent)
        key, block = None, []

        def close(block: list[tuple]) -> pa.RecordBatch:
            nodes, labels, left, signatures, sets = map(list, zip(*block, strict=True))
            out = link(nodes, labels, left, signatures, sets)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.int64())], names=["a", "b"])

        for batch in batches:
            for cluster, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block and (cluster, part) != key:
                    yield close(block)
                    block = []
                key = (cluster, part)
                block.append(tuple(row))
        if block:
            yield close(block)

    columns = ["cluster", "part", "node", "label", "left", "signature", "shingles"]
    sorted_rows = rows.select(*columns).repartition("cluster", "part").sortWithinPartitions("cluster", "part", "node", "signature")
    return sorted_rows.mapInArrow(scan, "a long, b long")


def _sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """``node, set_key, shingles``: the full sets of the classes, from their documents' texts."""
    wanted = small(cut(classes.select(F.col("node").alias("__node")).distinct()))
    rows = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("__node"), "left_semi")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(text.as_py(), words, hashes).tobytes() for text in batch.column(1)]
            arrays = [batch.column(0), pa.array([xxhash.xxh3_128_digest(f) for f in found], pa.binary()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "set_key", "shingles"])

    return rows.mapInArrow(scan, "node long, set_key binary, shingles binary").dropDuplicates(["node", "set_key"])


def _part_shingles(rows: DataFrame) -> DataFrame:
    """``cluster, part, shingle, sets``: every shingle of a part's sets once, with how many of them hold it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: tuple[int, int] | None = None
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            each, sets = np.unique(np.concatenate(held), return_counts=True)
            columns = [pa.repeat(pa.scalar(of[0], pa.int64()), len(each)), pa.repeat(pa.scalar(of[1], pa.int32()), len(each)), pa.array(each), pa.array(sets.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=["cluster", "part", "shingle", "sets"])

        for batch in batches:
            for cluster, part, each in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of is not None and of != (cluster, part):
                    yield close()
                    held = []
                of = (cluster, part)
                held.append(np.frombuffer(each, np.int64))
        if of is not None:
            yield close()

    placed = rows.select("cluster", "part", "shingles").repartition("cluster", "part").sortWithinPartitions("cluster", "part")
    return placed.mapInArrow(scan, "cluster long, part int, shingle long, sets long")


def _prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """``cluster, shingle, number, label, size, indexed, behind``: the first shingles of every set, ``behind`` those from there on.

    In a cluster's order shingles come by how many of its sets hold them, then by value: rare ones first. Any order would
    do; this one keeps out of the prefixes what a template, or a section of it, has in common. Holders are counted over
    the whole cluster, each part's own counts first, and a part gets those of its own shingles that several sets hold,
    no more than the part's block has.
    """
    held = _part_shingles(rows).withColumn("holders", F.sum("sets").over(Window.partitionBy("cluster", "shingle"))).filter("holders > 1")
    parts = held.groupBy("cluster", "part").agg(F.array_sort(F.collect_list(F.struct("shingle", "holders"))).alias("common"))
    nothing = [F.lit(None).cast("long").alias(c) for c in ("number", "label")]
    first = parts.select("cluster", "part", *nothing, F.lit(None).cast("binary").alias("shingles"), "common")
    sets = rows.select("cluster", "part", "number", "label", "shingles", F.lit(None).cast("array<struct<shingle:bigint,holders:bigint>>").alias("common"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        of, common, holders = None, none, none
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            listed = batch.column(5)
            for i, (cluster, part, number, label, each) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True)):
                if each is None:
                    entries = listed[i].values  # sorted by shingle
                    of, common, holders = (cluster, part), entries.field(0).to_numpy(), entries.field(1).to_numpy()
                    continue
                if of != (cluster, part):
                    of, common, holders = (cluster, part), none, none
                each = np.frombuffer(each, np.int64)
                size = len(each)
                late = np.ones(size, np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, each), len(common) - 1)
                    late = np.where(common[at] == each, holders[at], 1)
                probed = size - -(-size * percent // 100) + 1
                indexed = size - -(-2 * size * percent // (100 + percent)) + 1
                chosen = each[np.lexsort((each, late))[:probed]]
                place = np.arange(len(chosen))
                for column, values in zip(out, ([cluster] * len(chosen), chosen.tolist(), [number] * len(chosen), [label] * len(chosen), [size] * len(chosen), (place < indexed).tolist(), (size - place).tolist()), strict=True):
                    column += values
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["cluster", "shingle", "number", "label", "size", "indexed", "behind"])

    dealt = first.unionByName(sets).repartition("cluster", "part").sortWithinPartitions("cluster", "part", "number")
    wanted = dealt.select("cluster", "part", "number", "label", "shingles", "common")
    return wanted.mapInArrow(scan, "cluster long, shingle long, number long, label long, size long, indexed boolean, behind long")


def prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b``: all pairs of ``cluster, part, number, label, shingles`` of one cluster, with different labels, that may be links.

    With the shingles of all sets in one order, the first one that two linked sets share stands, in the smaller set, before
    place ``size - 2p/(100+p) * size``, in the larger one before ``size - p/100 * size``, and leaves enough behind it in both.
    """
    places = cut(_prefixes(rows, percent))
    x, y = places.alias("x"), places.filter("indexed").alias("y")
    smaller = F.struct("y.size", "y.number") < F.struct("x.size", "x.number")
    room = F.least("x.behind", "y.behind") * (100 + percent) >= (F.col("x.size") + F.col("y.size")) * percent
    fits = smaller & (F.col("x.label") != F.col("y.label")) & (F.col("y.size") * 100 >= F.col("x.size") * percent) & room
    same = (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.shingle") == F.col("y.shingle"))
    return x.join(y, same & fits).select(F.col("y.number").alias("a"), F.col("x.number").alias("b")).distinct()


def _likely(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose estimate may reach the threshold."""
    least = least_estimate(percent)
    width = -(-HASHES * BITS // 64) * 8

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(s.as_py().ljust(width, b"\0") for s in c), np.uint64).reshape(-1, width // 8) for c in batch.columns[2:])
            near = batch.filter(pa.array(estimated(one, two) >= least, pa.bool_()))
            yield pa.RecordBatch.from_arrays(near.columns[:2], names=["a", "b"])

    each = [signatures.select(F.col("number").alias(end), F.col("signature").alias(f"of_{end}")) for end in ("a", "b")]
    return pairs.join(each[0], "a").join(each[1], "b").select("a", "b", "of_a", "of_b").mapInArrow(scan, "a long, b long")


def _confirmed(docs: DataFrame, classes: DataFrame, ties: DataFrame, words: int, percent: int) -> DataFrame:
    """``node, label`` of the classes that a confirmed link joins to a smaller one."""
    per = classes.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("total")).filter("members > 1")
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    per = small(cut(per.select("cluster", blocks.alias("blocks"))))
    rows = written(classes.join(per, "cluster").join(_sets(docs, classes.join(per, "cluster", "left_semi"), words), ["node", "set_key"]))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("label", F.col("node")).withColumn("left", F.lit(True))
    single = rows.filter("blocks = 1")
    done = _linked(single, percent).filter("a <> b")
    many = rows.filter("blocks > 1")
    if many.isEmpty():
        return done.select(F.col("a").alias("node"), F.col("b").alias("label"))
    # Blocks, each with the cluster's pivots: those that most ties lead to, one of each hash slot.
    degree = cut(ties.groupBy(F.col("b").alias("number")).agg(F.count(F.lit(1)).alias("degree")))
    slot = F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(PIVOTS))
    best = many.select("cluster", "node", set_number(F.col("set_key")).alias("number")).join(degree, "number", "left").groupBy("cluster", slot.alias("slot"))
    pivots = small(cut(best.agg(F.max(F.struct(F.coalesce("degree", F.lit(0)), "node")).alias("best")).select(F.col("best.node").alias("pivot")).distinct()))
    leaders = many.join(pivots, F.col("node") == F.col("pivot"), "left_semi")
    everywhere = leaders.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("other <> part").withColumn("part", F.col("other").cast("int")).drop("other")
    first = cut(_linked(many.unionByName(everywhere.withColumn("left", F.lit(False))), percent))
    labels = cut(components(first))
    # Clusters in more than one part: their classes of different parts meet by prefixes, each with its likely partners.
    joined = many.drop("label").join(labels, "node")
    parted = small(cut(joined.groupBy("cluster").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("cluster")))
    opened = joined.join(parted, "cluster", "left_semi").withColumn("number", set_number(F.col("set_key")))
    pairs = cut(_likely(prefix_pairs(opened, percent), opened, percent))
    deals = pairs.groupBy(F.col("b").alias("hub")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("deals"))
    dealt = pairs.withColumnRenamed("b", "hub").join(deals, "hub").withColumn("deal", F.pmod(F.xxhash64("a"), F.col("deals")).cast("int"))
    hubs = deals.select("hub", F.col("hub").alias("number"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(True).alias("left"))
    guests = dealt.select("hub", F.col("a").alias("number"), "deal", F.lit(False).alias("left"))
    held = opened.select("number", F.col("label").alias("node"), "label", "signature", "shingles")  # parts are what is linked now
    met = hubs.unionByName(guests).join(held, "number").withColumnsRenamed({"hub": "cluster", "deal": "part"})
    above = components(_linked(met, percent).filter("a <> b")).select(F.col("node").alias("__part"), F.col("label").alias("__above"))
    ends = labels.join(above, F.col("label") == F.col("__part"), "left").select("node", F.coalesce("__above", "label").alias("label"))
    return done.select(F.col("a").alias("node"), F.col("b").alias("label")).union(ends.filter("node <> label"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Two documents are linked if ``100 * shared >= percent * united`` over their distinct shingles of ``words`` words.
    ``component_id`` is the smallest id that links reach, ``kept`` marks the documents that are it. Texts without words
    are linked with nothing. Rows without an id can't be reached: they are linked with nothing, have no component and
    are kept. Rows that share an id report the smallest component of their texts. An empty table gives no rows.
    """
    found = written(features(docs, words))
    ties = cut(candidate_ties(found))
    clusters = small(components(ties).select(F.col("node").alias("number"), F.col("label").alias("cluster")))
    named = found.filter("doc_id is not null and set_key is not null").withColumn("number", set_number(F.col("set_key")))
    grouped = named.join(clusters, "number").groupBy("cluster", "set_key")
    classes = cut(grouped.agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature")))
    linked = small(cut(_confirmed(docs, classes, ties, words, percent)))
    # A set's smallest reach: of its own copies, then of those it is linked with.
    sets = named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")).join(linked, "node", "left")
    reach = small(cut(sets.filter("node < last or label is not null").select("set_key", F.coalesce("label", "node").alias("reached"))))
    per_doc = named.select("doc_id", "set_key").join(reach, "set_key").groupBy("doc_id").agg(F.min("reached").alias("reached"))
    per_doc = small(cut(per_doc.filter("reached < doc_id")))
    out = found.select("doc_id", "n_shingles").join(per_doc, "doc_id", "left")
    component = F.coalesce("reached", "doc_id").alias("component_id")
    return out.select("doc_id", "n_shingles", component, F.col("reached").isNull().alias("kept"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps; of rows that repeat an id and its text, one.

    An id's further texts are judged on their own: all but the one of the smallest hash get a number of their own, 2^62
    or more, so they give way to documents of smaller ids. Only ids are joined: what goes is broadcast if it is small,
    and texts are dealt out anew only if ids repeat. All columns stay, whatever their names.
    """
    repeated = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.isEmpty():
        (gone_,) = unused(docs, "__gone")
        judged = near_duplicates(docs, words, percent)
        gone = small(cut(judged.filter(~F.col("kept")).select(F.col("doc_id").alias(gone_)).distinct()))
        return docs.join(gone, F.col("doc_id") == F.col(gone_), "left_anti")
    text_hash = F.xxhash64("text")
    firsts = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(text_hash).alias("first"), F.max(text_hash).alias("last"))
    of_id, of_first, of_node, gone_ = unused(docs, "__id", "__first", "__node", "__gone")
    firsts = small(cut(firsts.filter("first < last").select(F.col("doc_id").alias(of_id), F.col("first").alias(of_first))))
    own = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    node = F.when(F.col(of_first) != text_hash, own).otherwise(F.col("doc_id").cast("long"))
    named = docs.join(firsts, F.col("doc_id") == F.col(of_id), "left").withColumn(of_node, node).drop(of_id, of_first)
    judged = near_duplicates(named.select(F.col(of_node).alias("doc_id"), "text"), words, percent)
    gone = small(cut(judged.filter(~F.col("kept")).select(F.col("doc_id").alias(gone_)).distinct()))
    out = named.join(gone, F.col(of_node) == F.col(gone_), "left_anti")
    unnamed = out.filter(F.col("doc_id").isNull())
    return out.filter(F.col("doc_id").isNotNull()).dropDuplicates([of_node]).unionByName(unnamed).drop(of_node)
