"""Hierarchical weighted hash tree: documents descend region, rack and shard by weighted hash draws.

At each level every child gets a draw ``-ln(u) / weight`` with ``u`` hashed from the key and the child's name, and
the smallest draw wins, so a child gets a share in proportion to its weight. A change of one weight moves rows only
between the subtrees whose weights change; all other draws stay as they are. A further shard that opens its own
region (:func:`grow`) therefore takes rows only into itself.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 20_240_601
#: Most numbers that are written out at once for one repeated row.
RUN = 100_000


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


Topology = tuple[Leaf, ...]


def planned(shards: int = 16, shards_per_rack: int = 4, racks_per_region: int = 2, weight: float = 1.0) -> Topology:
    """A regular tree: racks of ``shards_per_rack`` shards, regions of ``racks_per_region`` racks."""
    racks = [i // shards_per_rack for i in range(shards)]
    return tuple(Leaf(f"region-{r // racks_per_region}", f"rack-{r}", i, weight) for i, r in enumerate(racks))


def grow(topology: Topology, weight: float = 1.0) -> Topology:
    """One more shard, in a region of its own: it takes its share from all others and moves nothing between them."""
    shard = max((leaf.shard for leaf in topology), default=-1) + 1
    return (*topology, Leaf(f"grown-{shard}", f"grown-{shard}", shard, weight))


def _winner(key: Column, children: Column) -> Column:
    """``next`` of the child with the smallest draw, of an array of ``name, weight, next``."""

    def drawn(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), child["name"], key), 11)
        return F.struct((-F.log((bits.cast("double") + 0.5) / float(2**53)) / child["weight"]).alias("draw"), child["next"].alias("next"))

    return F.array_min(F.transform(children, drawn))["next"]


def _children(rows: list[tuple[str, float, int]]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), F.lit(following).alias("next")) for name, weight, following in rows])


def shard_of(key: Column, topology: Topology) -> Column:
    """The shard of ``key``. A null key is a key like any other: all null keys go to one shard."""
    if any(leaf.weight < 0 for leaf in topology) or not any(leaf.weight > 0 for leaf in topology):
        raise ValueError("weights must not be below zero, and one must be above")
    tree: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in topology:
        if leaf.weight > 0:  # what weighs nothing is never drawn
            tree.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    regions, racks, shards = [], [], []
    for region, inside in tree.items():
        found = []
        for rack, leaves in inside.items():
            found.append((f"rack/{region}/{rack}", sum(x.weight for x in leaves), len(shards)))
            shards.append(_children([(f"shard/{region}/{rack}/{x.shard}", x.weight, x.shard) for x in leaves]))
        regions.append((f"region/{region}", sum(w for _, w, _ in found), len(racks)))
        racks.append(_children(found))
    rack = _winner(key, F.get(F.array(*racks), _winner(key, _children(regions))))
    return _winner(key, F.get(F.array(*shards), rack)).cast("int")


def number_in_shard(df: DataFrame, shard: str, order: list[str], slot: str = "slot", buckets: int = 1024) -> DataFrame:
    """Adds gapless numbers from 0 within each shard, without sorting a shard in one task.

    Rows of a shard fall into hashed buckets; counts per bucket give each bucket its first number, and a window
    numbers the rows inside a bucket. Rows equal in ``order`` and all other columns are counted before the shuffle
    and numbered from the count, so many repeats of one row don't meet in one task as rows.
    """
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    counted = counted.withColumn("__bucket", F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(buckets)).cast("int"))
    totals = counted.groupBy(shard, "__bucket").agg(F.sum("__n").alias("__total"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select(shard, "__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(shard, "__bucket").orderBy(*order, *[c for c in columns if c not in order]).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(first, [shard, "__bucket"])
    start = F.col("__first") + F.col("__before")
    runs = placed.select(*columns, start.alias("__start"), (start + F.col("__n")).alias("__end"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / RUN))).alias("__run"))
    at = F.col("__start") + F.col("__run") * RUN
    return runs.select(*columns, F.explode(F.sequence(at, F.least(at + RUN, F.col("__end")) - 1)).alias(slot))


def shard_documents(docs: DataFrame, topology: Topology | None = None, grown: Topology | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The place of every document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and ``keep``.

    ``size`` is the number of UTF-8 bytes plus 1, the checksum is CRC-32 of these bytes; a null text counts as
    empty. The law is ``key``: ``doc_id`` and the topology decide the shard, so copies of a row, and all rows with a
    null ``doc_id``, share a shard but have slots of their own. An empty table gives no rows.
    """
    topology = topology or planned()
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *keep)
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), topology))
    slotted = number_in_shard(rows, "shard", ["doc_id", "size", "text_crc32"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("doc_id"), grown or grow(topology)).alias("grown_shard"), *keep)
