"""Mixing sources to target weights by repetition rates.

Words are summed per source, the corpus total is shared out by weight with no source above ``most`` times its own
size, and each document is emitted ``floor(rate)`` times plus once more if its hashed draw falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, small, unused

SEED = "mix-1"
MOST = 3
CYCLE = (1, 2, 3)


def source_sizes(docs: DataFrame) -> DataFrame:
    """Words per source; a null source is a source."""
    return docs.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("source_size"))


def cyclic_weights(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Adds ``weight``: the sources in code point order, null last, take the values of ``cycle`` in turn."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in cycle]), (place % len(cycle) + 1).cast("int")))


def targets(weighted: DataFrame, most: float = MOST) -> DataFrame:
    """Adds ``target`` and ``rate`` to one row per source (``source, source_size, weight``).

    A target is ``min(most * source_size, level * weight)`` with the one level at which targets add up to the total:
    with sources by rising cap per weight, the level is the largest of (total - caps before) / (weights from here).
    The table has a row per source, so one task can order it.
    """
    order = [F.col("source_size") * most / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    cap = F.col("source_size") * most
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    levelled = weighted.withColumn("__level", left.cast("double") / F.sum("weight").over(onward)).withColumn("__level", F.max("__level").over(everything))
    target = F.least(cap.cast("double"), F.col("__level") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), target / F.col("source_size"))).otherwise(F.lit(0.0))
    return levelled.select("source", "source_size", "weight", target.alias("target"), rate.alias("rate"))


def draw(doc_id: Column, size: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) hashed from the seed, the id and the size: the same in every run."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / float(2**52)


def plan_copies(docs: DataFrame, weighted: DataFrame | None = None, most: float = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target, mix_rate, mix_copies``; columns so named are replaced, all others
    stay as they are, whatever their names.

    ``weighted`` has ``source, source_size, weight``; by default :func:`cyclic_weights` of the documents themselves.
    A null text has size 0, a source without words has target and rate 0, and repeated rows draw alike. An empty
    table gives no rows. The table of sources is counted: small ones are broadcast, others joined by shuffle, where
    Spark splits a hot source.
    """
    added = ("mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies")
    plan = cut(targets(weighted if weighted is not None else cyclic_weights(source_sizes(docs)), most))
    (named,) = unused(docs, "__source")
    per_source = small(plan).select(F.col("source").alias(named), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("rate").alias("mix_rate"))
    rows = docs.drop(*added).withColumn("mix_size", n_words(F.col("text")))
    rows = rows.join(per_source, F.col("source").eqNullSafe(F.col(named)), "left").drop(named)
    whole = F.floor("mix_rate")
    extra = (draw(F.col("doc_id"), F.col("mix_size"), seed) < F.col("mix_rate") - whole).cast("long")
    return rows.withColumn("mix_copies", whole.cast("long") + extra)


def mix(docs: DataFrame, weighted: DataFrame | None = None, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as :func:`plan_copies` says, with the columns of ``docs``."""
    whole = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("__row"))
    planned = plan_copies(whole, weighted, most, seed).filter(F.col("mix_copies") > 0)
    return planned.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("__copy")).select("__row.*")
