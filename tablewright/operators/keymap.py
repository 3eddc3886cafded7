"""The keymap: natural keys and the stable ids they stand for (``key`` id, ``value``, ``redirect``, ``modified_at``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import stable_id

SCHEMA = "key string, value string, redirect string, modified_at timestamp"


def key_value(*columns: Column) -> Column:
    """The canonical JSON text of key values; null if all are null."""
    every = columns[0].isNull()
    for c in columns[1:]:
        every = every & c.isNull()
    return F.when(~every, F.to_json(F.array(*[c.cast("string") for c in columns])))


def live(keymap: DataFrame) -> DataFrame:
    """The newest entry of each value that isn't redirected."""
    window = Window.partitionBy("value").orderBy(F.desc_nulls_last("modified_at"), F.asc("key"))
    return keymap.filter("redirect is null").withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def encode(df: DataFrame, columns: Sequence[str], keymap: DataFrame, model: str, at: Column, name: str = "_id") -> tuple[DataFrame, DataFrame]:
    """``df`` with the id of its key values, and the keymap with the new ones. All-null keys have no id.

    A new id is hashed from model and value, so it is the same whoever meets the value first.
    """
    known = live(keymap).select(F.col("value").alias("__value"), F.col("key").alias("__key"))
    valued = df.withColumn("__v", key_value(*[F.col(c) for c in columns]))
    joined = valued.join(known, F.col("__v") == F.col("__value"), "left")
    made = F.when(F.col("__v").isNotNull(), F.coalesce("__key", stable_id(model, F.col("__v"))))
    fresh = joined.filter("__v is not null and __key is null").select("__v").distinct()
    fresh = fresh.select(stable_id(model, F.col("__v")).alias("key"), F.col("__v").alias("value"), F.lit(None).cast("string").alias("redirect"), at.alias("modified_at"))
    return joined.select(*df.columns, made.alias(name)), keymap.unionByName(fresh)


def check_given_ids(df: DataFrame, columns: Sequence[str], keymap: DataFrame, given: str = "_id") -> DataFrame:
    """Rows whose given id differs from the keymap's: ``_id, expected``."""
    known = live(keymap).select(F.col("value").alias("__value"), F.col("key").alias("expected"))
    valued = df.withColumn("__v", key_value(*[F.col(c) for c in columns])).join(known, F.col("__v") == F.col("__value"))
    return valued.filter(F.col(given).isNotNull() & (F.col(given) != F.col("expected"))).select(F.col(given).alias("_id"), "expected")


def decode(df: DataFrame, column: str, keymap: DataFrame, name: str = "value") -> DataFrame:
    """The key value behind an id, redirected ones too; null if unknown."""
    return df.join(keymap.select(F.col("key").alias("__key"), F.col("value").alias(name)), F.col(column) == F.col("__key"), "left").drop("__key")


def contains(df: DataFrame, column: str, keymap: DataFrame) -> DataFrame:
    """The rows whose id is in the keymap."""
    return df.join(keymap.select(F.col("key").alias("__key")), F.col(column) == F.col("__key"), "left_semi")


def sync(keymap: DataFrame, log: DataFrame, columns: Sequence[str], cursor: int = 0) -> tuple[DataFrame, DataFrame]:
    """The keymap after the log's entries beyond ``cursor``, and the new cursor (one row, ``cursor``).

    Inserts and changes set the value of the row's id, changed keys laid over the stored ones; a move redirects it. The
    newest entry counts. ``log`` is a changelog whose ``data`` holds the keys.
    """
    new = log.filter(F.col("_id") > cursor)
    values = new.filter("action not in ('move', 'delete')").select("_rid", "_id", "datetime", F.from_json("data", "map<string,string>").alias("d"))
    parts = [F.max_by(F.when(F.array_contains(F.map_keys("d"), c), F.struct(F.col("d")[c].alias("v"))), F.when(F.array_contains(F.map_keys("d"), c), F.col("_id"))).alias(f"__p{i}") for i, c in enumerate(columns)]
    last = values.groupBy("_rid").agg(*parts, F.max("datetime").alias("__at"))
    moved = new.filter("action = 'move'").groupBy("_rid").agg(F.max_by(F.get_json_object("data", "$._id"), "_id").alias("__to"), F.max("datetime").alias("__moved"))
    met = last.join(moved, "_rid", "full_outer")
    joined = keymap.join(met, F.col("key") == F.col("_rid"), "full_outer")
    stored = F.from_json("value", "array<string>")
    merged = [F.when(F.col(f"__p{i}").isNotNull(), F.col(f"__p{i}.v")).otherwise(F.try_element_at(stored, F.lit(i + 1))) for i in range(len(columns))]
    value = F.when(F.col("__at").isNotNull(), key_value(*merged)).otherwise(F.col("value"))
    out = joined.select(F.coalesce("key", "_rid").alias("key"), value.alias("value"), F.coalesce("__to", "redirect").alias("redirect"), F.coalesce(F.greatest("__at", "__moved"), "modified_at").alias("modified_at"))
    return out, new.agg(F.coalesce(F.max("_id"), F.lit(cursor)).alias("cursor"))


def duplicate_stats(keymap: DataFrame) -> DataFrame:
    """``values, rows``: how many values have several live ids, and how many rows these are."""
    several = keymap.filter("redirect is null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return several.agg(F.count(F.lit(1)).alias("values"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def validate(keymap: DataFrame, fail: bool = False) -> DataFrame:
    """The statistics of :func:`duplicate_stats`; with ``fail``, an error instead if there are duplicates."""
    stats = duplicate_stats(keymap)
    if not fail:
        return stats
    bad = F.raise_error(F.concat(F.lit("values with several ids: "), F.col("values").cast("string"))).cast("long")
    return stats.select(F.when(F.col("values") > 0, bad).otherwise(F.col("values")).alias("values"), "rows")
