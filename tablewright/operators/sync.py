"""Incremental push: what differs from the last known state, and the state after the push."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paging import after, sort
from .project import checksum

STATE_SCHEMA = "id string, revision string, checksum string, pushed timestamp, error boolean, data string"


def push_delta(rows: DataFrame, state: DataFrame, key: str = "_id", columns: Sequence[str] | None = None) -> DataFrame:
    """``op`` (insert, patch, same, delete) per row of either side, with ``id, checksum, revision`` and the data as JSON.

    A patch carries the revision known from the state. What failed before is not deleted while it is marked so. Of
    several rows of one id the one with the greatest data (as JSON text) counts.
    """
    data = [c for c in (columns or rows.columns) if c != key]
    source = rows.select(F.col(key).cast("string").alias("__id"), checksum(rows, data).alias("__sum"), F.to_json(F.struct(*data)).alias("__data"))
    source = source.groupBy("__id").agg(F.max(F.struct("__data", "__sum")).alias("__row")).select("__id", "__row.*")
    joined = source.join(state, F.col("__id") == F.col("id"), "full_outer")
    op = F.when(F.col("id").isNull(), "insert").when(F.col("__id").isNull(), F.when(F.col("error"), "same").otherwise("delete")).when(F.col("__sum").eqNullSafe(F.col("checksum")), "same").otherwise("patch")
    return joined.select(F.coalesce("__id", "id").alias("id"), op.alias("op"), F.coalesce("__sum", "checksum").alias("checksum"), F.when(op != "insert", F.col("revision")).alias("revision"), F.col("__data").alias("data"))


def save_push_state(state: DataFrame, results: DataFrame, at: Column, by: Sequence[str] = ()) -> DataFrame:
    """The state after a push. ``results``: ``id, op, revision, checksum, error, data``; the last result of an id counts.

    Last is by the columns ``by``, then by all columns. A failure keeps its payload and the former revision; what was
    deleted without error goes.
    """
    new = last_results(results.filter("op <> 'same'"), *by)
    gone = new.filter("op = 'delete' and not error").select("id")
    r = new.join(gone, "id", "left_anti").select("id", F.col("revision").alias("__rev"), F.col("checksum").alias("__sum"), F.col("error").alias("__err"), F.col("data").alias("__data"))
    s = state.join(gone, "id", "left_anti")
    hit = F.col("__err").isNotNull()
    return s.join(r, "id", "full_outer").select(
        "id",
        F.when(hit & ~F.col("__err"), F.col("__rev")).otherwise(F.col("revision")).alias("revision"),
        F.when(hit & ~F.col("__err"), F.col("__sum")).otherwise(F.col("checksum")).alias("checksum"),
        F.when(hit, at).otherwise(F.col("pushed")).alias("pushed"),
        F.coalesce("__err", "error").alias("error"),
        F.when(hit, F.when(F.col("__err"), F.col("__data"))).otherwise(F.col("data")).alias("data"),
    )


def max_cursor(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last page key pushed: one row."""
    return rows.agg(F.max(F.struct(*keys)).alias("c")).filter("c is not null").select("c.*")


def retry_set(state: DataFrame) -> DataFrame:
    """What failed and is to be pushed again."""
    return state.filter("error")


def rebuild_push_state(target: DataFrame, state: DataFrame) -> DataFrame:
    """The state aligned with the target's ``id, revision, checksum``: what it holds is known, what it lacks is not."""
    t = target.select("id", F.col("revision").alias("__rev"), F.col("checksum").alias("__sum"))
    return t.join(state, "id", "left").select("id", F.col("__rev").alias("revision"), F.col("__sum").alias("checksum"), "pushed", F.lit(False).alias("error"), F.lit(None).cast("string").alias("data"))


def incremental_cursor(df: DataFrame, keys: Sequence[str], values: Sequence[object] | None) -> DataFrame:
    """Only rows behind the saved page cursor, in the order of its keys."""
    return sort(df if values is None else df.filter(after(df, keys, values)), *keys)


def last_results(results: DataFrame, *by: str, key: str = "id") -> DataFrame:
    """The last row of every id by the columns ``by``; of rows that tie there, always the same one."""
    order = F.struct(*by, F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}))
    return results.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*results.columns), order).alias("__last")).select("__last.*")
