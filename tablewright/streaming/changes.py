"""Change streams: every micro-batch is applied to the tables of a :class:`~.state.State`.

A batch reads the rows of the keys it names, writes the rows it changed as a run of its own and appends its entries to
the log. A batch that runs again after a failure reads the same former rows and writes the same ones, so applying it
twice does no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..model import TableError
from ..operators import history, keymap, sync
from ..operators.quality import check_all
from ..runtime import cut
from .state import State

__all__ = ["State", "fault_tolerant_write", "replay", "staged_write", "stream_apply_changes", "stream_keymap_sync", "stream_push_delta"]

MAX_ERRORS = 100


def _start(source: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(current: DataFrame, batch: DataFrame, model: str, txn: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """What a batch of changes (``_id, _op, _at`` and data) makes: changed rows with ``__gone``, and the entries of the
    changelog (without ``_id``), one for each change that changed something.

    A row's changes come in the order of ``_at``, then of the columns ``by``; at one place deletes come last, then the data
    decides. upsert inserts an unknown row and replaces a known one's data; delete removes it; deletes of unknown rows and
    upserts of what is there already change nothing. Each entry has its own change's time, and its revision is a hash of
    model, row, time and data, so neither depends on how a stream was cut into batches, as long as time goes on from one
    to the next. What a change meets is the change before it, or else the row in ``current``, which need hold no
    others than those of the batch.
    """
    columns = history.data_columns(current)
    kinds = {c: current.schema[c].dataType for c in columns}
    given = {}
    for c, kind in kinds.items():
        value = F.col(c).cast(kind) if c in batch.columns else F.lit(None).cast(kind)
        given[c] = F.coalesce(value, F.array().cast(kind)) if isinstance(kind, T.ArrayType) else value
    events = batch.select("_id", "_op", F.col("_at").cast("timestamp").alias("_at"), *[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], *[v.alias(c) for c, v in given.items()])
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    order = Window.partitionBy("_id").orderBy("_at", *[f"__by{i}" for i in range(len(by))], F.col("_op") == "delete", text)
    row = F.struct((F.col("_op") == "upsert").alias("there"), *columns)
    placed = events.withColumns({"__n": F.row_number().over(order), "__before": F.lag(row).over(order)})
    saved = current.select(F.col("_id").alias("__id"), F.struct(F.lit(True).alias("there"), *columns).alias("__saved"), F.col("_created").alias("__created"))
    met = placed.join(saved, F.col("_id") == F.col("__id"), "left").withColumn("__before", F.when(F.col("__n") == 1, F.col("__saved")).otherwise(F.col("__before")))
    there = F.coalesce(F.col("__before.there"), F.lit(False))
    entries = [F.when(~F.col(c).eqNullSafe(F.when(there, F.col(f"__before.{c}"))), F.struct(F.lit(c).alias("key"), history.as_text(F.col(c), kinds[c]).alias("value"))) for c in columns]
    patch = F.when(F.col("_op") == "upsert", F.map_from_entries(F.filter(F.array(*entries), lambda x: x.isNotNull()))).otherwise(F.create_map().cast("map<string,string>"))
    met = met.withColumns({"__there": there, "__patch": patch})
    action = F.when((F.col("_op") == "upsert") & ~F.col("__there"), "insert").when((F.col("_op") == "upsert") & (F.size("__patch") > 0), "update").when((F.col("_op") == "delete") & F.col("__there"), "delete")
    data = F.to_json("__patch", {"ignoreNullFields": "false"})
    logged = met.withColumn("action", action).withColumn("data", data)
    logged = logged.withColumn("_revision", F.when(F.col("action").isNotNull(), history.stable_id("revision", F.lit(model), F.col("_id"), F.unix_micros("_at").cast("string"), F.col("action"), F.col("data"))))
    kept = cut(logged.select("_id", "_op", "_at", "__n", "action", "data", "_revision", "__created", *columns))

    effective = F.col("action").isNotNull()
    last = F.max_by(F.struct("_op", *columns), "__n").alias("__last")
    change = F.max_by(F.struct("_revision", F.when(F.col("action") != "insert", F.col("_at")).alias("_updated")), F.when(effective, F.col("__n"))).alias("__change")
    made = F.max_by("_at", F.when(F.col("action") == "insert", F.col("__n"))).alias("__made")
    ends = kept.groupBy("_id").agg(last, change, made, F.first("__created").alias("__created"), F.max(effective).alias("__any")).filter("__any")
    rows = ends.select("_id", "__change.*", F.coalesce("__made", "__created").alias("_created"), *[F.col(f"__last.{c}").alias(c) for c in columns], (F.col("__last._op") == "delete").alias("__gone"))
    log = kept.filter(effective).select("_revision", F.lit(txn).alias("_txn"), F.col("_id").alias("_rid"), F.col("_at").alias("datetime"), "action", "data")
    return rows.select(*[F.col(c).cast(current.schema[c].dataType).alias(c) for c in current.columns], "__gone"), log


def stream_apply_changes(source: DataFrame, state: State, model: str, checkpoint: str, by: Sequence[str] = ()) -> StreamingQuery:
    """A stream of changes into a current table and its changelog (tables ``current`` and ``log`` of the state): :func:`replay`
    of each batch. The log's ``_id`` go on without gaps, in the order of time inside a batch."""

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        ids = cut(batch.select("_id").distinct())
        if not ids.isEmpty():
            rows, log = replay(state.read("current", number, ids), batch, model, f"batch-{number}", by)
            state.write("current", number, rows)
            start = state.spark.range(1).select(F.lit(state.rows_before("log", number)).cast("long").alias("__start"))
            state.write("log", number, history.numbered(log, start))
        batch.unpersist()

    return _start(source, step, checkpoint)


def differences(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The rows of ``after`` that ``before`` has not, and those that went, with ``__gone``."""
    columns = after.columns
    b = before.select(F.col(key).alias("__b"), F.struct(*columns).alias("__before"))
    a = after.select(F.col(key).alias("__a"), F.struct(*columns).alias("__after"))
    changed = a.join(b, F.col("__a") == F.col("__b"), "full_outer").filter(~F.col("__after").eqNullSafe(F.col("__before")))
    return changed.select(F.coalesce("__after", "__before").alias("__row"), F.col("__after").isNull().alias("__gone")).select("__row.*", "__gone")


def stream_keymap_sync(source: DataFrame, state: State, columns: Sequence[str], checkpoint: str) -> StreamingQuery:
    """A stream of changelog entries into the keymap (table ``keymap``); the checkpoint keeps the cursor."""

    def step(batch: DataFrame, number: int) -> None:
        ids = cut(batch.select("_rid").distinct())
        if not ids.isEmpty():
            known = state.read("keymap", number, ids)
            synced, _ = keymap.sync(known, batch, columns, cursor=-1)
            state.write("keymap", number, differences(known, synced, "key"))

    return _start(source, step, checkpoint)


def stream_push_delta(source: DataFrame, state: State, emit: Callable[[DataFrame, int], DataFrame | None], checkpoint: str, key: str = "_id", by: str = "_at") -> StreamingQuery:
    """Rows that are new or changed by their checksum go to ``emit``; the push state is the table ``state``.

    ``emit`` gets the delta and the batch's number, and should be idempotent by it, as a batch may come twice after a
    failure. It may return what came of the rows: ``id, error`` and, if the target gives them, ``revision``; rows without
    result, and all if it returns nothing, count as pushed.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        ids = cut(batch.select(F.col(key).cast("string").alias("id")).distinct())
        if not ids.isEmpty():
            last = sync.last_results(batch, by, key=key).drop(by)
            at = F.lit(batch.agg(F.max(by)).first()[0])
            known = cut(state.read("state", number, ids))
            delta = cut(sync.push_delta(last, known, key).filter("op in ('insert', 'patch')"))
            came = emit(delta, number)
            results = delta.withColumn("error", F.lit(False))
            if came is not None:
                came = came.select("id", F.col("error").alias("__error"), *([F.col("revision").alias("__revision")] if "revision" in came.columns else []))
                results = delta.join(sync.last_results(came), "id", "left").withColumn("error", F.coalesce("__error", F.lit(False)))
                if "__revision" in results.columns:
                    results = results.withColumn("revision", F.coalesce("__revision", "revision"))
            saved = sync.save_push_state(known, results.select("id", "op", "revision", "checksum", "error", "data"), at)
            state.write("state", number, differences(known, saved, "id"))
        batch.unpersist()

    return _start(source, step, checkpoint)


def fault_tolerant_write(df: DataFrame, checks: Sequence[DataFrame], max_errors: int = MAX_ERRORS, row_id: str = "_id") -> tuple[DataFrame, DataFrame]:
    """The good rows and the violations; more bad rows than ``max_errors`` fail the whole batch before anything is written."""
    good, found = check_all(df, checks, row_id)
    n = found.select("_id").distinct().limit(max_errors + 1).count()
    if n > max_errors:
        raise TableError(f"more than {max_errors} rows are bad")
    return good, found


def staged_write(df: DataFrame, path: str, bad: Column, max_errors: int = MAX_ERRORS) -> tuple[DataFrame, DataFrame]:
    """Writes a table in one pass, bad rows (``bad`` true) beside the good ones, and publishes it only if few are bad.

    Rows are read once: they go to a folder beside ``path``, and the write counts the bad ones as they pass. With more than
    ``max_errors`` the folder is deleted and an error raised, else it is renamed to ``path``, which must not exist. Gives the
    good and the bad rows as read from there.
    """
    spark, seen = df.sparkSession, Observation()
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    target, place = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, staged))
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(target):
        raise TableError(f"{path} exists")
    marked = df.withColumn("__bad", F.coalesce(bad, F.lit(False))).observe(seen, F.count_if("__bad").alias("bad"))
    marked.write.partitionBy("__bad").parquet(staged)
    if seen.get["bad"] > max_errors:
        system.delete(place, True)
        raise TableError(f"more than {max_errors} rows are bad")
    if not system.rename(place, target):
        raise TableError(f"{path} can't be written")
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__bad", T.BooleanType())])).parquet(path)
    return rows.filter("not __bad").drop("__bad"), rows.filter("__bad").drop("__bad")
