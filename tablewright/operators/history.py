"""Writes and their history: patches, insert, update, upsert, delete, move, and the changelog.

A table's rows have ``_id, _revision, _created, _updated`` and data columns. Every operator takes the current rows and
a frame of changes and returns new frames; none writes in place, so batch and stream share them. Ids and revisions are
hashes of what they name, so a task that runs twice gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nested import resolve, value_of
from ..model import RESERVED, Catalog, TableError
from ..runtime import cut
from .paging import latest_per_key

LOG_SCHEMA = "_id long, _revision string, _txn string, _rid string, datetime timestamp, action string, data string"


class Written(NamedTuple):
    """The new current rows, the rows to append to the changelog (without ``_id``), and what was refused (``_id, code``)."""

    current: DataFrame
    log: DataFrame
    errors: DataFrame


def stable_id(model: str, *key: Column) -> Column:
    """An id like a version 5 UUID: SHA-1 of the model's name and the key's values, each with its length; null and empty text differ."""
    texts = [F.lit(model), *[k.cast("string") for k in key]]
    h = F.sha1(F.concat(*[F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("~")) for x in texts]).cast("binary"))
    variant = F.substring(F.lit("89ab"), 1 + F.pmod(F.ascii(F.substring(h, 17, 1)), F.lit(4)), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in RESERVED and not c.startswith("_")]


def as_text(value: Column, dtype: T.DataType) -> Column:
    return F.to_json(value) if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string")


def build_patch(given: DataFrame, saved: DataFrame, action: str, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """What a write changes: ``_id, found, _patch`` (map of changed column to its new text) and the resulting columns.

    ``given`` has ``_id``, typed data columns and, for what is not given in a row, their names in ``_absent`` (array).
    insert and update fill absent columns by ``defaults`` or null; patch leaves them. Objects and lists are compared and
    replaced whole, a null list counts as empty. Nothing changed gives an empty patch.
    """
    joined = given.alias("g").join(saved.alias("s"), F.col("g._id") == F.col("s._id"), "left")
    return _compared(joined, given.columns, saved, action, defaults)


def _compared(joined: DataFrame, given: Sequence[str], saved: DataFrame, action: str, defaults: Mapping[str, object] | None = None, ident: Column | None = None, also: Sequence[str] = ()) -> DataFrame:
    """:func:`build_patch` of rows that have a given row ``g`` and a saved one ``s`` side by side, or null for that."""
    columns, defaults = data_columns(saved), dict(defaults or {})
    absent = F.coalesce(F.col("g._absent"), F.array().cast("array<string>")) if "_absent" in given else F.array().cast("array<string>")
    found = F.col("s._id").isNotNull()
    values, entries = {}, []
    for c in columns:
        dtype, old = saved.schema[c].dataType, F.col(f"s.{c}")
        empty = F.array().cast(dtype) if isinstance(dtype, T.ArrayType) else F.lit(None).cast(dtype)
        new = F.col(f"g.{c}") if c in given else F.lit(None).cast(dtype)
        new = F.coalesce(new, empty) if isinstance(dtype, T.ArrayType) else new
        missing = F.array_contains(absent, c) if c in given else F.lit(True)
        filler = old if action == "patch" else F.lit(defaults[c]).cast(dtype) if c in defaults else empty
        value = F.when(missing, filler).otherwise(new)
        values[c] = value.alias(c)
        entries.append(F.when(~value.eqNullSafe(F.when(found, old).otherwise(F.lit(None).cast(dtype))), F.struct(F.lit(c).alias("key"), as_text(value, dtype).alias("value"))))
    patch = F.map_from_entries(F.filter(F.array(*entries), lambda x: x.isNotNull()))
    kept = [F.col(f"s.{c}").alias(c) for c in ("_created", "_revision", "_updated") if c in saved.columns]
    asked = [F.col("g._revision").alias("_asked")] if "_revision" in given else [F.lit(None).cast("string").alias("_asked")]
    ident = F.col("g._id") if ident is None else ident
    return joined.select(ident.alias("_id"), found.alias("found"), patch.alias("_patch"), *values.values(), *kept, *asked, *also)


def _log(patched: DataFrame, action: str | Column, txn: str, at: Column) -> DataFrame:
    action = F.lit(action) if isinstance(action, str) else action
    return patched.select("_revision", F.lit(txn).alias("_txn"), F.col("_id").alias("_rid"), at.alias("datetime"), action.alias("action"), F.to_json("_patch", {"ignoreNullFields": "false"}).alias("data"))


def _revision(txn: str) -> Column:
    return stable_id("revision", F.lit(txn), F.col("_id"), F.to_json("_patch"))


def _once(given: DataFrame, *keys: Column) -> DataFrame:
    """Given rows by key: the keys ``__k0, ...``, how many rows have them (``__given``) and one of them (``g``)."""
    return given.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__given"), F.first(F.struct(*given.columns)).alias("g"))


def _replaced(current: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with the rows of these ids instead of its own."""
    new = rows.select(F.col("_id").alias("__id"), F.struct(*current.columns).alias("__new"))
    joined = current.join(new, F.col("_id") == F.col("__id"), "left")
    return joined.select(*[F.when(F.col("__id").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in current.columns])


def _as_rows(current: DataFrame, patched: DataFrame) -> DataFrame:
    return patched.select(*[F.col(c).cast(current.schema[c].dataType).alias(c) for c in current.columns])


def _inserted(current: DataFrame, given: DataFrame, model: str, txn: str, at: Column, defaults: Mapping[str, object] | None) -> Written:
    """:func:`insert` with the new rows alone as ``current``."""
    columns = data_columns(current)
    if "_id" not in given.columns:
        given = given.withColumn("_id", F.lit(None).cast("string"))
    texts = [F.col(c).cast("string") if not isinstance(given.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.to_json(c) for c in columns if c in given.columns]
    named = given.withColumn("_id", F.coalesce("_id", stable_id(model, *texts)))
    joined = _once(named, F.col("_id")).join(current.alias("s"), F.col("__k0") == F.col("s._id"), "left")
    labelled = cut(_compared(joined, given.columns, current, "insert", defaults, also=["__given"]))
    code = F.when(F.col("__given") > 1, "repeated").when(F.col("found"), "exists")
    fresh = labelled.filter(code.isNull()).withColumn("_revision", _revision(txn)).withColumns({"_created": at, "_updated": F.lit(None).cast("timestamp")})
    return Written(_as_rows(current, fresh), _log(fresh, "insert", txn, at), labelled.select("_id", code.alias("code")).filter("code is not null"))


def insert(current: DataFrame, given: DataFrame, model: str, txn: str, at: Column, defaults: Mapping[str, object] | None = None) -> Written:
    """New rows; a missing ``_id`` is hashed from the data. An ``_id`` that exists is refused (``exists``).

    Several given rows of one ``_id`` are refused too (``repeated``).
    """
    added = _inserted(current, given, model, txn, at, defaults)
    return Written(current.unionByName(added.current), added.log, added.errors)


def drop_redirects(redirects: DataFrame, inserted: DataFrame) -> DataFrame:
    """Redirects without those of ids that were inserted again."""
    return redirects.join(inserted.select("_id"), "_id", "left_anti").select(*redirects.columns)


def update(current: DataFrame, given: DataFrame, txn: str, at: Column, action: str = "patch", defaults: Mapping[str, object] | None = None) -> Written:
    """Saved rows with their patch. Unknown ids (``not-found``) and other revisions than asked for (``conflict``) are refused.

    So are all given rows of an ``_id`` that several of them have (``repeated``). An empty patch changes nothing and is
    not logged.
    """
    joined = _once(given, F.col("_id")).join(current.alias("s"), F.col("__k0") == F.col("s._id"), "left")
    return _updated(current, cut(_compared(joined, given.columns, current, action, defaults, also=["__given"])), txn, at, action)


def _updated(current: DataFrame, labelled: DataFrame, txn: str, at: Column, action: str) -> Written:
    """What compared rows make; ``__given`` is how many given rows meant the saved one, and ``__code`` what refuses them before."""
    conflict = F.col("found") & F.col("_asked").isNotNull() & (F.col("_asked") != F.col("_revision"))
    before = F.col("__code") if "__code" in labelled.columns else F.lit(None).cast("string")
    code = F.when(before.isNotNull(), before).when(F.col("__given") > 1, "repeated").when(~F.col("found"), "not-found").when(conflict, "conflict")
    good = labelled.filter(code.isNull() & (F.size("_patch") > 0)).withColumn("_revision", _revision(txn)).withColumn("_updated", at)
    errors = labelled.select("_id", code.alias("code")).filter("code is not null")
    return Written(_replaced(current, _as_rows(current, good)), _log(good, action, txn, at), errors)


def _same(keys: Sequence[str], prefix: str, other: Callable[[int, str], Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{prefix}{i}").eqNullSafe(other(i, k)) for i, k in enumerate(keys)])


def upsert(current: DataFrame, given: DataFrame, keys: Sequence[str], model: str, txn: str, at: Column, defaults: Mapping[str, object] | None = None) -> Written:
    """By natural keys: no match inserts, one patches, several are refused (``multiple``).

    Keys that several given rows have are refused too (``repeated``, with the ``_id`` of the row that has them, if any).
    A null in a key equals a null. Given rows meet the table once, and only its rows with their keys are grouped.
    """
    plain = [c for c in given.columns if c != "_id"]
    asked = _once(given.select(*plain), *[F.col(k) for k in keys])
    hit = current.join(asked.select(*[F.col(f"__k{i}").alias(f"__q{i}") for i in range(len(keys))]), _same(keys, "__q", lambda i, k: F.col(k)), "left_semi")
    saved = hit.groupBy(*[F.col(k).alias(f"__m{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__n"), F.min("_id").alias("__least"), F.first(F.struct(*current.columns)).alias("s"))
    met = cut(asked.join(saved, _same(keys, "__k", lambda i, k: F.col(f"__m{i}")), "left"))
    code = F.when(F.col("__given") > 1, "repeated").when(F.col("__n") > 1, "multiple")
    added = _inserted(current, met.filter(code.isNull() & F.col("__n").isNull()).select("g.*"), model, txn, at, defaults)
    known = _compared(met.filter(code.isNull() & (F.col("__n") == 1)), plain, current, "patch", defaults, F.col("s._id"), ["__given"])
    patched = _updated(current, known, txn, at, "patch")
    errors = met.select(F.col("__least").alias("_id"), code.alias("code")).filter("code is not null")
    return Written(patched.current.unionByName(added.current), added.log.unionByName(patched.log), errors.unionByName(added.errors).unionByName(patched.errors))


#: Most shapes of predicates that one batch of rows may bring.
MAX_SHAPES = 100
#: Most given rows without an equality in their predicate; each of them meets every row.
MAX_LOOSE = 1_000
_OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda c, v: c.eqNullSafe(v),
    "ne": lambda c, v: F.when(v.isNull(), c.isNotNull()).otherwise(c != v),
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "startswith": lambda c, v: c.startswith(v),
    "contains": lambda c, v: F.contains(c, v),
}


class _Shape(NamedTuple):
    """Given rows whose predicates have the same paths and operators: ``__row, g, __bad, __by_id`` and their values ``__v0, ...``."""

    asked: DataFrame
    terms: list[tuple[str, Column]]


def _shapes(current: DataFrame, given: DataFrame) -> tuple[DataFrame, list[_Shape]]:
    """Given rows with ``__row``, and by shape, each term as its operator and the column it is about."""
    rows = cut(given.withColumn("__row", F.monotonically_increasing_id()))
    shape = F.array_join(F.transform("_where", lambda x: F.concat_ws(" ", x["op"], x["path"])), "\n")
    rows = rows.withColumn("__shape", F.coalesce(shape, F.lit("")))
    shapes = [r[0] for r in rows.select("__shape").distinct().limit(MAX_SHAPES + 1).collect()]
    if len(shapes) > MAX_SHAPES:
        raise TableError(f"more than {MAX_SHAPES} shapes of predicates")
    out = []
    for text in shapes:
        part, terms = rows.filter(F.col("__shape") == text), [line.split(" ", 1) for line in text.split("\n")] if text else []
        bad, found = F.lit(False), []
        values: dict[str, Column] = {}
        for i, (op, path) in enumerate(terms):
            if op not in _OPERATORS:
                raise TableError(f"unknown operator {op}")
            leaf = resolve(current, path)
            if "[]" in leaf.steps or isinstance(leaf.dtype, (T.StructType, T.ArrayType, T.MapType)):
                raise TableError(f"{path} isn't a single value")
            raw = F.get("_where", F.lit(i))["value"]
            values[f"__v{i}"] = raw.try_cast(leaf.dtype)
            bad = bad | (raw.isNotNull() & raw.try_cast(leaf.dtype).isNull())
            found.append((op, value_of(leaf.steps)))
        by_id = F.lit(any(path == "_id" and op == "eq" for op, path in terms))
        asked = part.select("__row", F.struct(*given.columns).alias("g"), bad.alias("__bad"), by_id.alias("__by_id"), *[v.alias(k) for k, v in values.items()])
        if not any(op == "eq" for op, _ in terms):
            if asked.limit(MAX_LOOSE + 1).count() > MAX_LOOSE:
                raise TableError(f"more than {MAX_LOOSE} rows have no equality in their predicate")
            asked = F.broadcast(asked)
        out.append(_Shape(asked, found))
    return rows, out


def _hits(current: DataFrame, shape: _Shape) -> DataFrame:
    """``__row`` and ``s`` of every hit: equalities are the keys of a join, the rest its residual condition."""
    conditions = [_OPERATORS[op](column, F.col(f"__v{i}")) for i, (op, column) in enumerate(shape.terms)]
    saved = current.withColumn("s", F.struct(*current.columns))
    return saved.join(shape.asked, reduce(lambda a, b: a & b, conditions, ~F.col("__bad"))).select("__row", "s")


def match_where(current: DataFrame, given: DataFrame) -> DataFrame:
    """Given rows with what their own predicates find: ``__row, g, s, __bad, __by_id``, a row for each hit, ``s`` null without one.

    ``_where`` is a list of ``path, op, value`` (texts) that all must hold; ``eq`` and ``ne`` take null as a value. Rows are
    grouped by the shape of their predicate, the paths and operators. Of each shape the equalities are the keys of one
    join and the rest its residual condition; rows without equality are broadcast if they are few, else refused whole.
    ``__bad`` marks values that aren't of their column's type, which find nothing.
    """
    rows, shapes = _shapes(current, given)
    out: DataFrame | None = None
    for shape in shapes:
        met = shape.asked.select("__row", "g", "__bad", "__by_id").join(_hits(current, shape), "__row", "left")
        out = met if out is None else out.unionByName(met)
    return out if out is not None else rows.select("__row", F.struct(*given.columns).alias("g"), F.lit(None).cast(current.schema).alias("s"), F.lit(False).alias("__bad"), F.lit(False).alias("__by_id")).limit(0)


def _interval(shape: _Shape) -> tuple[list[int], int | None, int | None] | None:
    """The places of the equalities, of the lower and of the upper bound, if the shape has equalities and else at most one
    bound of each kind, of the same column."""
    keys = [i for i, (op, _) in enumerate(shape.terms) if op == "eq"]
    lower = [i for i, (op, _) in enumerate(shape.terms) if op in ("ge", "gt")]
    upper = [i for i, (op, _) in enumerate(shape.terms) if op in ("le", "lt")]
    bounds = lower + upper
    if not keys or len(keys) + len(bounds) < len(shape.terms) or len(lower) > 1 or len(upper) > 1:
        return None
    if len(bounds) == 2 and str(shape.terms[bounds[0]][1]) != str(shape.terms[bounds[1]][1]):
        return None
    return keys, (lower or [None])[0], (upper or [None])[0]


def _counted_intervals(current: DataFrame, shape: _Shape, keys: list[int], lower: int | None, upper: int | None) -> tuple[DataFrame, DataFrame]:
    """:func:`_counted_hits` without making the hits, which may be as many as pairs of rows.

    With the same keys, what a given row finds lies between two places of the column's order. Saved rows and both ends of
    every given row are put in one order, by ranges of it; running counts over the ranges tell how many saved rows lie
    between two ends, which is the first of them, and how many given rows lie around a saved one.
    """
    bound = lower if lower is not None else upper
    column = shape.terms[bound][1] if bound is not None else F.lit(0)
    names = [f"__k{i}" for i in range(len(keys))]
    given_keys = [F.col(f"__v{i}").alias(n) for i, n in zip(keys, names, strict=True)]
    low, high = (F.col(f"__v{i}") if i is not None else F.lit(None).cast("int") for i in (lower, upper))
    # at one value: 0 before the saved rows, 1 the saved rows, 2 after them; ends that are open lie before and behind all values
    low_side, low_tie = (F.lit(0), F.lit(0)) if lower is None else (F.lit(1), F.lit(0 if shape.terms[lower][0] == "ge" else 2))
    high_side, high_tie = (F.lit(2), F.lit(0)) if upper is None else (F.lit(1), F.lit(0 if shape.terms[upper][0] == "lt" else 2))
    good = ~F.col("__bad")
    for i, value in ((lower, low), (upper, high)):
        good = good & value.isNotNull() if i is not None else good
    if lower is not None and upper is not None:
        good = good & ((low < high) | ((low == high) & (low_tie < high_tie)))
    ends = shape.asked.filter(good)
    saved = current.select(*[shape.terms[i][1].alias(n) for i, n in zip(keys, names, strict=True)], column.alias("__x"), "_id")
    saved = saved.filter("__x is not null").select(*names, F.lit(1).alias("__side"), "__x", F.lit(1).alias("__tie"), F.col("_id").alias("__hit"), F.lit(None).cast("long").alias("__row"), F.lit(0).alias("__step"))
    kind, text = saved.schema["__x"].dataType, saved.schema["__hit"].dataType
    open_ = lambda value, i: value.cast(kind) if i is not None else F.lit(None).cast(kind)
    starts = ends.select(*given_keys, low_side.alias("__side"), open_(low, lower).alias("__x"), low_tie.alias("__tie"), F.lit(None).cast(text).alias("__hit"), "__row", F.lit(1).alias("__step"))
    stops = ends.select(*given_keys, high_side.alias("__side"), open_(high, upper).alias("__x"), high_tie.alias("__tie"), F.lit(None).cast(text).alias("__hit"), "__row", F.lit(-1).alias("__step"))
    by = [*names, "__side", "__x", "__tie", "__hit"]
    # the place of a row is its range above bit 33 and its number there below
    ranges = int(current.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = saved.unionByName(starts).unionByName(stops).repartitionByRange(ranges, *by, "__row").sortWithinPartitions(*by, "__row")
    placed = cut(events.withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"__part": F.shiftright("__at", 33), "__is": (F.col("__step") == 0).cast("long")})
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges only
    before = placed.groupBy("__part").agg(F.sum("__is").alias("__i"), F.sum("__step").alias("__s")).select("__part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(n) for c, n in (("__i", "__is0"), ("__s", "__open0"))])
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumns({"__place": F.sum("__is").over(inside), "__open": F.sum("__step").over(inside)}).join(F.broadcast(before), "__part")
    run = cut(run.select("__hit", "__row", "__step", (F.col("__place") + F.col("__is0")).alias("__place"), (F.col("__open") + F.col("__open0")).alias("__given")))
    given = run.filter("__step = 0 and __given > 0").select("__hit", "__given")
    spans = run.filter("__step <> 0").groupBy("__row").agg(F.sum(-F.col("__step") * F.col("__place")).alias("__n"), F.min("__place").alias("__first")).filter("__n > 0")
    first = run.filter("__step = 0").select(F.col("__place").alias("__at"), "__hit")
    per = spans.join(first, F.col("__first") + 1 == F.col("__at")).select("__row", "__n", "__hit")
    return per, given


def _counted_hits(current: DataFrame, shape: _Shape) -> tuple[DataFrame, DataFrame]:
    """Of given rows that find any: ``__row``, how many (``__n``) and the ``_id`` of one (``__hit``); of saved rows that are found:
    ``__hit`` and by how many (``__given``)."""
    if (interval := _interval(shape)) is not None:
        return _counted_intervals(current, shape, *interval)
    hits = cut(_hits(current, shape).select("__row", F.col("s._id").alias("__hit")))
    per = hits.groupBy("__row").agg(F.count(F.lit(1)).alias("__n"), F.min("__hit").alias("__hit"))
    return per, hits.groupBy("__hit").agg(F.count(F.lit(1)).alias("__given"))


def _wanted_id() -> Column:
    """The id that a predicate asks for, if any."""
    return F.get(F.filter("g._where", lambda x: (x["path"] == "_id") & (x["op"] == "eq")), F.lit(0))["value"]


def update_where(current: DataFrame, given: DataFrame, txn: str, at: Column, action: str = "patch", defaults: Mapping[str, object] | None = None) -> Written:
    """Like :func:`update`, each given row for all rows that its ``_where`` finds (:func:`match_where`).

    Refused are predicates by ``_id`` that find nothing (``not-found``), values of a wrong type (``invalid``), other revisions
    (``conflict``) and rows that several given ones find (``repeated``). Other predicates that find nothing do nothing.
    """
    plain = [c for c in given.columns if c not in ("_id", "_where")]
    met = match_where(current, given).filter("s is not null or __bad or __by_id")
    counts = met.filter("s is not null").groupBy(F.col("s._id").alias("__hit")).agg(F.count(F.lit(1)).alias("__given"))
    met = met.join(counts, F.col("s._id") == F.col("__hit"), "left").withColumn("__code", F.when(F.col("__bad"), "invalid"))
    labelled = cut(_compared(met, plain, current, action, defaults, F.coalesce(F.col("s._id"), _wanted_id()), ["__given", "__code"]))
    done = _updated(current, labelled, txn, at, action)
    return done._replace(errors=done.errors.distinct())


def upsert_where(current: DataFrame, given: DataFrame, model: str, txn: str, at: Column, defaults: Mapping[str, object] | None = None) -> Written:
    """Like :func:`upsert`, by each given row's own ``_where``: no hit inserts, one patches, several are refused (``multiple``).

    A row that several given ones find is refused for all of them (``repeated``), a value of a wrong type too (``invalid``).
    Hits are counted and not made where the predicate is equalities and a range of one column (:func:`_counted_intervals`).
    """
    plain = [c for c in given.columns if c not in ("_id", "_where")]
    rows, shapes = _shapes(current, given)
    none = rows.select("__row", F.struct(*given.columns).alias("g"), F.lit(False).alias("__bad"), F.lit(0).cast("long").alias("__n"), F.lit(None).cast("string").alias("__hit"), F.lit(0).cast("long").alias("__given")).limit(0)
    counted = [(none.select("__row", "__n", "__hit"), none.select("__hit", "__given")), *[_counted_hits(current, shape) for shape in shapes]]
    asked = reduce(DataFrame.unionByName, [none.select("__row", "g", "__bad"), *[shape.asked.select("__row", "g", "__bad") for shape in shapes]])
    per = reduce(DataFrame.unionByName, [p for p, _ in counted])
    counts = reduce(DataFrame.unionByName, [c for _, c in counted]).groupBy("__hit").agg(F.sum("__given").alias("__given"))
    saved = current.select(F.col("_id").alias("__id"), F.struct(*current.columns).alias("s"))
    found = per.join(counts, "__hit").join(saved, F.col("__hit") == F.col("__id")).select("__row", "__n", "__given", "s")
    met = cut(asked.join(found, "__row", "left").withColumn("__n", F.coalesce("__n", F.lit(0))))
    code = F.when(F.col("__bad"), "invalid").when(F.col("__n") > 1, "multiple")
    new = met.filter(code.isNull() & (F.col("__n") == 0)).select("g.*").drop("_where")
    added = _inserted(current, new, model, txn, at, defaults)
    known = _compared(met.filter(code.isNull() & (F.col("__n") == 1)), plain, current, "patch", defaults, F.col("s._id"), ["__given"])
    patched = _updated(current, known, txn, at, "patch")
    errors = met.select(F.coalesce(F.col("s._id"), _wanted_id()).alias("_id"), code.alias("code")).filter("code is not null")
    errors = errors.unionByName(added.errors).unionByName(patched.errors.distinct())
    return Written(patched.current.unionByName(added.current), added.log.unionByName(patched.log), errors)


def delete(current: DataFrame, ids: DataFrame, txn: str, at: Column) -> Written:
    """Without the rows of ``ids`` (``_id``); unknown ids are refused (``not-found``)."""
    asked = ids.select("_id").distinct()
    gone = asked.join(current.select("_id"), "_id", "left_semi").withColumn("_patch", F.create_map().cast("map<string,string>"))
    errors = asked.join(current.select("_id"), "_id", "left_anti").select("_id", F.lit("not-found").alias("code"))
    return Written(current.join(asked, "_id", "left_anti").select(*current.columns), _log(gone.withColumn("_revision", _revision(txn)), "delete", txn, at), errors)


def _follow(redirects: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Redirects after enough doubled steps to reach every end, with the least id passed; and those that never end, if any."""
    known = cut(redirects.select("_id", "redirect", F.least("_id", "redirect").alias("least")))
    for _ in range(known.count().bit_length()):
        after = known.select(F.col("_id").alias("__id"), F.col("redirect").alias("__next"), F.col("least").alias("__least"))
        joined = known.join(after, F.col("redirect") == F.col("__id"), "left")
        if joined.filter("__id is not null").isEmpty():
            return known, None
        known = cut(joined.select("_id", F.coalesce("__next", "redirect").alias("redirect"), F.least("least", "__least").alias("least")))
    endless = known.join(known.select(F.col("_id").alias("__source")), F.col("redirect") == F.col("__source"), "left_semi")
    return known, endless


def find_cycles(redirects: DataFrame) -> DataFrame:
    """``_id, cycle``: the ids that come back to themselves, and the least id of their round. Each ``_id`` has one redirect.

    After more steps than there are redirects, what hasn't ended is on a cycle, and every place of one is reached.
    """
    known, endless = _follow(redirects)
    if endless is None:
        return known.select("_id", F.col("least").alias("cycle")).limit(0)
    reached = endless.select(F.col("redirect").alias("__on")).distinct()
    return known.join(reached, F.col("_id") == F.col("__on"), "left_semi").select("_id", F.col("least").alias("cycle"))


def resolve_redirects(redirects: DataFrame) -> DataFrame:
    """Redirects (``_id, redirect``) led to their ends; each round doubles the steps. What leads into a cycle is left out,
    and of several redirects of one ``_id`` the least counts; :func:`move` refuses both.
    """
    known, endless = _follow(redirects.groupBy("_id").agg(F.min("redirect").alias("redirect")))
    ends = known.select("_id", "redirect")
    return ends if endless is None else ends.join(endless.select(F.col("_id").alias("__source")), F.col("_id") == F.col("__source"), "left_anti")


def redirected(df: DataFrame, column: str, redirects: DataFrame) -> DataFrame:
    """The column's ids replaced by where they were moved to. ``redirects`` are resolved."""
    r = redirects.select(F.col("_id").alias("__from"), F.col("redirect").alias("__to"))
    return df.join(r, F.col(column) == F.col("__from"), "left").withColumn(column, F.coalesce("__to", column)).drop("__from", "__to")


def move(catalog: Catalog, model: str, moves: DataFrame, redirects: DataFrame | None = None) -> tuple[Catalog, DataFrame, DataFrame]:
    """Rows merged into others: the catalog with moved rows gone and all references repointed, redirects, and errors.

    ``moves`` has ``_id, redirect``. Refused (``_id, code``, each once) are all moves of an ``_id`` that several rows name
    (``repeated``), of a row to itself (``self``), of rows (``unknown``) and to targets (``not-found``) that don't exist,
    and those that come back to their start over others (``cycle``); a move into such a cycle is good, as its target
    stays. Earlier redirects follow.
    """
    table = catalog[model]
    keys = table.df.select(F.col(table.key).alias("__key")).distinct()
    asked = moves.groupBy("_id").agg(F.count(F.lit(1)).alias("__n"), F.min("redirect").alias("redirect"))
    asked = asked.join(keys.withColumn("__source", F.lit(True)), F.col("_id") == F.col("__key"), "left").drop("__key")
    asked = asked.join(keys.withColumn("__target", F.lit(True)), F.col("redirect") == F.col("__key"), "left").drop("__key")
    code = F.when(F.col("__n") > 1, "repeated").when(F.col("_id") == F.col("redirect"), "self").when(F.col("__source").isNull(), "unknown").when(F.col("__target").isNull(), "not-found")
    judged = cut(asked.select("_id", "redirect", code.alias("code")))
    good = judged.filter("code is null").select("_id", "redirect")
    cycles = find_cycles(good).select("_id", F.lit("cycle").alias("code"))
    bad = judged.filter("code is not null").select("_id", "code").unionByName(cycles)
    good = good.join(cycles.select("_id"), "_id", "left_anti")
    merged = good if redirects is None else good.unionByName(redirects.join(good.select("_id"), "_id", "left_anti").select("_id", "redirect"))
    ends = resolve_redirects(merged)
    out: Catalog = {}
    for name, t in catalog.items():
        df = t.df.join(ends.select(F.col("_id").alias("__gone")), F.col(t.key) == F.col("__gone"), "left_anti") if name == model else t.df
        for fk, target in t.refs.items():
            if target == model:
                df = redirected(df, fk, ends).select(*t.df.columns)
        out[name] = t.__class__(df, t.key, t.refs, t.row_filter)
    return out, ends, bad


def wipe(current: DataFrame) -> DataFrame:
    """The table without rows; write it over the old one, and over its changelog and redirects."""
    return current.limit(0)


def numbered(rows: DataFrame, start: DataFrame) -> DataFrame:
    """The rows with ``_id`` from ``start`` (one row, ``__start``) on, without gaps, in the order of time, then row, then revision.

    The rows are dealt out by ranges of that order and cut there, with their place inside the range: once written, it
    can't change any more. Counts per range give each its first number, so no row is shuffled again.
    """
    by = ["datetime", "_rid", "_revision"]
    at = F.monotonically_increasing_id()  # the range above bit 33, the place in it below
    placed = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", at))
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__k", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    joined = placed.join(F.broadcast(first), "__part").join(F.broadcast(start))
    return joined.select((F.col("__start") + F.col("__first") + F.col("__k")).alias("_id"), *[c for c in rows.columns if c != "_id"])


def changelog_append(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with the rows appended, ``_id`` going on without gaps."""
    return log.unionByName(numbered(rows, log.agg(F.coalesce(F.max("_id"), F.lit(0)).alias("__start"))))


def changes(log: DataFrame, rid: str | None = None, offset: int | None = None, limit: int = 100) -> DataFrame:
    """Changes in order: from ``_id`` offset on, or the last ones if it is below 0. A move shows ``_same_as``."""
    rows = log if rid is None else log.filter(F.col("_rid") == rid)
    if offset is not None and offset >= 0:
        rows = rows.filter(F.col("_id") >= offset)
    elif offset is not None:
        last = rows.agg(F.max("_id").alias("__last"))
        rows = rows.join(F.broadcast(last)).filter(F.col("_id") > F.col("__last") + offset).drop("__last")
    target = F.when(F.col("action") == "move", F.get_json_object("data", "$._id"))
    return rows.withColumn("_same_as", target).orderBy("_id").limit(limit)


def state_from_changelog(log: DataFrame) -> DataFrame:
    """``_rid, action, data``: the latest value of every key of every row as a map, and the row's last action."""
    rows = log.select("_id", "_rid", "action", F.from_json("data", "map<string,string>").alias("data"))
    last = rows.groupBy("_rid").agg(F.max_by("action", "_id").alias("action"))
    values = rows.select("_id", "_rid", F.explode_outer("data").alias("key", "value")).filter("key is not null")  # parses each text once
    latest = values.groupBy("_rid", "key").agg(F.max_by("value", "_id").alias("value"))
    maps = latest.groupBy("_rid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("data"))
    return last.join(maps, "_rid", "left")


def find_corrupt_changelog(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``_id, redirect``: rows whose natural keys a newer row has too, without a move; none if the log holds no delete.

    A row's keys are the latest that its inserts and changes tell, and the row they told last is the newest; a delete
    changes neither. Keys that a row never named and keys that it set to null differ. Rows moved last are left out.
    """
    data = F.from_json("data", "map<string,string>")
    told = log.withColumn("__d", F.when(~F.col("action").isin("delete", "move"), data))
    named = [F.coalesce(F.map_contains_key("__d", k), F.lit(False)) for k in keys]
    latest = [F.max_by(F.when(has, F.struct(F.col("__d")[k].alias("v"))), F.when(has, F.col("_id"))).alias(f"k{i}") for i, (k, has) in enumerate(zip(keys, named, strict=True))]
    last = F.max(F.when(F.array_contains(F.array(*named), True), F.col("_id"))).alias("last")
    state = told.groupBy("_rid").agg(*latest, last, F.max_by("action", "_id").alias("action")).filter("last is not null and action <> 'move'")
    rows = state.select("_rid", "last", F.to_json(F.struct(*[f"k{i}" for i in range(len(keys))])).alias("keys"))
    newest = rows.groupBy("keys").agg(F.max_by("_rid", "last").alias("redirect"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    deleted = log.filter("action = 'delete'").limit(1).select(F.lit(True))
    return rows.join(newest, "keys").filter("_rid <> redirect").join(F.broadcast(deleted)).select(F.col("_rid").alias("_id"), "redirect")


def repair_changelog(log: DataFrame, keys: Sequence[str], txn: str, at: Column) -> DataFrame:
    """The log with a move to the newest row appended for each row that :func:`find_corrupt_changelog` finds.

    ``keymap.sync`` takes the moves on to the keymap. A repaired log has nothing more to repair.
    """
    found = find_corrupt_changelog(log, keys).withColumn("_revision", stable_id("revision", F.lit(txn), F.col("_id"), F.col("redirect")))
    moves = found.select("_revision", F.lit(txn).alias("_txn"), F.col("_id").alias("_rid"), at.alias("datetime"), F.lit("move").alias("action"), F.to_json(F.struct(F.col("redirect").alias("_id"))).alias("data"))
    return changelog_append(log, moves)


def deduplicate(catalog: Catalog, model: str, keys: Sequence[str], by: Sequence[str]) -> tuple[Catalog, DataFrame, DataFrame]:
    """Duplicates of the keys merged into the first row in the order ``by``; then the keys are unique."""
    table = catalog[model]
    first = latest_per_key(table.df, keys, by).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(table.key).alias("redirect"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    moves = table.df.join(first, condition).filter(F.col(table.key) != F.col("redirect")).select(F.col(table.key).alias("_id"), "redirect")
    return move(catalog, model, cut(moves))


def latest_change(log: DataFrame, rid: str | None = None) -> DataFrame:
    """The last change of a row, or of the table: revision and time."""
    rows = log if rid is None else log.filter(F.col("_rid") == rid)
    last = F.max_by(F.struct("_revision", "datetime"), "_id")
    return rows.agg(last.alias("x")).filter("x is not null").select("x.*")


def array_rewrite(items: DataFrame, changed: DataFrame, name: str, txn: str) -> DataFrame:
    """A list table (``_txn, _rid, item``) with the lists of changed rows (``_id`` and list ``name``) written anew."""
    kept = items.join(changed.select(F.col("_id").alias("_rid")), "_rid", "left_anti").select("_txn", "_rid", "item")
    return kept.unionByName(changed.select(F.lit(txn).alias("_txn"), F.col("_id").alias("_rid"), F.explode(name).alias("item")))


def require(errors: DataFrame) -> None:
    """Fails on the first refused row, for callers that want all or nothing."""
    first = errors.first()
    if first is not None:
        raise TableError(f"{first['code']}: {first['_id']}")
