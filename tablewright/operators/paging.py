"""Sorting with nulls last going up and first going down, limits, keyset pages, and windows over keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nested import resolve, value_of
from ..model import TableError
from ..runtime import cut

PAGE_SIZE = 100_000


def order(df: DataFrame, *keys: str) -> list[Column]:
    """Sort columns of ``a``, ``+a`` (up, nulls last) and ``-a`` (down, nulls first); a list sorts by its least item."""
    out = []
    for key in keys:
        leaf = resolve(df, key.lstrip("+-"))
        value = value_of(leaf.steps)
        if "[]" in leaf.steps or isinstance(leaf.dtype, T.ArrayType):
            value = F.array_min(value)
        out.append(value.desc_nulls_first() if key.startswith("-") else value.asc_nulls_last())
    return out


def sort(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*order(df, *keys))


def limit(df: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    """Rows after ``offset``, ``n`` at most. The frame should be in a total order."""
    if n is not None and n <= 0:
        raise TableError("a limit must be above 0")
    if offset < 0:
        raise TableError("an offset can't be below 0")
    out = df.offset(offset) if offset else df
    return out if n is None else out.limit(n)


def top_k(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first ``k`` rows in an order; each task keeps ``k`` only."""
    return limit(sort(df, *keys), k)


def after(df: DataFrame, keys: Sequence[str], values: Sequence[object]) -> Column:
    """Rows behind the cursor: for some key, all earlier ones are equal and it is beyond.

    Beyond is, going up: greater or null, and nothing if the cursor is null; going down: less, or not null if the cursor is null.
    """
    branches: list[Column] = []
    equal: list[Column] = []
    for key, value in zip(keys, values, strict=True):
        column = value_of(resolve(df, key.lstrip("+-")).steps)
        down = key.startswith("-")
        if value is None:
            beyond = column.isNotNull() if down else None
        else:
            beyond = column < F.lit(value) if down else (column > F.lit(value)) | column.isNull()
        if beyond is not None:
            branches.append(reduce(lambda a, b: a & b, [*equal, beyond]))
        equal.append(column.isNull() if value is None else column == F.lit(value))
    return reduce(lambda a, b: a | b, branches) if branches else F.lit(False)


def page_after(df: DataFrame, keys: Sequence[str], values: Sequence[object] | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """The next page in the order of ``keys`` behind the cursor ``values``; the first one without."""
    rows = df if values is None else df.filter(after(df, keys, values))
    return limit(sort(rows, *keys), size)


def page_token(df: DataFrame, keys: Sequence[str]) -> Column:
    """The cursor behind a row: urlsafe base64 of the JSON list of its keys."""
    names = [k.lstrip("+-") for k in keys]
    fields = [F.coalesce(F.regexp_extract(F.to_json(F.struct(value_of(resolve(df, n).steps).alias("v"))), r'^\{"v":(.*)\}$', 1), F.lit("")) for n in names]
    known = [F.when(f == "", F.lit("null")).otherwise(f) for f in fields]
    text = F.concat(F.lit("["), F.concat_ws(",", *known), F.lit("]"))
    return F.translate(F.base64(text.cast("binary")), "+/", "-_")


def page_values(token: Column) -> Column:
    """The keys of a cursor, as an array of JSON texts."""
    return F.from_json(F.decode(F.unbase64(F.translate(token, "-_", "+/")), "UTF-8"), "array<string>")


def _key_groups(df: DataFrame, keys: Sequence[str], size: int) -> tuple[DataFrame, list[str]]:
    """Every value of the page keys once: ``rows``, the place of its first row in the order (``first``, from 1) and the
    ``page`` of that; and the names of the keys.

    Rows of a key are counted before the shuffle. The keys are dealt out by ranges of the order and kept there; counts
    per range give each its first place, so no task sees more than a range.
    """
    if size <= 0:
        raise TableError("a page must hold rows")
    names = [k.lstrip("+-") for k in keys]
    items = []
    for name in names:
        leaf = resolve(df, name)
        value = value_of(leaf.steps)
        items.append((F.array_min(value) if "[]" in leaf.steps or isinstance(leaf.dtype, T.ArrayType) else value).alias(name))
    quoted = [F.col(f"`{n}`") for n in names]
    groups = df.select(*items).groupBy(*quoted).agg(F.count(F.lit(1)).alias("rows"))
    by = [q.desc_nulls_first() if k.startswith("-") else q.asc_nulls_last() for k, q in zip(keys, quoted, strict=True)]
    placed = cut(groups.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__part").agg(F.sum("rows").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("__start") + F.coalesce(F.sum("rows").over(inside), F.lit(0)) + 1
    found = placed.join(F.broadcast(starts), "__part").select(*quoted, "rows", first.alias("first"))
    return found.withColumn("page", F.expr(f"(first - 1) div {int(size)} + 1")), names


def check_page_keys(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Key values cut by the edge of a page: ``keys, rows, page, before``, with the rows that lie ``before`` its first cut,
    which ends ``page``. Read page after page, the rows behind the cut would never come.

    Pages hold ``size`` rows in the order of ``keys``. No rows are given exactly if paging by these keys loses none, as
    with unique keys; else read by :func:`page_cuts` or :func:`all_pages`, or end the keys with a unique one.
    """
    groups, names = _key_groups(df, keys, size)
    edge = F.col("page") * size
    return groups.filter(F.col("first") + F.col("rows") - 1 > edge).select(*[F.col(f"`{n}`") for n in names], "rows", "page", (edge - F.col("first") + 1).alias("before"))


def page_cuts(df: DataFrame, keys: Sequence[str], size: int = PAGE_SIZE) -> DataFrame:
    """The table of pages: ``page, first, rows`` and the keys of each page's last rows, the cursor behind it.

    A page takes in the whole keys that begin in its ``size`` places, so no key is cut and no row lost; it may be longer
    than ``size`` by the rest of its last key, and pages within a longer key are left out. With unique keys all are full.
    """
    groups, names = _key_groups(df, keys, size)
    last = F.max_by(F.struct(*[F.col(f"`{n}`") for n in names]), "first")
    pages = groups.groupBy("page").agg(F.min("first").alias("first"), F.sum("rows").alias("rows"), last.alias("__last"))
    return pages.select("page", "first", "rows", *[F.col(f"__last.`{n}`").alias(n) for n in names])


def page_between(df: DataFrame, keys: Sequence[str], behind: Sequence[object] | None, last: Sequence[object]) -> DataFrame:
    """The rows of one page of :func:`page_cuts`: behind one cursor, not behind the next. Any pages can be read at once."""
    rows = df if behind is None else df.filter(after(df, keys, behind))
    return rows.filter(~F.coalesce(after(df, keys, last), F.lit(False)))


def all_pages(df: DataFrame, keys: Sequence[str], size: int = PAGE_SIZE) -> DataFrame:
    """Every row once, with its ``page`` of :func:`page_cuts`, all pages in one plan."""
    groups, names = _key_groups(df, keys, size)
    known = groups.select(*[F.col(f"`{n}`").alias(f"__k{i}") for i, n in enumerate(names)], F.col("page").alias("__page"))
    same = F.lit(True)
    for i, name in enumerate(names):
        leaf = resolve(df, name)
        value = value_of(leaf.steps)
        value = F.array_min(value) if "[]" in leaf.steps or isinstance(leaf.dtype, T.ArrayType) else value
        same = same & value.eqNullSafe(F.col(f"__k{i}"))
    return df.join(known, same).select(*df.columns, F.col("__page").alias("page"))


def latest_per_key(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per key: the first in the order ``by`` (such as ``-ts``)."""
    window = Window.partitionBy(*keys).orderBy(*order(df, *by))
    return df.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


def rank_duplicates(df: DataFrame, keys: Sequence[str], by: Sequence[str], target: str = "_id") -> DataFrame:
    """Adds ``rank`` (1: the first in the order ``by``) and ``primary``, the first row's ``target``."""
    window = Window.partitionBy(*keys).orderBy(*order(df, *by))
    return df.withColumns({"rank": F.row_number().over(window), "primary": F.first(target).over(window)})


def distinct(df: DataFrame, pk: Sequence[str] | None = None) -> DataFrame:
    """Rows once: by the key, where the least row in column order stays, or as a whole."""
    if not pk:
        return df.distinct()
    return latest_per_key(df, pk, [c for c in df.columns if c not in pk]) if len(pk) < len(df.columns) else df.distinct()


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, columns matched by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
