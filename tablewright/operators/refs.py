"""References: left outer joins along paths, natural keys, base models, back references and links."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Field, all_of, keep_missing_ref
from ..model import Catalog, TableError
from ..runtime import cut
from .paging import limit, sort

#: Holds whether a referenced row passes its model's own filter.
PASSES = "__passes"


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}.{c}") for c in df.columns])


def join_ref(df: DataFrame, ref: str, target: DataFrame, key: str) -> DataFrame:
    """The target's columns as ``ref.column``; rows without a target stay. ``key`` is unique in the target."""
    return df.join(_named(target, ref), F.col(f"`{ref}`") == F.col(f"`{ref}.{key}`"), "left")


def join_path(catalog: Catalog, model: str, paths: Sequence[str]) -> DataFrame:
    """The model's rows with every path ``ref.ref.column`` as a column of that name. One join per distinct prefix."""
    df, joined = catalog[model].df, {}
    for path in paths:
        *refs, last = path.split(".")
        at, prefix = model, ""
        for ref in refs:
            table = catalog[at]
            if ref not in table.refs:
                raise TableError(f"{at}.{ref} is no reference")
            prefix = f"{prefix}.{ref}" if prefix else ref
            at = table.refs[ref]
            if prefix not in joined:
                joined[prefix] = at
                df = join_ref(df, prefix, catalog[at].df, catalog[at].key)
        if f"{prefix}.{last}".lstrip(".") not in df.columns:
            raise TableError(f"unknown column {path!r}")
    return df


def search(
    catalog: Catalog, model: str, paths: Sequence[str], where: Callable[[DataFrame], Column] | None = None, order: Sequence[str] = (), size: int | None = None, offset: int = 0
) -> DataFrame:
    """Filter, sort and cut a model's rows on paths through its references; returns the paths."""
    df = join_path(catalog, model, [p.lstrip("+-") for p in (*paths, *order)])
    df = df.filter(where(df)) if where else df
    df = sort(df, *order) if order else df
    df = limit(df, size, offset) if size or offset else df
    return df.select(*[F.col(f"`{p}`").alias(p.replace(".", "_")) for p in paths])


#: Most tasks that one join of blocks takes.
MAX_TASKS = 20_000
#: Pairs of one key that a task may make; the rows of a key with more are dealt out in blocks, on each side of at most its root.
BLOCK_PAIRS = 16_000_000


def join_ref_keys(df: DataFrame, ref: str, target: DataFrame, on: Sequence[tuple[str | Column, str]], most: int = BLOCK_PAIRS) -> DataFrame:
    """Left join on composite natural keys: pairs of own column, or a literal column, and target column.

    Keys that aren't unique make as many pairs as their rows say. Those with more than ``most`` are cut in blocks of own and
    target rows, each block of one side meeting each of the other, so that a task makes about ``most`` pairs whatever the key.
    """
    t = _named(target, ref)
    own = [F.col(f"`{o}`") if isinstance(o, str) else o for o, _ in on]
    theirs = [F.col(f"`{ref}.{c}`") for _, c in on]
    names = [f"__k{i}" for i in range(len(on))]
    many = lambda side, keys, n: side.groupBy(*[k.alias(c) for k, c in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias(n))
    counts = many(df, own, "__own").join(many(t, theirs, "__theirs"), names)  # nulls meet nothing
    hot = cut(counts.filter(F.col("__own") * F.col("__theirs") > most))
    side = math.isqrt(most)
    hot = hot.select(*names, F.ceil(F.col("__own") / side).cast("int").alias("__a"), F.ceil(F.col("__theirs") / side).cast("int").alias("__b"))
    blocks = hot.agg(F.sum(F.col("__a").cast("long") * F.col("__b"))).first()[0]
    if not blocks:
        return df.join(t, all_of(*[o == c for o, c in zip(own, theirs, strict=True)]), "left")
    marked = lambda rows, keys: rows.join(hot, all_of(*[k == F.col(c) for k, c in zip(keys, names, strict=True)]), "left")
    place = lambda rows, parts: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    mine, other = marked(df, own), marked(t, theirs)
    plain = mine.filter("__a is null").select(*[F.col(f"`{c}`") for c in df.columns])
    plain = plain.join(other.filter("__a is null").select(*[F.col(f"`{c}`") for c in t.columns]), all_of(*[o == c for o, c in zip(own, theirs, strict=True)]), "left")
    mine = mine.filter("__a is not null").withColumns({"__i": place(df, "__a"), "__j": every("__b")})
    other = other.filter("__a is not null").withColumns({"__j": place(t, "__b"), "__i": every("__a")})
    # adaptive execution leaves a number of partitions as it is if it was given, so the tasks grow with the pairs
    block, tasks = [*names, "__i", "__j"], min(blocks, MAX_TASKS)
    left, right = [x.repartition(tasks, *block).select(*block, F.struct(*[F.col(f"`{c}`") for c in columns]).alias(n)) for x, columns, n in ((mine, df.columns, "__l"), (other, t.columns, "__r"))]
    pairs = left.join(right.hint("shuffle_hash"), block)
    return plain.unionByName(pairs.select(*[F.col(f"__l.`{c}`").alias(c) for c in df.columns], *[F.col(f"__r.`{c}`").alias(c) for c in t.columns]))


def join_base(df: DataFrame, base: DataFrame, on: str = "_id") -> DataFrame:
    """Columns inherited from the base model's row of the same id; own values come first where both have one."""
    b = base.select(F.col(on).alias("__on"), *[F.col(f"`{c}`").alias(f"__base_{c}") for c in base.columns if c != on])
    joined = df.join(b, F.col(on) == F.col("__on"), "left")
    own = [F.coalesce(F.col(f"`{c}`"), F.col(f"`__base_{c}`")).alias(c) if c != on and c in base.columns else F.col(f"`{c}`") for c in df.columns]
    return joined.select(*own, *[F.col(f"`__base_{c}`").alias(c) for c in base.columns if c not in df.columns])


def join_backref(df: DataFrame, key: str, child: DataFrame, fk: str, name: str) -> DataFrame:
    """The one child row that refers to each row, its columns as ``name.column``."""
    return df.join(_named(child, name), F.col(f"`{key}`") == F.col(f"`{name}.{fk}`"), "left")


def join_backref_array(df: DataFrame, key: str, child: DataFrame, fk: str, columns: Sequence[str], name: str) -> DataFrame:
    """The children that refer to each row, as a sorted list of structs; empty without any.

    Children are gathered before the join, so the join is one to one. A list column of keys is unrolled first.
    """
    rows = child
    if dict(child.dtypes)[fk].startswith("array"):
        rows = child.withColumn(fk, F.explode(fk))
    gathered = rows.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("__fk")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    joined = df.join(gathered, F.col(key) == F.col("__fk"), "left").drop("__fk")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType)))


def group_array(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """The values of each group as a sorted list; several columns give a list of lists."""
    item = F.col(columns[0]) if len(columns) == 1 else F.array(*columns)
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias(name))


def join_m2m_array(df: DataFrame, key: str, link: DataFrame, left: str, right: Sequence[str], name: str) -> DataFrame:
    """The right keys of a link table for each row, as a sorted list; empty without links."""
    gathered = group_array(link.filter(F.col(left).isNotNull()), [left], right, name).withColumnRenamed(left, "__left")
    joined = df.join(gathered, F.col(key) == F.col("__left"), "left").drop("__left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType)))


def semi_by_list(df: DataFrame, key: str, items: DataFrame, rid: str, where: Column) -> DataFrame:
    """Rows of which some list row matches."""
    return df.join(items.filter(where).select(F.col(rid).alias("__rid")), F.col(key) == F.col("__rid"), "left_semi")


def anti_by_list(df: DataFrame, key: str, items: DataFrame, rid: str, where: Column) -> DataFrame:
    """Rows of which no list row matches."""
    return df.join(items.filter(where).select(F.col(rid).alias("__rid")), F.col(key) == F.col("__rid"), "left_anti")


def resolve_ref_ids(df: DataFrame, keys: Sequence[str], keymap: DataFrame, target: DataFrame, target_keys: Sequence[str], name: str) -> DataFrame:
    """Natural keys of a reference as ids: from the keymap (``target_keys, _id``), else from the one target row.

    Adds ``name`` and ``name_error``: null keys give a null reference; no or several target rows an error text. Of
    several ids that the keymap has for the same keys the newest live one counts: ids with a ``redirect`` are left out,
    then the latest ``modified_at`` wins, if the keymap has these columns, then the least id. So each row stays one.
    """
    live = keymap.filter(F.col("redirect").isNull()) if "redirect" in keymap.columns else keymap
    newest = F.min("_id") if "modified_at" not in keymap.columns else F.min_by("_id", F.struct(F.coalesce(-F.unix_micros("modified_at"), F.lit(2**63 - 1)), "_id"))
    known = live.groupBy(*[F.col(t).alias(f"__k{i}") for i, t in enumerate(target_keys)]).agg(newest.alias("__known"))
    found = target.groupBy(*[F.col(t).alias(f"__t{i}") for i, t in enumerate(target_keys)]).agg(F.count(F.lit(1)).alias("__rows"), F.min("_id").alias("__found"))
    out = df.join(known, all_of(*[F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)]), "left")
    out = out.join(found, all_of(*[F.col(k) == F.col(f"__t{i}") for i, k in enumerate(keys)]), "left")
    empty = all_of(*[F.col(k).isNull() for k in keys])
    ref = F.when(empty, F.lit(None)).otherwise(F.coalesce("__known", F.when(F.col("__rows") == 1, F.col("__found"))))
    error = F.when(~empty & F.col("__known").isNull(), F.when(F.col("__rows").isNull(), F.lit("not found")).when(F.col("__rows") > 1, F.lit("more than one")))
    return out.select(*df.columns, ref.alias(name), error.alias(f"{name}_error"))


def full_outer_sync(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, side`` (left, right, both) and both rows as structs ``left`` and ``right``."""
    left = a.select(F.col(key).alias("__a"), F.struct(*a.columns).alias("left"))
    right = b.select(F.col(key).alias("__b"), F.struct(*b.columns).alias("right"))
    side = F.when(F.col("__b").isNull(), "left").when(F.col("__a").isNull(), "right").otherwise("both")
    return left.join(right, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), side.alias("side"), "left", "right")


def inherit_ref_filters(catalog: Catalog, model: str) -> DataFrame:
    """The model's rows with its own filter and, through every chain of references, the filters of referenced models.

    A filter lets pass what has no referenced row, or none with a value to compare, and each chain stops where it comes back to a model it passed.
    """
    df = catalog[model].df
    conditions: list[Column] = []
    if catalog[model].row_filter:
        conditions.append(catalog[model].row_filter(df))
    columns = df.columns

    def reaches(at: str, seen: tuple[str, ...]) -> bool:
        """Whether the chain from ``at`` leads to a filter; only then its joins are made."""
        return catalog[at].row_filter is not None or any(t not in seen and reaches(t, (*seen, t)) for t in catalog[at].refs.values())

    def walk(at: str, prefix: str, seen: tuple[str, ...]) -> None:
        nonlocal df
        for ref, target in catalog[at].refs.items():
            if target in seen or not reaches(target, (*seen, target)):
                continue
            path = f"{prefix}.{ref}" if prefix else ref
            own = catalog[target].df
            if catalog[target].row_filter:
                own = own.withColumn(PASSES, catalog[target].row_filter(own))
            df = join_ref(df, path, own, catalog[target].key)
            if catalog[target].row_filter:
                conditions.append(keep_missing_ref(F.col(f"`{path}.{PASSES}`"), F.col(f"`{path}.{PASSES}`")))
            walk(target, path, (*seen, target))

    walk(model, "", (model,))
    return df.filter(all_of(*conditions)).select(*[F.col(f"`{c}`") for c in columns])


def enum_access_filter(df: DataFrame, column: str, enum: dict[object, str], access: str) -> DataFrame:
    """Rows whose value is declared with this access level or a more open one. ``enum``: value to level."""
    from ..model import ACCESS

    least = ACCESS.index(access)
    return df.filter(Field(df, column).eq([v for v, level in enum.items() if ACCESS.index(level) >= least]))


def merged_filters(df: DataFrame, *filters: Callable[[DataFrame], Column] | None) -> DataFrame:
    """Model, request, enum and reference filters, one after the other; Spark merges them into one."""
    for condition in filters:
        df = df.filter(condition(df)) if condition else df
    return df
