"""Checks and profiles. A check gives its violations as rows ``model, _id, property, code, value``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import DATE, DATETIME, INTEGER, NUMBER, TIME, URL, UUID, is_national_id
from ..functions.predicates import axis
from ..model import Model, Property, TableError
from ..runtime import cut

PHONE = r"(?:\+370|\b8)[ -]?(?:\(?[0-9]{1,3}\)?[ -]?)?[0-9]{2,3}[ -]?[0-9]{2,5}"
EMAIL = r"(?d)^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"  # (?d): only a line feed may follow
URIS = {"email": "pii:email", "phone": "pii:phone", "id": "pii:id"}


def _violations(df: DataFrame, model: str, row_id: str, prop: str, code: str, bad: Column, value: Column | None = None) -> DataFrame:
    shown = (F.col(f"`{prop}`") if value is None else value).cast("string")
    return df.filter(bad).select(F.lit(model).alias("model"), F.col(row_id).cast("string").alias("_id"), F.lit(prop).alias("property"), F.lit(code).alias("code"), shown.alias("value"))


def _stacked(df: DataFrame, model: str, row_id: str, tests: Sequence[tuple[str, str, Column, Column]]) -> DataFrame:
    """Several tests (property, code, bad, value) of each row in one pass."""
    found = [F.when(bad, F.struct(F.lit(prop).alias("property"), F.lit(code).alias("code"), value.cast("string").alias("value"))) for prop, code, bad, value in tests]
    rows = df.select(F.col(row_id).cast("string").alias("_id"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("v"))
    return rows.select(F.lit(model).alias("model"), "_id", "v.property", "v.code", "v.value")


def fits(column: Column, dtype: str) -> Column:
    """Whether text has the form of a type; null fits."""
    word = F.lower(column)
    tests = {
        "integer": column.rlike(INTEGER) & column.try_cast("long").isNotNull(),
        "number": column.rlike(NUMBER),
        "boolean": word.isin("true", "1", "on", "yes", "false", "0", "off", "no", ""),
        "date": (column == "") | (column.rlike(DATE) & column.try_cast("date").isNotNull()),
        "time": (column == "") | column.rlike(TIME),
        "datetime": (column == "") | (column.rlike(DATETIME) & column.try_cast("timestamp").isNotNull()),
        "uuid": column.rlike(UUID),
        "binary": F.try_to_binary(column, F.lit("base64")).isNotNull(),
        "url": column.rlike(URL),
    }
    return column.isNull() | tests.get(dtype, F.lit(True))


def check_types(df: DataFrame, model: Model, row_id: str = "_id") -> DataFrame:
    """Text values that don't have the form of their declared type; one pass over all columns."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    tests = [(p.name, f"type:{p.dtype}", ~fits(F.col(p.name), p.dtype), F.col(p.name)) for p in model.properties if p.name in text and p.name in df.columns]
    if not tests:
        raise TableError(f"{model.name} has no text column to check")
    return _stacked(df, model.name, row_id, tests)


def check_required(df: DataFrame, model: Model, row_id: str = "_id") -> DataFrame:
    """Null, or missing, required properties."""
    tests = [(p.name, "required", F.col(p.name).isNull() if p.name in df.columns else F.lit(True), F.lit(None)) for p in model.properties if p.required]
    if not tests:
        raise TableError(f"{model.name} has no required property")
    return _stacked(df, model.name, row_id, tests)


def check_unique(df: DataFrame, keys: Sequence[str], model: str, row_id: str = "_id") -> DataFrame:
    """Every row whose key another row has too; keys with a null are never equal."""
    from .summary import find_duplicates

    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    name = ",".join(keys)
    return find_duplicates(df.filter(whole), keys).select(F.lit(model).alias("model"), F.col(row_id).cast("string").alias("_id"), F.lit(name).alias("property"), F.lit("unique").alias("code"), F.concat_ws(",", *keys).alias("value"))


def check_refs(df: DataFrame, fk: str, target: DataFrame, key: str, model: str, row_id: str = "_id") -> DataFrame:
    """References to rows that don't exist; null refers to nothing and is fine."""
    missing = df.filter(F.col(fk).isNotNull()).join(target.select(F.col(key).alias("__key")), F.col(fk) == F.col("__key"), "left_anti")
    return _violations(missing, model, row_id, fk, "ref", F.lit(True))


def check_ref_objects(df: DataFrame, ref: str, model: str, row_id: str = "_id") -> DataFrame:
    """Reference objects that are given but whose id is null."""
    if not isinstance(df.schema[ref].dataType, T.StructType):
        raise TableError(f"{ref!r} is no object")
    return _violations(df, model, row_id, ref, "ref-null", F.col(ref).isNotNull() & F.col(f"{ref}._id").isNull(), F.lit(None))


def check_enum(df: DataFrame, prop: Property, model: str) -> DataFrame:
    """``model, property, value``: distinct values outside the enum; null only where the property is required.

    An enum entry may be a pair (old, new): the old value then counts as the new one.
    """
    swaps = {k: v for k, v in (prop.enum or {}).items() if v is not None}
    allowed = [*(prop.enum or {}), *swaps.values()]
    values = df.select(F.col(prop.name).cast("string").alias("value")).distinct()
    known = F.col("value").isin([str(v) for v in allowed])
    bad = F.when(F.col("value").isNull(), F.lit(prop.required)).otherwise(~known)
    return values.filter(bad).select(F.lit(model).alias("model"), F.lit(prop.name).alias("property"), "value")


def check_uuid(df: DataFrame, column: str, model: str, row_id: str = "_id") -> DataFrame:
    return _violations(df, model, row_id, column, "uuid", F.col(column).isNotNull() & ~F.col(column).rlike(UUID))


def check_object_keys(df: DataFrame, column: str, declared: Sequence[str], model: str, row_id: str = "_id", code: str = "unknown-key") -> DataFrame:
    """Keys of a map that aren't declared, one row each; for texts these are languages."""
    extra = df.select(F.col(row_id).cast("string").alias("_id"), F.explode(F.array_except(F.map_keys(column), F.array(*[F.lit(d) for d in declared]))).alias("value"))
    return extra.select(F.lit(model).alias("model"), "_id", F.lit(column).alias("property"), F.lit(code).alias("code"), "value")


def check_langs(df: DataFrame, column: str, langs: Sequence[str], model: str, row_id: str = "_id") -> DataFrame:
    return check_object_keys(df, column, langs, model, row_id, "unknown-language")


def check_readonly(given: DataFrame, columns: Sequence[str], model: str, row_id: str = "_id") -> DataFrame:
    """Values given for back references, which can't be written."""
    return _stacked(given, model, row_id, [(c, "read-only", F.col(c).isNotNull(), F.lit(None)) for c in columns])


def check_base_values(df: DataFrame, base: DataFrame, columns: Sequence[str], model: str, row_id: str = "_id") -> DataFrame:
    """Inherited values that differ from the base row's."""
    b = base.select(F.col(row_id).alias("__id"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(b, F.col(row_id) == F.col("__id"))
    return _stacked(joined, model, row_id, [(c, "base", F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"__{c}")), F.col(c)) for c in columns])


def check_bounds(df: DataFrame, geom: str, bounds: tuple[float, float, float, float], model: str, row_id: str = "_id") -> DataFrame:
    """Geometries with a coordinate on or beyond the bounds (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = bounds
    inside = F.forall(axis(F.col(geom), 0), lambda v: (v > x0) & (v < x1)) & F.forall(axis(F.col(geom), 1), lambda v: (v > y0) & (v < y1))
    return _violations(df, model, row_id, geom, "bounds", F.col(geom).isNotNull() & ~F.coalesce(inside, F.lit(False)))


def check_all(df: DataFrame, checks: Sequence[DataFrame], row_id: str = "_id") -> tuple[DataFrame, DataFrame]:
    """The rows without violation, and all violations."""
    found = reduce(lambda a, b: a.unionByName(b), checks)
    bad = found.select(F.col("_id").alias("__bad")).distinct()
    return df.join(bad, F.col(row_id).cast("string") == F.col("__bad"), "left_anti"), found


def detect_pii(df: DataFrame, threshold: float = 0.5, today: Column | None = None) -> DataFrame:
    """``column, id, email, phone, uri`` of text columns: how many cells are personal codes, addresses and phone numbers.

    Each non-null cell goes to the first that fits, so a share is of the cells that none before it took; it is null
    where there are no such cells. The tag is that of the last share above the threshold.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    tests = {"id": lambda c: is_national_id(c, today), "email": lambda c: c.rlike(EMAIL), "phone": lambda c: c.rlike(PHONE)}
    classes = {}
    for i, name in enumerate(names):  # each cell is put in its class once; only classes are counted
        cell = F.col(f"`{name}`")
        kind = F.when(cell.isNull(), F.lit(None).cast("string"))
        for k, test in tests.items():
            kind = kind.when(test(cell), F.lit(k))
        classes[f"c{i}"] = kind.otherwise("none").alias(f"c{i}")
    counts = [F.sum((F.col(c) == k).cast("long")).alias(f"{c}_{k}") for c in classes for k in (*tests, "none")]
    one = df.select(*classes.values()).agg(*counts)
    rows = []
    for c, name in zip(classes, names, strict=True):
        left = list((*tests, "none"))
        shares = []
        for k in tests:
            total = sum((F.col(f"{c}_{x}") for x in left[1:]), F.col(f"{c}_{left[0]}"))
            shares.append(F.when(total > 0, F.col(f"{c}_{k}").cast("double") / total).alias(k))
            left.remove(k)
        rows.append(F.struct(F.lit(name).alias("column"), *shares))
    rows = one.select(F.inline(F.array(*rows)))
    uri = F.lit(None).cast("string")
    for k in tests:
        uri = F.when(F.col(k) > threshold, F.lit(URIS[k])).otherwise(uri)
    return rows.withColumn("uri", uri)


#: Types in the order in which they are tried; the first that every non-empty value has is the column's.
INFERRED = {
    "boolean": lambda c: F.lower(c).isin("true", "false"),
    "binary": lambda c: c.rlike("^[01]+$") & (F.length(c) > 1),
    "integer": lambda c: c.rlike(INTEGER),
    "number": lambda c: c.rlike(NUMBER),
    "time": lambda c: c.rlike(TIME),
    "date": lambda c: c.rlike(DATE),
    "datetime": lambda c: c.rlike(DATETIME),
    "url": lambda c: c.rlike(URL),
}


MAY_BE_UNIQUE = 0.5


def infer_schema(df: DataFrame) -> DataFrame:
    """``column, type, required, unique`` of text columns by one aggregation, and a second one for columns that may be unique.

    Empty texts count as absent: required means none is absent, unique that all present values differ. Columns whose
    estimated number of values is below ``MAY_BE_UNIQUE`` of their cells, ten standard errors off, hold repeats.
    """
    flags = []
    for i, name in enumerate(df.columns):
        value = F.when(F.col(f"`{name}`") != "", F.col(f"`{name}`"))
        flags += [F.min(F.when(value.isNotNull(), test(value))).alias(f"{i}_{k}") for k, test in INFERRED.items()]
        flags += [F.count(value).alias(f"{i}_n"), F.count(F.lit(1)).alias(f"{i}_all"), F.approx_count_distinct(value).alias(f"{i}_values")]
    one = cut(df.agg(*flags))
    rows = []
    for i, name in enumerate(df.columns):
        kind = F.when(F.col(f"{i}_n") == 0, F.lit("string"))
        for k in INFERRED:
            kind = kind.when(F.col(f"{i}_{k}"), F.lit(k))
        required = (F.col(f"{i}_n") == F.col(f"{i}_all")) & (F.col(f"{i}_n") > 0)
        rows.append(F.struct(F.lit(name).alias("column"), kind.otherwise("string").alias("type"), required.alias("required")))
    found = one.select(F.inline(F.array(*rows)))
    first = one.first()  # one row of counts
    likely = [name for i, name in enumerate(df.columns) if first[f"{i}_n"] and first[f"{i}_values"] >= MAY_BE_UNIQUE * first[f"{i}_n"]]
    if not likely:
        return found.select("column", "type", "required", F.lit(False).alias("unique"))
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(name).alias("__column"), F.col(f"`{name}`").alias("value")) for name in likely]))).filter("value <> ''")
    most = cells.groupBy("__column", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("__column").agg(F.max("n").alias("most"))
    joined = found.join(most, F.col("column") == F.col("__column"), "left")
    return joined.select("column", "type", "required", F.coalesce(F.col("most") == 1, F.lit(False)).alias("unique"))


def infer_models(schema: T.StructType, name: str) -> dict[str, Model]:
    """Models of nested data: lists of objects become child models with a reference to their parent. Schema work only."""
    kinds = {"bigint": "integer", "int": "integer", "double": "number", "boolean": "boolean", "string": "string", "date": "date", "timestamp": "datetime"}
    found: dict[str, Model] = {}

    def walk(struct: T.StructType, model: str, parent: str | None) -> None:
        props: list[Property] = []

        def add(fields: Sequence[T.StructField], prefix: str) -> None:
            for f in fields:
                path = f"{prefix}{f.name}"
                if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                    walk(f.dataType.elementType, f"{model}/{path}", model)
                elif isinstance(f.dataType, T.StructType):
                    add(f.dataType.fields, f"{path}.")
                else:
                    props.append(Property(path, "array" if isinstance(f.dataType, T.ArrayType) else kinds.get(f.dataType.simpleString(), "string")))

        add(struct.fields, "")
        if parent:
            props.append(Property("parent", "ref", ref=parent))
        found[model] = Model(model, tuple(props))

    walk(schema, name, None)
    return found


def _sql_kind(sql_type: Column) -> Column:
    base = F.lower(F.regexp_extract(sql_type, r"^([A-Za-z ]+)", 1))
    return (
        F.when(base.rlike("^(big|small|tiny)?int|^serial|^interval"), "integer")
        .when(base.rlike("^(numeric|decimal|real|float|double)"), "number")
        .when(base.rlike("^bool"), "boolean")
        .when(base.rlike("^(timestamp|datetime)"), "datetime")
        .when(base == "date", "date")
        .when(base.rlike("^time"), "time")
        .when(base.rlike("^(bytea|blob|binary|varbinary)"), "binary")
        .when(base.rlike("^geometry"), "geometry")
        .otherwise("string")
    )


def infer_refs(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """``table, column, type, pk, ref`` from catalogue rows read by JDBC.

    ``columns``: table, column, sql_type; ``keys``: table, column, kind (``p`` or ``f``), target.
    """
    per = keys.groupBy("table", "column").agg(F.max(F.col("kind") == "p").alias("pk"), F.max(F.when(F.col("kind") == "f", F.col("target"))).alias("ref"))
    joined = columns.join(per, ["table", "column"], "left")
    typed = F.when(F.col("ref").isNotNull(), F.lit("ref")).otherwise(_sql_kind(F.col("sql_type")))
    return joined.select("table", "column", typed.alias("type"), F.coalesce("pk", F.lit(False)).alias("pk"), "ref")


def infer_keys(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Properties of a database's tables with references of one column or several:
    ``table, property, columns, type, pk, ref, refprops, unique``.

    ``columns``: table, column, sql_type. ``constraints``, a row for each column of a key (:data:`.readers.CATALOGUE` reads
    both): table, name, kind (``p``, ``u`` or ``f``), position, column, and for foreign keys target, target_column. Keys are
    lists of columns in the order of their positions. A foreign key of one column makes its column a reference; one of
    several adds a property, named by its columns joined by ``_``. ``refprops`` are the columns that it refers to, empty if
    they are the target's primary key in its order. ``unique`` says whether they are a primary or unique key, in any
    order; null for what is no reference. ``pk`` is the place in the primary key, from 1. Of several foreign keys of
    one column that of the least name counts.
    """
    item = F.struct("position", "column", "target_column")
    lists = constraints.groupBy("table", "name", "kind").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("target").alias("target"))
    lists = lists.withColumns({"keyed": F.transform("items", lambda x: x["column"]), "told": F.transform("items", lambda x: x["target_column"])})
    primary = lists.filter("kind = 'p'").groupBy("table").agg(F.min_by("keyed", "name").alias("__pk"))
    known = lists.filter("kind in ('p', 'u')").select(F.col("table").alias("__of"), F.array_sort("keyed").alias("__key")).distinct()
    foreign = lists.filter("kind = 'f'").join(primary.withColumnRenamed("table", "__t"), F.col("target") == F.col("__t"), "left")
    foreign = foreign.join(known, (F.col("target") == F.col("__of")) & (F.array_sort("told") == F.col("__key")), "left")
    foreign = foreign.select("table", "name", F.col("keyed").alias("columns"), F.col("target").alias("ref"), F.when(F.col("told") == F.col("__pk"), F.array().cast("array<string>")).otherwise(F.col("told")).alias("refprops"), F.col("__key").isNotNull().alias("unique"))
    single = foreign.filter(F.size("columns") == 1).groupBy("table", F.col("columns")[0].alias("column")).agg(F.min_by(F.struct("ref", "refprops", "unique"), "name").alias("__ref"))
    places = primary.select("table", F.posexplode("__pk").alias("__at", "column"))
    joined = columns.join(single, ["table", "column"], "left").join(places, ["table", "column"], "left")
    typed = F.when(F.col("__ref").isNotNull(), F.lit("ref")).otherwise(_sql_kind(F.col("sql_type")))
    own = joined.select("table", F.col("column").alias("property"), F.array("column").alias("columns"), typed.alias("type"), (F.col("__at") + 1).alias("pk"), "__ref.*")
    several = foreign.filter(F.size("columns") > 1).groupBy("table", "columns").agg(F.min_by(F.struct("ref", "refprops", "unique"), "name").alias("__ref"))
    return own.unionByName(several.select("table", F.array_join("columns", "_").alias("property"), "columns", F.lit("ref").alias("type"), F.lit(None).cast("int").alias("pk"), "__ref.*"))


def schema_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("model", "property"), described: Sequence[str] = ("title",)) -> DataFrame:
    """``keys, change`` (added, removed, changed, same) and the merged columns; old descriptions win."""
    columns = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*columns).alias("o"))
    b = new.select(*keys, F.struct(*columns).alias("n"))
    compared = [c for c in columns if c not in described]
    same = reduce(lambda x, y: x & y, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in compared], F.lit(True))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(same, "same").otherwise("changed")
    merged = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) if c in described else F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in columns]
    return a.join(b, list(keys), "full_outer").select(*keys, change.alias("change"), *merged)


def rule_counts(violations: DataFrame) -> DataFrame:
    """``model, property, code, count`` of violations."""
    return violations.groupBy("model", "property", "code").agg(F.count(F.lit(1)).alias("count"))
