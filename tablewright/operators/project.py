"""Projection: paths, lists, references, languages, access, flattening, checksums."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nested import leaves, resolve, value_of
from ..model import ACCESS, RESERVED, Model, Property, TableError


def select(df: DataFrame, *paths: str) -> DataFrame:
    """Columns by dotted path, named by the path; below lists, the list of the values. No path: all columns.

    ``name@lang`` picks a language of a text column. Selecting a text and one of its languages is an error.
    """
    if not paths:
        return df
    texts = {p for p in paths if p in df.columns and isinstance(df.schema[p].dataType, T.MapType)}
    for path in paths:
        if "@" in path and path.split("@")[0] in texts:
            raise TableError(f"{path!r} and the text it belongs to can't both be selected")
    def value(path: str) -> Column:
        leaf = resolve(df, path.replace("@", ".@"))
        found = value_of(leaf.steps)
        return F.flatten(found) if "[]" in leaf.steps and isinstance(leaf.dtype, T.ArrayType) else found

    return df.select(*[value(path).alias(path) for path in paths])


def select_items(df: DataFrame, path: str) -> DataFrame:
    """One column: the values of a path below lists, as one flat list."""
    return select(df, path)


def select_struct(df: DataFrame, *names: str) -> DataFrame:
    """Whole objects, with all their leaves kept nested."""
    for name in names:
        if not isinstance(resolve(df, name).dtype, T.StructType):
            raise TableError(f"{name!r} is no object")
    return select(df, *names)


def ref_struct(prop: Property, columns: dict[str, Column]) -> Column:
    """A reference as a struct: the target's id if it is identifiable, else its natural keys; then denormalised values."""
    keys = ("_id",) if prop.identifiable else prop.refprops
    order = [*keys, *(name for name in columns if name not in {"_id", *prop.refprops})]
    return F.struct(*[columns[name].alias(name) for name in order])


def expand(df: DataFrame, *names: str) -> DataFrame:
    """Empties every list column that is not named; ``*`` names all."""
    if "*" in names:
        return df
    lists = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and f.name not in names}
    return df.withColumns({n: F.array().cast(t) for n, t in lists.items()}) if lists else df


def pick_language(text: Column, accept: Sequence[str], declared: Sequence[str], default: Sequence[str] = ()) -> Column:
    """The first accepted language that has a value, else the first default that is declared, else the first declared."""
    order = [lang for lang in (*accept, *default, *declared) if lang in declared]
    return F.coalesce(*[F.try_element_at(text, F.lit(lang)) for lang in dict.fromkeys(order)])


def select_languages(text: Column, langs: Sequence[str]) -> Column:
    """The map of the wanted languages; ``*`` keeps all."""
    return text if "*" in langs else F.map_filter(text, lambda lang, _: lang.isin(*langs))


def compute(df: DataFrame, name: str, expression: Column | dict | tuple | object) -> DataFrame:
    """A derived column: an expression, a literal, a tuple (list) or a dict (object) of these."""

    def build(value: object) -> Column:
        if isinstance(value, Column):
            return value
        if isinstance(value, dict):
            return F.struct(*[build(v).alias(k) for k, v in value.items()])
        if isinstance(value, (tuple, list)):
            return F.array(*[build(v) for v in value])
        return F.lit(value)

    return df.withColumn(name, build(expression))


def drop_private(df: DataFrame, model: Model, access: str = "protected") -> DataFrame:
    """The columns whose access is the given level or more open; reserved columns stay."""
    least = ACCESS.index(access)
    open_names = {p.name for p in model.properties if ACCESS.index(p.access) >= least}
    return df.select(*[c for c in df.columns if c in RESERVED or c in open_names])


class Scope:
    """A named view: which columns may be used, and a filter that always holds."""

    def __init__(self, df: DataFrame, columns: Iterable[str], row_filter: Column | None = None) -> None:
        self.columns = tuple(columns)
        self.df = (df if row_filter is None else df.filter(row_filter)).select(*self.columns)

    def check(self, *paths: str) -> None:
        for path in paths:
            if path.lstrip("+-").split(".")[0] not in self.columns:
                raise TableError(f"{path!r} is outside the scope")

    def query(self, where: Callable[[DataFrame], Column] | None = None, columns: Sequence[str] = (), sort: Sequence[str] = (), uses: Sequence[str] = ()) -> DataFrame:
        """Filter, sort and select inside the scope. ``uses`` names the columns of ``where``."""
        from .paging import sort as ordered

        self.check(*columns, *sort, *uses)
        out = self.df.filter(where(self.df)) if where else self.df
        out = ordered(out, *sort) if sort else out
        return select(out, *columns)


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Flat rows: objects become ``a.b`` columns, lists ``a[]`` with a row per item, languages ``t@lt`` columns.

    Lists side by side give every combination; an empty or null list keeps the row, with nulls. Languages are columns
    only where :class:`Property` declares them, so a map is flattened by :func:`flatten_languages` first.
    """
    while True:
        lists = [f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
        objects = [f for f in df.schema.fields if isinstance(f.dataType, T.StructType)]
        if not lists and not objects:
            return df
        out = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                out += [F.col(f"`{f.name}`").getField(x).alias(f"{f.name}{separator}{x}") for x in f.dataType.fieldNames()]
            else:
                out.append(F.col(f"`{f.name}`"))
        df = df.select(*out)
        for f in lists:
            others = [F.col(f"`{c}`") for c in df.columns if c != f.name]
            at = df.columns.index(f.name)
            df = df.select(*others[:at], F.explode_outer(F.col(f"`{f.name}`")).alias(f"{f.name}[]"), *others[at:])


def flatten_languages(df: DataFrame, name: str, langs: Sequence[str]) -> DataFrame:
    """A text column as one column per declared language, ``name@lang``."""
    at = df.columns.index(name)
    texts = [F.try_element_at(F.col(f"`{name}`"), F.lit(lang)).alias(f"{name}@{lang}") for lang in langs]
    columns = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*columns[:at], *texts, *columns[at + 1 :])


def nest(df: DataFrame, separator: str = ".") -> DataFrame:
    """Columns ``a.b`` back into objects ``a``; ``a[].b`` into lists of one object, to be gathered by key."""
    tree: dict = {}
    for name in df.columns:
        place = tree
        *parents, last = name.split(separator)
        for parent in parents:
            place = place.setdefault(parent, {})
        place[last] = F.col(f"`{name}`")

    def build(name: str, value: dict | Column) -> Column:
        inner = F.struct(*[build(k, v).alias(k.removesuffix("[]")) for k, v in value.items()]) if isinstance(value, dict) else value
        return F.array(inner) if name.endswith("[]") else inner

    return df.select(*[build(k, v).alias(k.removesuffix("[]")) for k, v in tree.items()])


def _as_text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    if isinstance(dtype, T.BinaryType):
        return F.base64(value)
    return value.cast("string")


def checksum(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-1 over ``path=length:value`` lines of the leaves sorted by path; nulls and reserved columns are left out.

    The length in characters tells a value that holds a line feed from two values.
    """
    wanted = [c for c in (columns or df.columns) if c not in RESERVED]
    parts = []
    for leaf in sorted((x for x in leaves(T.StructType([df.schema[c] for c in wanted]))), key=lambda x: x.path):
        value = value_of(leaf.steps)
        text = F.to_json(value) if "[]" in leaf.steps else _as_text(value, leaf.dtype)
        parts.append(F.concat(F.lit(f"{leaf.path}="), F.length(text).cast("string"), F.lit(":"), text))
    return F.sha1(F.concat_ws("\n", *parts).cast("binary"))


def to_json_safe(df: DataFrame) -> DataFrame:
    """Values that JSON can hold: ISO dates and times, base64 for binary, doubles for decimals."""
    changed = {}
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            changed[f.name] = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            changed[f.name] = F.regexp_replace(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
        elif isinstance(f.dataType, T.BinaryType):
            changed[f.name] = F.base64(column)
        elif isinstance(f.dataType, T.DecimalType):
            changed[f.name] = column.cast("double")
    return df.withColumns(changed) if changed else df
