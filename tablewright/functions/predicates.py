"""Predicates with the publisher's meaning: null values, any-element lists, values coerced to the column's type."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import TableError
from .nested import any_at, leaves, resolve
from .shapes import meets_box

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
ORDERED = (*NUMERIC, T.DateType, T.TimestampType, T.TimestampNTZType)
_ORDER: dict[str, Callable[[Column, Column], Column]] = {
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
}


def literal(dtype: T.DataType, value: object) -> Column:
    """A value as the column's type: ISO text for dates and times, numbers for numbers; else an error."""
    if isinstance(dtype, T.BooleanType) and isinstance(value, bool):
        return F.lit(value)
    if isinstance(dtype, NUMERIC) and isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.lit(value)
    if isinstance(dtype, T.StringType) and isinstance(value, str):
        return F.lit(value)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if isinstance(value, str) and not re.match(r"\d{4}-\d{2}-\d{2}", value):
            raise TableError(f"{value!r} is no ISO date")
        return F.lit(value).cast(dtype)
    raise TableError(f"{value!r} doesn't fit a column of type {dtype.simpleString()}")


class Field:
    """A column, nested or below lists, to build predicates on."""

    def __init__(self, df: DataFrame, path: str, change: Callable[[Column], Column] | None = None, dtype: T.DataType | None = None) -> None:
        leaf = resolve(df, path)
        found, steps = leaf.dtype, leaf.steps
        while isinstance(found, T.ArrayType):  # the list itself stands for its elements
            steps, found = (*steps, "[]"), found.elementType
        self.steps, self.dtype, self.change = steps, dtype or found, change or (lambda c: c)
        self._df, self._path = df, path

    @property
    def in_list(self) -> bool:
        return "[]" in self.steps

    def _any(self, test: Callable[[Column], Column]) -> Column:
        return any_at(self.steps, lambda c: test(self.change(c)))

    def eq(self, value: object) -> Column:
        """Equal; None: is null; bool: is true or false, never null; a list: one of."""
        if value is None:
            return self._any(lambda c: c.isNull())
        if isinstance(value, (list, tuple, set)):
            wanted = [literal(self.dtype, v) for v in value]
            return self._any(lambda c: c.isin(*wanted)) if wanted else F.lit(False)
        wanted = literal(self.dtype, value)
        return self._any(lambda c: c.eqNullSafe(wanted)) if isinstance(value, bool) else self._any(lambda c: c == wanted)

    def ne(self, value: object) -> Column:
        """Unequal, which drops nulls; None: is not null; bool: is not, which keeps nulls; a list: none of.

        Below lists: some element is not null, and none is equal.
        """
        if value is None:
            return self._any(lambda c: c.isNotNull())
        if self.in_list:
            return self._any(lambda c: c.isNotNull()) & ~self.eq(value)
        if isinstance(value, (list, tuple, set)):
            return self._any(lambda c: ~c.isin(*[literal(self.dtype, v) for v in value])) if value else self._any(lambda c: c.isNotNull())
        wanted = literal(self.dtype, value)
        return self._any(lambda c: ~c.eqNullSafe(wanted)) if isinstance(value, bool) else self._any(lambda c: c != wanted)

    def _ordered(self, op: str, value: object) -> Column:
        if not isinstance(self.dtype, ORDERED) or value is None:
            raise TableError(f"{op} needs a number, date or time, and a value that is not null")
        wanted = literal(self.dtype, value)
        return self._any(lambda c: _ORDER[op](c, wanted))

    def lt(self, value: object) -> Column:
        return self._ordered("lt", value)

    def le(self, value: object) -> Column:
        return self._ordered("le", value)

    def gt(self, value: object) -> Column:
        return self._ordered("gt", value)

    def ge(self, value: object) -> Column:
        return self._ordered("ge", value)

    def _text(self, op: str, value: object) -> None:
        if not isinstance(self.dtype, T.StringType) or not isinstance(value, str) or not value:
            raise TableError(f"{op} needs a string column and a needle that is not empty")

    def startswith(self, value: str) -> Column:
        self._text("startswith", value)
        return self._any(lambda c: c.startswith(value))

    def contains(self, value: str) -> Column:
        self._text("contains", value)
        return self._any(lambda c: c.contains(value))

    def lower(self) -> Field:
        return Field(self._df, self._path, lambda c: F.lower(self.change(c)))

    def upper(self) -> Field:
        return Field(self._df, self._path, lambda c: F.upper(self.change(c)))

    def length(self) -> Field:
        return Field(self._df, self._path, lambda c: F.length(self.change(c)), T.IntegerType())


def all_of(*parts: Column | None) -> Column:
    """And of the parts that are given; true for none."""
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True)) if any(p is not None for p in parts) else F.lit(True)


def any_of(*parts: Column | None) -> Column:
    """Or of the parts that are given; true for none, as an empty condition asks for nothing."""
    given = [p for p in parts if p is not None]
    return reduce(lambda a, b: a | b, given) if given else F.lit(True)


def any_value(op: str, field: Field, *values: object) -> Column:
    """Or of one predicate over several values."""
    if not values:
        raise TableError("at least one value is needed")
    return any_of(*[getattr(field, op)(v) for v in values])


def recurse(df: DataFrame, name: str) -> list[Field]:
    """Every leaf of that name, at any depth."""
    found = [leaf.path for leaf in leaves(df.schema) if [s for s in leaf.steps if s != "[]"][-1] == name]
    if not found:
        raise TableError(f"no column is named {name!r}")
    return [Field(df, path) for path in dict.fromkeys(found)]


def recurse_any(df: DataFrame, name: str, op: str, value: object, change: str | None = None) -> Column:
    """Or of a predicate over every leaf of that name; ``change``: lower or upper, on the string ones."""
    fields: Iterable[Field] = recurse(df, name)
    if change:
        fields = [getattr(f, change)() for f in fields if isinstance(f.dtype, T.StringType)]
    return any_of(*[getattr(f, op)(value) for f in fields])


def keep_missing_ref(value: Column, predicate: Column) -> Column:
    """A predicate on a referenced row's ``value`` that lets rows pass which have none."""
    return value.isNull() | predicate


def coordinates(wkt: Column) -> Column:
    """All coordinate pairs of well-known text, as text ``x y``."""
    return F.regexp_extract_all(wkt, F.lit(r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?\s+-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"), F.lit(1))


def axis(wkt: Column, which: int) -> Column:
    """The x (0) or y (1) values of all coordinates."""
    return F.transform(coordinates(wkt), lambda p: F.split(p, r"\s+")[which].cast("double"))


def bbox(wkt: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Whether a geometry meets the box, edges included: exact for points, lines, polygons with holes and collections.

    The envelope is looked at first, so few shapes are compared segment by segment.
    """
    xs, ys = axis(wkt, 0), axis(wkt, 1)
    near = (F.array_max(xs) >= x0) & (F.array_min(xs) <= x1) & (F.array_max(ys) >= y0) & (F.array_min(ys) <= y1)
    return F.when(near, meets_box(wkt, x0, y0, x1, y1)).otherwise(near)
