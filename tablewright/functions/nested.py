"""Walks over nested schemas."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import TableError


class Leaf(NamedTuple):
    """A column that holds no other: ``steps`` are names, ``[]`` for the items of a list."""

    steps: tuple[str, ...]
    dtype: T.DataType

    @property
    def path(self) -> str:
        return ".".join(s for s in self.steps if s != "[]")

    @property
    def label(self) -> str:
        """The flattened name: ``a.b``, lists as ``a[].b``."""
        return ".".join(self.steps).replace(".[]", "[]")


def leaves(dtype: T.DataType, steps: tuple[str, ...] = ()) -> list[Leaf]:
    if isinstance(dtype, T.StructType):
        return [leaf for f in dtype.fields for leaf in leaves(f.dataType, (*steps, f.name))]
    if isinstance(dtype, T.ArrayType):
        return leaves(dtype.elementType, (*steps, "[]"))
    return [Leaf(steps, dtype)]


def resolve(df: DataFrame, path: str) -> Leaf:
    """The steps of a dotted path, with ``[]`` put in where it crosses lists; the type at its end, lists included."""
    if path in df.columns:
        return Leaf((path,), df.schema[path].dataType)
    dtype: T.DataType = df.schema
    steps: list[str] = []
    for name in path.split("."):
        while isinstance(dtype, T.ArrayType):
            steps.append("[]")
            dtype = dtype.elementType
        if isinstance(dtype, T.MapType):
            steps.append(f"@{name.lstrip('@')}")
            dtype = dtype.valueType
            continue
        if not isinstance(dtype, T.StructType) or name not in dtype.fieldNames():
            raise TableError(f"unknown column {path!r}")
        steps.append(name)
        dtype = dtype[name].dataType
    return Leaf(tuple(steps), dtype)


def _step(value: Column, name: str) -> Column:
    return value[name[1:]] if name.startswith("@") else value.getField(name)


def value_of(steps: tuple[str, ...]) -> Column:
    """The value at the steps; below lists, the list of the values, flat however deep the lists are."""

    def read(value: Column, rest: tuple[str, ...]) -> tuple[Column, bool]:
        for i, name in enumerate(rest):
            if name == "[]":
                below = rest[i + 1 :]
                if not below:
                    return value, True
                inner, is_list = read_item(below)
                out = F.transform(value, inner)
                return (F.flatten(out), True) if is_list else (out, True)
            value = _step(value, name)
        return value, False

    def read_item(rest: tuple[str, ...]) -> tuple[Callable[[Column], Column], bool]:
        is_list = "[]" in rest
        return (lambda x: read(x, rest)[0]), is_list

    return read(F.col(f"`{steps[0]}`"), steps[1:])[0]


def any_at(steps: tuple[str, ...], test: Callable[[Column], Column]) -> Column:
    """Whether the test holds of the value at the steps; below lists, of any element's. Null without lists if unknown."""

    def hold(value: Column, rest: tuple[str, ...]) -> Column:
        for i, name in enumerate(rest):
            if name == "[]":
                below = rest[i + 1 :]
                return F.coalesce(F.exists(value, lambda x: F.coalesce(hold(x, below), F.lit(False))), F.lit(False))  # noqa: B023
            value = _step(value, name)
        return test(value)

    return hold(F.col(f"`{steps[0]}`"), steps[1:])
