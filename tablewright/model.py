"""Descriptions of tables: properties with types and access, references between models, own row filters."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

#: Access levels from closed to open.
ACCESS = ("private", "protected", "public", "open")
RESERVED = ("_id", "_revision", "_txn", "_created", "_updated", "_type", "_base", "_page")
#: References of this maturity level or above are stored as the id of the target, others as its natural keys.
IDENTIFIABLE = 4


class TableError(ValueError):
    """A table, column, value or parameter that an operator can't work with."""


@dataclass(frozen=True)
class Property:
    """A column: its type name, and what is declared of it."""

    name: str
    dtype: str = "string"
    required: bool = False
    unique: bool = False
    access: str = "protected"
    enum: dict | None = None
    ref: str | None = None
    refprops: tuple[str, ...] = ()
    level: int = IDENTIFIABLE
    unit: str | None = None
    uri: str | None = None
    langs: tuple[str, ...] = ()

    @property
    def identifiable(self) -> bool:
        return self.level >= IDENTIFIABLE


@dataclass(frozen=True)
class Model:
    """A table: its properties, primary key, unique keys, base model and own row filter."""

    name: str
    properties: tuple[Property, ...] = ()
    pk: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    base: str | None = None
    row_filter: Callable[[DataFrame], Column] | None = None
    uri: str | None = None

    def prop(self, name: str) -> Property:
        for p in self.properties:
            if p.name == name:
                return p
        raise TableError(f"{self.name} has no property {name!r}")


@dataclass(frozen=True)
class Table:
    """A model's rows, the column that others refer to, and which columns refer to which model."""

    df: DataFrame
    key: str
    refs: dict[str, str] = field(default_factory=dict)
    row_filter: Callable[[DataFrame], Column] | None = None


Catalog = dict[str, Table]


def load_order(refs: dict[str, Iterable[str]]) -> list[str]:
    """Models so that what a model refers to, or is based on, comes before it; reverse it for deletes.

    ``refs`` has a handful of names per model, so this is driver work. Models of a cycle keep their given order.
    """
    done: list[str] = []
    state: dict[str, int] = {}

    def visit(name: str) -> None:
        if state.get(name):
            return
        state[name] = 1
        for target in refs.get(name, ()):
            if target in refs:
                visit(target)
        done.append(name)

    for name in refs:
        visit(name)
    return done
