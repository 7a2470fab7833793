"""Declared tables: column factories, modifiers, enums, custom types, row types."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from . import kinds as K
from .errors import KindError
from .kinds import Kind


@dataclass(frozen=True)
class Codec:
    """Functions applied where values of a column enter and leave."""

    encode: Callable[[Any], Any] = staticmethod(lambda v: v)
    decode: Callable[[Any], Any] = staticmethod(lambda v: v)


@dataclass(frozen=True)
class Column:
    """A column's kind and modifiers; each modifier returns a new column."""

    kind: Kind
    null: bool = False
    fill: str | None = None  # default, generated or identity
    value: Any = field(default=K.UNSET, compare=False)
    db_name: str | None = None
    codec: Codec | None = field(default=None, compare=False)
    is_unique: bool = False

    def _fill(self, fill: str, value: Any = K.UNSET) -> Column:
        if self.fill:
            raise KindError(f"a column that is {self.fill} cannot be {fill}")
        return replace(self, fill=fill, value=value)

    def nullable(self) -> Column:
        if self.fill == "identity":
            raise KindError("an identity column is never null")
        return replace(self, null=True)

    def default(self, value: Any = K.UNSET) -> Column:
        """``value`` (or what a function of no arguments returns) where a row names none."""
        return self._fill("default", value)

    def generated(self, build: Callable | None = None) -> Column:
        """Computed by ``build(eb)`` from the row's other columns; never written."""
        return self._fill("generated", build or K.UNSET)

    def identity(self) -> Column:
        if self.kind.name not in ("smallint", "integer", "bigint"):
            raise KindError("only whole number columns can be identity columns")
        if self.null:
            raise KindError("an identity column is never null")
        return replace(self._fill("identity"), is_unique=True)

    def unique(self) -> Column:
        return replace(self, is_unique=True)

    def name(self, db_name: str) -> Column:
        return replace(self, db_name=db_name)

    def use_codec(self, codec: Codec) -> Column:
        return replace(self, codec=codec)

    @property
    def writable(self) -> bool:
        return self.fill not in ("identity", "generated")


def _factory(kind: Kind):
    return lambda: Column(kind)


smallint, integer, bigint, real, double_precision, boolean, text, uuid, bytea = map(_factory, (K.SMALLINT, K.INTEGER, K.BIGINT, K.REAL, K.DOUBLE, K.BOOLEAN, K.TEXT, K.UUID, K.BYTEA))
date, time, timestamp, timestamptz, interval, jsonb, inet, tsvector, daterange, tstzrange, vector = map(_factory, (K.DATE, K.TIME, K.TIMESTAMP, K.TIMESTAMPTZ, K.INTERVAL, K.JSONB, K.INET, K.TSVECTOR, K.DATERANGE, K.TSTZRANGE, K.VECTOR))


def decimal(precision: int | None = None, scale: int | None = None) -> Column:
    return Column(Kind("decimal", precision=precision, scale=scale))


def varchar(length: int | None = None) -> Column:
    return Column(Kind("varchar", length=length))


def array(element: Column) -> Column:
    return Column(K.array_of(element.kind))


def define_enum(name: str, labels: list[str]) -> Callable[[], Column]:
    """An enum whose labels are ordered as given."""
    if len(set(labels)) != len(labels):
        raise KindError("an enum's labels differ from each other")
    kind = Kind("enum", type_name=name, labels=tuple(labels))
    return lambda: Column(kind)


def define_type(sql: str, base: Column | None = None, codec: Codec | None = None) -> Callable[[], Column]:
    """A type without a factory, stored as ``base`` (text unless given)."""
    kind = Kind("custom", type_name=sql, base=base.kind if base else K.TEXT)
    return lambda: Column(kind, codec=codec)


@dataclass(frozen=True)
class Table:
    """``source`` under the name ``alias``, with columns by key."""

    source: str
    columns: dict[str, Column] = field(hash=False)
    alias: str = ""

    def __post_init__(self):
        if not self.alias:
            object.__setattr__(self, "alias", self.source)

    def as_(self, alias: str) -> Table:
        return replace(self, alias=alias)

    def db_name(self, key: str) -> str:
        return self.columns[key].db_name or key

    @property
    def unique_keys(self) -> list[str]:
        return [k for k, c in self.columns.items() if c.is_unique and not c.null]

    def _struct(self, keys) -> T.StructType:
        return T.StructType([T.StructField(k, self.columns[k].kind.spark, self.columns[k].null) for k in keys])

    @property
    def stored(self) -> T.StructType:
        """The schema of the table as stored, by database names."""
        fields = []
        for key, c in self.columns.items():
            meta = {"key": key, "kind": str(c.kind), "fill": c.fill or ""}
            fields.append(T.StructField(self.db_name(key), c.kind.spark, True, meta | ({"labels": list(c.kind.labels)} if c.kind.labels else {})))
        return T.StructType(fields)

    @property
    def select_type(self) -> T.StructType:
        return self._struct(self.columns)

    @property
    def insert_type(self) -> T.StructType:
        """Writable columns; those with a default or null may be left out, which nullable says."""
        keys = [k for k, c in self.columns.items() if c.writable]
        return T.StructType([T.StructField(k, self.columns[k].kind.spark, self.columns[k].null or self.columns[k].fill == "default") for k in keys])

    @property
    def update_type(self) -> T.StructType:
        return T.StructType([T.StructField(k, c.kind.spark, True) for k, c in self.columns.items() if c.writable])


def define_table(source: str, columns: dict[str, Column] | None = None, /, **named: Column) -> Table:
    return Table(source, {**(columns or {}), **named})
