"""SQL kinds: how values of each are stored, compared and widened."""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import KindError, UndefinedParameterError


class _Unset:
    def __repr__(self):
        return "UNSET"


#: A value that was never given; refused everywhere, unlike a null.
UNSET = _Unset()


@dataclass(frozen=True)
class Kind:
    name: str
    elem: Kind | None = None
    labels: tuple[str, ...] = ()
    precision: int | None = None
    scale: int | None = None
    length: int | None = None
    type_name: str | None = None
    base: Kind | None = None

    def __str__(self) -> str:
        if self.name == "array":
            return f"{self.elem}[]"
        if self.name == "decimal" and self.precision is not None:
            return f"decimal({self.precision},{self.scale or 0})"
        if self.name == "varchar" and self.length is not None:
            return f"varchar({self.length})"
        return self.type_name or self.name

    @property
    def spark(self) -> T.DataType:
        if self.name == "array":
            return T.ArrayType(self.elem.spark)
        if self.name == "decimal":
            if self.precision is None:
                return T.DecimalType(38, 10 if self.scale is None else self.scale)
            return T.DecimalType(self.precision, self.scale or 0)
        if self.name == "custom":
            return (self.base or TEXT).spark
        return _SPARK[self.name]


_INTERVAL = T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())])


def _range_of(point: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("empty", T.BooleanType()), T.StructField("lower", point), T.StructField("upper", point), T.StructField("bounds", T.StringType())])


_SPARK: dict[str, T.DataType] = {
    "smallint": T.ShortType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "real": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "text": T.StringType(),
    "varchar": T.StringType(),
    "uuid": T.StringType(),
    "bytea": T.BinaryType(),
    "date": T.DateType(),
    "time": T.LongType(),  # microseconds of the day
    "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
    "interval": _INTERVAL,
    "jsonb": T.StringType(),  # JSON text
    "inet": T.StringType(),
    "tsvector": T.StringType(),
    "daterange": _range_of(T.DateType()),
    "tstzrange": _range_of(T.TimestampType()),
    "vector": T.ArrayType(T.FloatType()),
    "enum": T.StringType(),
    "void": T.StringType(),
}

SMALLINT, INTEGER, BIGINT, REAL, DOUBLE, DECIMAL, BOOLEAN, TEXT, VARCHAR, UUID, BYTEA = map(Kind, ("smallint", "integer", "bigint", "real", "double", "decimal", "boolean", "text", "varchar", "uuid", "bytea"))
DATE, TIME, TIMESTAMP, TIMESTAMPTZ, INTERVAL, JSONB, INET, TSVECTOR, DATERANGE, TSTZRANGE, VECTOR, VOID = map(Kind, ("date", "time", "timestamp", "timestamptz", "interval", "jsonb", "inet", "tsvector", "daterange", "tstzrange", "vector", "void"))

EXACT = ("smallint", "integer", "bigint", "decimal")
NUMERIC = (*EXACT, "real", "double")
TEXTUAL = ("text", "varchar")
MOMENTS = ("date", "timestamp", "timestamptz")
RANGES = ("daterange", "tstzrange")
ORDERED = (*NUMERIC, *TEXTUAL, *MOMENTS, "time", "interval", "inet", "enum", "custom")


def array_of(kind: Kind) -> Kind:
    if kind.name == "array":
        raise KindError("arrays hold no arrays")
    return Kind("array", elem=kind)


def comparable(a: Kind, b: Kind) -> bool:
    """Whether values of the two kinds may stand on both sides of a comparison."""
    if "void" in (a.name, b.name):
        return True
    for group in (NUMERIC, TEXTUAL, MOMENTS):
        if a.name in group:
            return b.name in group
    if a.name == "array":
        return b.name == "array" and comparable(a.elem, b.elem)
    if a.name in ("enum", "custom"):
        return a.name == b.name and a.type_name == b.type_name
    return a.name == b.name


def wider(a: Kind, b: Kind) -> Kind:
    """The kind of arithmetic between two numeric kinds."""
    if a.name == b.name:
        return Kind(a.name) if a.name == "decimal" else a
    if a.name in EXACT and b.name in EXACT:
        return Kind(EXACT[max(EXACT.index(a.name), EXACT.index(b.name))])
    return DOUBLE


def kind_of(value) -> Kind:
    """The kind that a Python value is sent as when nothing else decides."""
    if value is UNSET or value is None:
        raise UndefinedParameterError("a parameter needs a value")
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, int):
        return INTEGER if -(2**31) <= value < 2**31 else BIGINT
    if isinstance(value, float):
        return DOUBLE
    if isinstance(value, decimal.Decimal):
        return DECIMAL
    if isinstance(value, str):
        return TEXT
    if isinstance(value, (bytes, bytearray)):
        return BYTEA
    if isinstance(value, dt.datetime):
        return TIMESTAMPTZ if value.tzinfo else TIMESTAMP
    if isinstance(value, dt.date):
        return DATE
    if isinstance(value, dt.time):
        return TIME
    if isinstance(value, dt.timedelta):
        return INTERVAL
    if isinstance(value, dict):
        return JSONB
    if isinstance(value, (list, tuple)):
        kinds = {kind_of(v) for v in value if v is not None}
        if not kinds:
            return array_of(TEXT)
        if len(kinds) > 1:
            if not all(k.name in NUMERIC for k in kinds):
                raise KindError(f"an array of {', '.join(map(str, kinds))}")
            ordered = sorted(kinds, key=lambda k: NUMERIC.index(k.name))
            while len(ordered) > 1:
                ordered = [wider(ordered[0], ordered[1]), *ordered[2:]]
            return array_of(ordered[0])
        return array_of(kinds.pop())
    raise KindError(f"no kind for {type(value).__name__}")
