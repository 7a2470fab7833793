"""Python values as Spark literals of a given kind."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import KindError, UnsupportedError
from ..kinds import Kind

_UNITS = {"year": (12, 0, 0), "month": (1, 0, 0), "mon": (1, 0, 0), "week": (0, 7, 0), "day": (0, 1, 0), "hour": (0, 0, 3_600_000_000), "minute": (0, 0, 60_000_000), "min": (0, 0, 60_000_000), "second": (0, 0, 1_000_000), "sec": (0, 0, 1_000_000), "millisecond": (0, 0, 1000), "microsecond": (0, 0, 1)}
_PART = re.compile(r"([+-]?\d+(?:\.\d+)?)\s*([a-z]+)")
_CLOCK = re.compile(r"([+-]?)(\d+):(\d\d)(?::(\d\d(?:\.\d+)?))?")


def interval_parts(value) -> tuple[int, int, int]:
    """Months, days and microseconds of an interval given as a timedelta, triple or text."""
    if isinstance(value, dt.timedelta):
        return 0, value.days, value.seconds * 1_000_000 + value.microseconds
    if isinstance(value, (tuple, list)):
        return tuple(value)
    text = value.strip().lower()
    months, days, micros = decimal.Decimal(0), decimal.Decimal(0), decimal.Decimal(0)
    if m := _CLOCK.search(text):
        clock = int(m[2]) * 3_600_000_000 + int(m[3]) * 60_000_000 + decimal.Decimal(m[4] or 0) * 1_000_000
        micros += -clock if m[1] == "-" else clock
        text = text[: m.start()] + text[m.end() :]
    rest = _PART.sub("", text).replace("ago", "").strip()
    if rest:
        raise KindError(f"{value!r} is no interval")
    for number, unit in _PART.findall(text):
        unit = unit[:-1] if unit.endswith("s") and unit[:-1] in _UNITS else unit
        if unit not in _UNITS:
            raise KindError(f"{value!r} is no interval")
        a, b, c = (decimal.Decimal(number) * x for x in _UNITS[unit])
        months, days, micros = months + a, days + b, micros + c
    if months % 1:
        days += months % 1 * 30
        months -= months % 1
    if days % 1:
        micros += days % 1 * 86_400_000_000
        days -= days % 1
    sign = -1 if text.endswith("ago") else 1
    return sign * int(months), sign * int(days), sign * int(micros)


def time_micros(value) -> int:
    if isinstance(value, str):
        value = dt.time.fromisoformat(value)
    return ((value.hour * 60 + value.minute) * 60 + value.second) * 1_000_000 + value.microsecond


def range_fields(value, kind: Kind) -> dict:
    """A range given as a dict or as text such as ``[2024-01-01,2024-02-01)``."""
    if isinstance(value, str):
        if value == "empty":
            return {"empty": True}
        m = re.fullmatch(r'([\[(])"?([^",]*)"?,"?([^",]*)"?([\])])', value)
        if not m:
            raise KindError(f"{value!r} is no range")
        value = {"lower": m[2] or None, "upper": m[3] or None, "bounds": m[1] + m[4]}
    return {"empty": False, "lower": None, "upper": None, "bounds": "[)"} | value


def literal(value, kind: Kind) -> Column:
    """``value`` as a column of ``kind``; None is a null of it."""
    if value is None:
        return F.lit(None).cast(kind.spark)
    name = kind.name
    if name == "decimal":
        number = value if isinstance(value, decimal.Decimal) else decimal.Decimal(str(value))
        return F.lit(number) if kind.precision is None else F.lit(number).cast(kind.spark)
    if name in ("text", "varchar", "uuid", "inet", "tsvector"):
        if not isinstance(value, str):
            raise KindError(f"{value!r} is no {kind}")
        return F.lit(value)
    if name == "enum":
        if value not in kind.labels:
            raise KindError(f"{value!r} is no label of {kind}")
        return F.lit(value)
    if name == "boolean":
        if not isinstance(value, bool):
            raise KindError(f"{value!r} is no boolean")
        return F.lit(value)
    if name in ("smallint", "integer", "bigint"):
        if isinstance(value, bool) or int(value) != value if not isinstance(value, str) else False:
            raise KindError(f"{value!r} is no {kind}")
        return F.lit(int(value)).cast(kind.spark)
    if name in ("real", "double"):
        return F.lit(float(value)).cast(kind.spark)
    if name == "bytea":
        return F.lit(bytes(value))
    if name == "jsonb":
        return F.lit(json.dumps(value, separators=(",", ":"), ensure_ascii=False))
    if name == "array":
        return F.array(*[literal(v, kind.elem) for v in value]).cast(kind.spark)
    if name == "vector":
        return F.array(*[F.lit(float(v)) for v in value]).cast(kind.spark)
    if name == "interval":
        months, days, micros = interval_parts(value)
        return F.struct(F.lit(months).cast("int").alias("months"), F.lit(days).cast("int").alias("days"), F.lit(micros).cast("long").alias("micros"))
    if name == "time":
        return F.lit(time_micros(value)).cast("long")
    if name in ("date", "timestamp", "timestamptz"):
        text = value if isinstance(value, str) else value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()
        return F.lit(text).cast(kind.spark)
    if name in ("daterange", "tstzrange"):
        from ..functions.ranges import make_range

        return make_range(range_fields(value, kind), kind)
    if name == "custom":
        return literal(value, kind.base)
    raise UnsupportedError(f"no literal of {kind}")
