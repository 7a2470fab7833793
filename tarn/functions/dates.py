"""Truncating, taking apart and formatting dates and times."""

from __future__ import annotations

from contextvars import ContextVar
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import KindError, UnsupportedError
from ..plans.expr import Expr, lowers
from .arithmetic import interval_column

UNITS = ("microseconds", "milliseconds", "second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium")
FIELDS = (*UNITS, "dow", "doy", "epoch", "isodow", "isoyear", "julian", "timezone", "timezone_hour", "timezone_minute")

_MICROS = {"microseconds": 1, "milliseconds": 1000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000}
_MONTHS = {"month": 1, "quarter": 3, "year": 12, "decade": 120, "century": 1200, "millennium": 12000}
_DAY = 86_400_000_000


#: When the running transaction started; outside of one, ``now`` is when the query starts.
STARTED: ContextVar[datetime | None] = ContextVar("started", default=None)


@lowers("now")
def _now(expr: Expr) -> Column:
    started = STARTED.get()
    return F.current_timestamp() if started is None else F.lit(started)


@lowers("current_date")
def _current_date(expr: Expr) -> Column:
    return F.current_date()


def _cut(value: Column, step: int) -> Column:
    """Towards zero to a multiple of ``step``."""
    return value - value % step


@lowers("date_trunc")
def _date_trunc(expr: Expr, a: Column) -> Column:
    unit = expr.payload
    if unit not in UNITS:
        raise KindError(f"{unit!r} is no unit")
    if expr.kind.name == "interval":
        zero = F.lit(0)
        if unit in _MICROS:
            return interval_column(a["months"], a["days"], _cut(a["micros"], _MICROS[unit]))
        if unit == "day":
            return interval_column(a["months"], a["days"], zero)
        if unit == "week":
            raise UnsupportedError("intervals have no weeks")
        return interval_column(_cut(a["months"], _MONTHS[unit]), zero, zero)
    kind = expr.kind.spark
    if unit == "microseconds":
        return a.cast(kind)
    if unit in ("decade", "century", "millennium"):
        year = F.year(a)
        step = {"decade": 10, "century": 100, "millennium": 1000}[unit]
        shift = 0 if unit == "decade" else 1
        start = F.floor((year - shift) / F.lit(step)) * step + shift
        return F.make_date(start.cast("int"), F.lit(1), F.lit(1)).cast(kind)
    name = "millisecond" if unit == "milliseconds" else unit
    return F.date_trunc(name, a).cast(kind)


@lowers("extract")
def _extract(expr: Expr, a: Column) -> Column:
    field, kind = expr.payload, expr.args[0].kind.name
    if field not in FIELDS:
        raise KindError(f"{field!r} is no field")
    if kind == "interval":
        return _of_interval(field, a)
    if kind == "time":
        return _of_clock(field, a)
    number = "decimal(38,6)"
    if field == "century":
        return F.ceil(F.year(a) / 100).cast(number)
    if field == "millennium":
        return F.ceil(F.year(a) / 1000).cast(number)
    if field == "decade":
        return F.floor(F.year(a) / 10).cast(number)
    simple = {"year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "doy": F.dayofyear}
    if field in simple:
        return simple[field](a).cast(number)
    if field == "dow":
        return (F.dayofweek(a) - 1).cast(number)
    if field == "isodow":
        return (F.weekday(a) + 1).cast(number)
    if field == "isoyear":
        return F.year(F.date_add(F.date_trunc("week", a).cast("date"), 3)).cast(number)
    micros = F.unix_micros(a.cast("timestamp"))
    if field == "epoch":
        return (micros.cast("decimal(38,0)") / F.lit(1_000_000).cast("decimal(38,0)")).cast(number)
    if field == "julian":
        days = F.unix_date(a.cast("date")) + 2_440_588
        if kind == "date":
            return days.cast(number)
        part = F.pmod(micros, F.lit(_DAY)).cast("decimal(38,0)") / F.lit(_DAY).cast("decimal(38,0)")
        return (days.cast("decimal(38,0)") + part).cast("decimal(38,20)")
    if field.startswith("timezone"):
        if kind != "timestamptz":
            raise KindError(f"{field} is for timestamptz")
        return F.lit(0).cast(number)
    if kind == "date":
        raise KindError(f"a date has no {field}")
    return _of_clock(field, F.pmod(micros, F.lit(_DAY)))


def _of_clock(field: str, micros: Column) -> Column:
    number = "decimal(38,6)"
    second = F.pmod(micros, F.lit(60_000_000)).cast("decimal(38,0)")
    million = F.lit(1_000_000).cast("decimal(38,0)")
    if field == "hour":
        return F.floor(micros / 3_600_000_000).cast(number)
    if field == "minute":
        return F.floor(F.pmod(micros, F.lit(3_600_000_000)) / 60_000_000).cast(number)
    if field == "second":
        return (second / million).cast(number)
    if field == "milliseconds":
        return (second / F.lit(1000).cast("decimal(38,0)")).cast(number)
    if field == "microseconds":
        return second.cast(number)
    if field == "epoch":
        return (micros.cast("decimal(38,0)") / million).cast(number)
    raise KindError(f"a time has no {field}")


def _of_interval(field: str, a: Column) -> Column:
    number = "decimal(38,6)"
    months, days, micros = a["months"], a["days"], a["micros"]
    years = _cut(months, 12) / 12
    by_month = {"year": years, "month": months % 12, "quarter": F.floor(months % 12 / 3) + 1, "decade": _cut(years, 10) / 10, "century": _cut(years, 100) / 100, "millennium": _cut(years, 1000) / 1000, "day": days}
    if field in by_month:
        return by_month[field].cast(number)
    if field == "hour":
        return (_cut(micros, 3_600_000_000) / 3_600_000_000).cast(number)
    if field == "minute":
        return (_cut(micros % 3_600_000_000, 60_000_000) / 60_000_000).cast(number)
    if field == "epoch":
        seconds = years * 31_557_600 + (months % 12) * 2_592_000 + days * 86_400
        return (seconds.cast("decimal(38,6)") + (micros.cast("decimal(38,0)") / F.lit(1_000_000).cast("decimal(38,0)")).cast(number)).cast(number)
    rest = (micros % 60_000_000).cast("decimal(38,0)")
    divisor = {"second": 1_000_000, "milliseconds": 1000, "microseconds": 1}.get(field)
    if divisor is None:
        raise KindError(f"an interval has no {field}")
    return (rest / F.lit(divisor).cast("decimal(38,0)")).cast(number)


#: Template patterns of dates and what date_format calls them, longest first.
TEMPLATE = [
    ("YYYY", "yyyy"), ("HH24", "HH"), ("HH12", "hh"), ("Month", "MMMM"), ("FMMonth", "MMMM"), ("DDD", "DDD"), ("Mon", "MMM"), ("Day", "EEEE"),
    ("Dy", "EEE"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("AM", "a"), ("PM", "a"), ("Q", "Q"),
]


def template_parts(template: str) -> list[tuple[str, str]]:
    """``(pattern, text)`` pieces of a template: a date pattern, or literal text."""
    parts, i = [], 0
    tokens = sorted(TEMPLATE, key=lambda t: -len(t[0]))
    while i < len(template):
        if template[i] == '"':
            end = template.index('"', i + 1)
            parts.append(("", template[i + 1 : end]))
            i = end + 1
            continue
        hit = next((t for t in tokens if template.startswith(t[0], i)), None)
        if hit:
            parts.append((hit[1], hit[0]))
            i += len(hit[0])
        elif template[i].isalpha():
            raise UnsupportedError(f"template pattern at {template[i:]!r}")
        else:
            parts.append(("", template[i]))
            i += 1
    return parts


@lowers("to_char")
def _to_char(expr: Expr, a: Column) -> Column:
    kind, template = expr.args[0].kind.name, expr.payload
    if kind in ("smallint", "integer", "bigint", "decimal", "real", "double"):
        return _number_to_char(a, template)
    if kind == "interval":
        micros = a["micros"]
        clock = {"HH": micros / 3_600_000_000, "mm": micros % 3_600_000_000 / 60_000_000, "ss": micros % 60_000_000 / 1_000_000}
        out = []
        for pattern, text in template_parts(template):
            if not pattern:
                out.append(F.lit(text))
            elif pattern == "dd":
                out.append(F.lpad(a["days"].cast("string"), 2, "0"))
            elif pattern in clock:
                out.append(F.lpad(F.floor(clock[pattern]).cast("string"), 2, "0"))
            else:
                raise UnsupportedError(f"template pattern {text} of an interval")
        return F.concat(*out)
    stamp = F.timestamp_micros(a) if kind == "time" else a
    out = []
    for pattern, text in template_parts(template):
        if not pattern:
            out.append(F.lit(text))
        elif text in ("Month", "Day"):
            out.append(F.rpad(F.date_format(stamp, pattern), 9, " "))
        else:
            out.append(F.date_format(stamp, pattern))
    return F.concat(*out) if out else F.lit("")


def _number_to_char(a: Column, template: str) -> Column:
    fill = template.startswith("FM")
    body = template[2:] if fill else template
    if not body or set(body) - set("90.,"):
        raise UnsupportedError(f"number template {template!r}")
    whole, _, part = body.partition(".")
    number = F.round(a.cast("decimal(38,18)"), len(part))
    text = F.abs(number).cast(f"decimal(38,{len(part)})").cast("string")
    if "," in whole:
        text = F.concat(F.regexp_replace(F.split_part(text, F.lit("."), F.lit(1)), r"(?<=\d)(?=(?:\d{3})+$)", ","), F.regexp_extract(text, r"\.\d*$", 0))
    zeros = whole.replace(",", "").find("0")
    if zeros >= 0:
        if "," in whole:
            raise UnsupportedError(f"number template {template!r}")
        text = F.lpad(text, len(whole) - zeros + (len(part) + 1 if part else 0), "0")
    elif part:
        text = F.regexp_replace(text, r"^0\.", ".")
    signed = F.concat(F.when(number < 0, "-").otherwise(""), text)
    width = len(body) + 1
    over = F.length(F.regexp_replace(F.split_part(text, F.lit("."), F.lit(1)), ",", "")) > len(whole.replace(",", ""))
    if fill:
        signed = F.regexp_replace(signed, r"(\.\d*?)0+$", "$1") if "9" in part else signed
        return F.when(over, F.raise_error(F.lit("number does not fit its template"))).otherwise(signed)
    return F.when(over, F.raise_error(F.lit("number does not fit its template"))).otherwise(F.lpad(signed, width, " "))
