"""Arithmetic between numbers, moments and intervals, and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import kinds as K
from ..errors import KindError
from ..kinds import Kind, wider
from ..plans.expr import Expr, lowers


def result_kind(op: str, a: Kind, b: Kind) -> Kind:
    if a.name in K.NUMERIC and b.name in K.NUMERIC:
        kind = wider(a, b)
        if op == "mod" and kind.name not in K.EXACT:
            raise KindError("mod is for exact numbers")
        return kind
    if op in ("plus", "minus"):
        if a.name == "date" and b.name in ("smallint", "integer"):
            return K.DATE
        if a.name == b.name == "date" and op == "minus":
            return K.INTEGER
        if b.name == "interval" and a.name in ("timestamp", "timestamptz", "interval"):
            return a
        if b.name == "interval" and a.name == "date":
            return K.TIMESTAMP
        if op == "minus" and a.name in ("timestamp", "timestamptz") and b.name == a.name:
            return K.INTERVAL
    raise KindError(f"{op} is not for {a} and {b}")


def interval_column(months: Column, days: Column, micros: Column) -> Column:
    return F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), micros.cast("long").alias("micros"))


def _shift(moment: Column, interval: Column, sign: int) -> Column:
    months, days, micros = (interval[f] * sign for f in ("months", "days", "micros"))
    zero = F.lit(0)
    return moment + F.make_interval(zero, months, zero, days, zero, zero, (micros / F.lit(1_000_000).cast("decimal(18,0)")).cast("decimal(18,6)"))


@lowers("plus", "minus")
def _plus_minus(expr: Expr, a: Column, b: Column) -> Column:
    left, right = expr.args[0].kind.name, expr.args[1].kind.name
    sign = 1 if expr.op == "plus" else -1
    if left == "date" and right == "date":
        return F.datediff(a, b)
    if left == "date" and right != "interval":
        return F.date_add(a, b * sign)
    if left == "interval":
        return interval_column(*[a[f] + b[f] * sign for f in ("months", "days", "micros")])
    if right == "interval":
        return _shift(a.cast("timestamp_ntz") if left == "date" else a, b, sign).cast(expr.kind.spark)
    if left in ("timestamp", "timestamptz"):
        micros = F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))
        day = 86_400_000_000
        rest = F.expr("1L") * micros % day
        return interval_column(F.lit(0), whole_division(micros, F.lit(day)), rest)
    return _number(a + b if sign > 0 else a - b, expr)


def _number(col: Column, expr: Expr) -> Column:
    return col if expr.kind.name == "decimal" else col.cast(expr.kind.spark)


def _wide(expr: Expr, *cols: Column) -> list[Column]:
    """Operands of exact whole kinds in the result's kind, so that it overflows as that kind does."""
    return [c if expr.kind.name in ("decimal", "double") else c.cast(expr.kind.spark) for c in cols]


@lowers("times")
def _times(expr: Expr, a: Column, b: Column) -> Column:
    a, b = _wide(expr, a, b)
    return _number(a * b, expr)


@lowers("divided_by")
def _divided_by(expr: Expr, a: Column, b: Column) -> Column:
    if expr.kind.name in ("smallint", "integer", "bigint"):
        a, b = _wide(expr, a, b)
        return whole_division(a, b).cast(expr.kind.spark)
    if expr.kind.name == "decimal":
        exact = lambda c, e: c if e.kind.name == "decimal" else c.cast("decimal(20,0)")
        return (exact(a, expr.args[0]).cast("decimal(38,10)") / exact(b, expr.args[1]).cast("decimal(38,10)")).cast("decimal(38,16)")
    return _number(a.cast("double") / b.cast("double"), expr)


def whole_division(a: Column, b: Column) -> Column:
    """Division of whole numbers that cuts towards zero and fails on zero."""
    return F.call_function("div", a, b)


@lowers("mod")
def _mod(expr: Expr, a: Column, b: Column) -> Column:
    a, b = _wide(expr, a, b)
    return _number(a % b, expr)


@lowers("abs")
def _abs(expr: Expr, a: Column) -> Column:
    return F.abs(a)


@lowers("round")
def _round(expr: Expr, a: Column) -> Column:
    if expr.payload is not None:
        return F.round(a, expr.payload)
    if expr.args[0].kind.name == "decimal":
        return F.round(a, 0)
    return F.rint(a.cast("double"))


@lowers("ceil", "floor")
def _ceil_floor(expr: Expr, a: Column) -> Column:
    return getattr(F, expr.op)(a).cast(expr.kind.spark if expr.kind.name == "double" else "decimal(38,0)")


def interval_of_text(text: Column) -> Column:
    """Intervals written as numbers with units and a clock, such as ``1 year -2 days 03:04:05.5``; others fail."""
    from ..plans.literals import _UNITS

    low = F.lower(F.trim(text))
    clock = r"([+-]?)([0-9]+):([0-9]{2})(?::([0-9]{2}(?:[.][0-9]+)?))?"
    part = r"([+-]?[0-9]+(?:[.][0-9]+)?) *([a-z]+)"
    rest = F.regexp_replace(low, clock, "")
    group = lambda i: F.regexp_extract(low, clock, i)
    number = lambda col: F.when(col == "", F.lit("0")).otherwise(col).cast("decimal(30,6)")
    clock_micros = F.when(group(1) == "-", -1).otherwise(1) * (number(group(2)) * 3_600_000_000 + number(group(3)) * 60_000_000 + number(group(4)) * 1_000_000)
    units = F.transform(F.regexp_extract_all(rest, F.lit(part), F.lit(2)), lambda u: F.when(u.isin(*_UNITS), u).otherwise(F.regexp_replace(u, "s$", "")))
    parts = F.arrays_zip(F.regexp_extract_all(rest, F.lit(part), F.lit(1)).alias("n"), units.alias("u"))
    known = (F.trim(F.regexp_replace(F.regexp_replace(rest, part, ""), "ago", "")) == "") & F.forall(units, lambda u: u.isin(*_UNITS))
    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  computes the value once

    def total(found: Column, place: int) -> Column:
        """Of months, days or microseconds, all parts together."""
        size = lambda u: F.coalesce(*[F.when(u == name, F.lit(of[place])) for name, of in _UNITS.items() if of[place]], F.lit(0))
        return F.aggregate(found, F.lit(0).cast("decimal(38,6)"), lambda s, p: (s + p["n"].cast("decimal(20,6)") * size(p["u"]).cast("decimal(11,0)")).cast("decimal(38,6)"))

    cut = lambda col: F.when(col < 0, F.ceil(col)).otherwise(F.floor(col))
    sign = F.when(F.endswith(rest, F.lit("ago")), -1).otherwise(1)
    sums = let(parts, lambda found: F.struct(total(found, 0).alias("m"), total(found, 1).alias("d"), total(found, 2).alias("u")))
    # what is no whole month or day goes on to the smaller field
    whole = let(sums, lambda t: F.struct(cut(t["m"]).alias("m"), (t["d"] + (t["m"] - cut(t["m"])) * 30).alias("d"), t["u"].alias("u")))
    made = let(whole, lambda t: interval_column(t["m"] * sign, cut(t["d"]) * sign, cut(t["u"] + clock_micros + (t["d"] - cut(t["d"])) * 86_400_000_000) * sign))
    wrong = F.raise_error(F.concat(F.lit("invalid input syntax for type interval: "), text))
    return F.when(text.isNotNull(), F.when(known, made).otherwise(wrong.cast("struct<months:int,days:int,micros:bigint>")))


@lowers("cast")
def _cast(expr: Expr, a: Column) -> Column:
    source, target = expr.args[0].kind.name, expr.kind.name
    if target in ("smallint", "integer", "bigint"):
        if source == "decimal":
            return F.round(a, 0).cast(expr.kind.spark)
        if source in ("real", "double"):
            return F.rint(a.cast("double")).cast(expr.kind.spark)
    if target == "decimal" and source in ("real", "double"):
        return a.cast("string").cast("double").cast(expr.kind.spark)
    if target in K.TEXTUAL:
        from .strings import as_text

        text = as_text(a, expr.args[0].kind, boolean=("true", "false"))
        return F.substring(text, 1, expr.kind.length) if expr.kind.length else text
    if target == "interval" and source in K.TEXTUAL:
        from ..plans.literals import literal

        return literal(expr.args[0].payload, K.INTERVAL) if expr.args[0].op == "value" else interval_of_text(a)
    if target == "time" and source in K.TEXTUAL:
        stamp = F.concat(F.lit("1970-01-01 "), a).cast("timestamp_ntz").cast("timestamp")
        return F.unix_micros(stamp)
    if target == "time" and source in ("timestamp", "timestamptz"):
        return F.pmod(F.unix_micros(a.cast("timestamp")), F.lit(86_400_000_000))
    if target == "jsonb":
        from .jsonb import canonical

        return canonical(a) if source in K.TEXTUAL else F.to_json(F.to_variant_object(a))
    return a.cast(expr.kind.spark)
