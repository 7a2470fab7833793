"""Aggregates with their result kinds; nulls are kept or skipped as each one says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import kinds as K
from ..errors import KindError
from ..kinds import Kind
from ..plans.expr import Expr, lowers
from .arithmetic import whole_division
from .predicates import equality_key


def sum_kind(kind: Kind) -> Kind:
    if kind.name in ("smallint", "integer"):
        return K.BIGINT
    if kind.name == "bigint":
        return Kind("decimal", precision=38, scale=0)
    if kind.name in ("decimal", "real", "double", "interval"):
        return kind
    raise KindError(f"no sum of {kind}")


def avg_kind(kind: Kind) -> Kind:
    if kind.name in K.EXACT:
        return Kind("decimal", precision=38, scale=16)
    if kind.name in ("real", "double"):
        return K.DOUBLE
    if kind.name == "interval":
        return K.INTERVAL
    raise KindError(f"no average of {kind}")


@lowers("agg.count")
def _count(expr: Expr, a: Column | None = None) -> Column:
    return F.count(F.lit(1) if a is None else a)


@lowers("agg.count_distinct")
def _count_distinct(expr: Expr, a: Column) -> Column:
    return F.count_distinct(equality_key(a, expr.args[0].kind))


@lowers("agg.sum")
def _sum(expr: Expr, a: Column) -> Column:
    kind = expr.args[0].kind
    if kind.name == "bigint":
        return F.sum(a.cast("decimal(20,0)")).cast("decimal(38,0)")
    if kind.name == "interval":
        return F.when(F.count(a) > 0, F.struct(F.sum(a["months"]).cast("int").alias("months"), F.sum(a["days"]).cast("int").alias("days"), F.sum(a["micros"]).alias("micros")))
    if kind.name == "decimal":
        return F.sum(a)
    return F.sum(a).cast(expr.kind.spark)


@lowers("agg.avg")
def _avg(expr: Expr, a: Column) -> Column:
    kind = expr.args[0].kind
    if kind.name in K.EXACT:
        total = F.sum(a if kind.name == "decimal" else a.cast("decimal(20,0)")).cast("decimal(38,16)")
        return (total / F.nullif(F.count(a), F.lit(0)).cast("decimal(20,0)")).cast("decimal(38,16)")
    if kind.name == "interval":
        n = F.count(a).cast("decimal(20,0)")
        months, days, micros = F.sum(a["months"]), F.sum(a["days"]), F.sum(a["micros"])
        day = 86_400_000_000
        # what does not divide goes on to the smaller field, as months of 30 days
        m = whole_division(months, F.count(a))
        rest_days = (months % F.count(a)) * 30 + days
        d = whole_division(rest_days, F.count(a))
        rest = ((rest_days % F.count(a)).cast("decimal(20,0)") * F.lit(day).cast("decimal(11,0)") + micros).cast("decimal(38,0)")
        return F.when(n > 0, F.struct(m.cast("int").alias("months"), d.cast("int").alias("days"), F.round(rest / n, 0).cast("long").alias("micros")))
    return F.avg(a.cast("double"))


@lowers("agg.min", "agg.max")
def _extreme(expr: Expr, a: Column) -> Column:
    fold = F.min if expr.op == "agg.min" else F.max
    if expr.kind.name in ("enum", "interval", "inet"):
        from .predicates import sort_key

        return fold(F.when(a.isNotNull(), F.struct(sort_key(a, expr.kind).alias("k"), a.alias("v"))))["v"]
    return fold(a)


@lowers("agg.array")
def _array(expr: Expr, a: Column) -> Column:
    rows = F.transform(F.collect_list(F.struct(a.alias("x"))), lambda e: e["x"])
    return F.when(F.count(F.lit(1)) > 0, rows)


@lowers("agg.string")
def _string(expr: Expr, a: Column) -> Column:
    # collect_list skips nulls; no text at all gives null
    return F.when(F.count(a) > 0, F.array_join(F.collect_list(a), expr.payload))


@lowers("agg.bool_and")
def _bool_and(expr: Expr, a: Column) -> Column:
    return F.bool_and(a)


@lowers("agg.bool_or")
def _bool_or(expr: Expr, a: Column) -> Column:
    return F.bool_or(a)


@lowers("agg.jsonb")
def _jsonb(expr: Expr, a: Column) -> Column:
    from .jsonb import json_value

    items = F.collect_list(json_value(a, expr.args[0].kind))
    return F.when(F.count(F.lit(1)) > 0, F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
