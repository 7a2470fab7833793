"""Array tests; nulls inside arrays equal nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.expr import Expr, lowers


def _holds(a: Column, b: Column) -> Column:
    return F.forall(b, lambda y: y.isNotNull() & F.coalesce(F.array_contains(a, y), F.lit(False)))


@lowers("array.contains")
def _contains(expr: Expr, a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), _holds(a, b))


@lowers("array.contained_by")
def _contained_by(expr: Expr, a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), _holds(b, a))


@lowers("array.overlaps")
def _overlaps(expr: Expr, a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.arrays_overlap(a, b), F.lit(False)))


@lowers("cardinality")
def _cardinality(expr: Expr, a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))
