"""Distances between vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.expr import Expr, lowers


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def _zip(a: Column, b: Column, fn) -> Column:
    wrong = F.raise_error(F.lit("vectors of different lengths")).cast("array<double>")
    return F.when(F.size(a) != F.size(b), wrong).otherwise(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), fn))


def dot(a: Column, b: Column) -> Column:
    return _sum(_zip(a, b, lambda x, y: x * y))


@lowers("vector.l2")
def _l2(expr: Expr, a: Column, b: Column) -> Column:
    return F.sqrt(_sum(_zip(a, b, lambda x, y: (x - y) * (x - y))))


@lowers("vector.cosine")
def _cosine(expr: Expr, a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(float("nan"))).otherwise(1 - dot(a, b) / F.when(size != 0, size))


@lowers("vector.inner")
def _inner(expr: Expr, a: Column, b: Column) -> Column:
    return -dot(a, b)
