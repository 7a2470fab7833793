"""Ranges as structs of empty, lower, upper and bounds; null sides are unbounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import kinds as K
from ..kinds import Kind
from ..plans.expr import Expr, lowers


def _build(kind: Kind, empty: Column, lower: Column, upper: Column, bounds: Column) -> Column:
    point = kind.spark["lower"].dataType
    none = F.lit(None)
    return F.struct(
        empty.alias("empty"),
        F.when(~empty, lower).otherwise(none).cast(point).alias("lower"),
        F.when(~empty, upper).otherwise(none).cast(point).alias("upper"),
        F.when(~empty, bounds).otherwise(none).cast("string").alias("bounds"),
    )


def make_range(fields: dict, kind: Kind) -> Column:
    """A range from Python values; date ranges get the canonical bounds ``[)``."""
    from ..plans.literals import literal

    point = K.DATE if kind.name == "daterange" else K.TIMESTAMPTZ
    if fields["empty"]:
        return _build(kind, F.lit(True), *[F.lit(None)] * 3)
    return canonical(kind, literal(fields["lower"], point), literal(fields["upper"], point), F.lit(fields["bounds"]))


def canonical(kind: Kind, lower: Column, upper: Column, bounds: Column) -> Column:
    left = F.when(lower.isNull(), "(").otherwise(F.substring(bounds, 1, 1))
    right = F.when(upper.isNull(), ")").otherwise(F.substring(bounds, 2, 1))
    wrong = F.raise_error(F.lit("range lower bound must be less than or equal to range upper bound"))
    if kind.name == "daterange":
        lower, upper = F.when(left == "(", F.date_add(lower, 1)).otherwise(lower), F.when(right == "]", F.date_add(upper, 1)).otherwise(upper)
        bounds = F.when(lower.isNull(), "()").otherwise("[)")
    else:
        bounds = F.concat(left, right)
    inside = F.coalesce((lower < upper) | ((lower == upper) & (bounds == "[]")), F.lit(True))
    backwards = F.coalesce(lower > upper, F.lit(False))
    return F.when(backwards, wrong.cast(kind.spark)).otherwise(_build(kind, ~inside, lower, upper, bounds))


def _left_closed(r: Column) -> Column:
    return F.substring(r["bounds"], 1, 1) == "["


def _right_closed(r: Column) -> Column:
    return F.substring(r["bounds"], 2, 1) == "]"


def _starts_no_later(a: Column, b: Column) -> Column:
    """Whether a's lower bound lies at or below b's."""
    return a["lower"].isNull() | (b["lower"].isNotNull() & F.coalesce((a["lower"] < b["lower"]) | ((a["lower"] == b["lower"]) & (_left_closed(a) | ~_left_closed(b))), F.lit(False)))


def _ends_no_earlier(a: Column, b: Column) -> Column:
    return a["upper"].isNull() | (b["upper"].isNotNull() & F.coalesce((a["upper"] > b["upper"]) | ((a["upper"] == b["upper"]) & (_right_closed(a) | ~_right_closed(b))), F.lit(False)))


def _before(a: Column, b: Column) -> Column:
    """Whether all of a lies below all of b."""
    return F.coalesce((a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~(_right_closed(a) & _left_closed(b))), F.lit(False))


def _holds(a: Column, b: Column) -> Column:
    return b["empty"] | (~a["empty"] & _starts_no_later(a, b) & _ends_no_earlier(a, b))


def _lower_reaches(a: Column, b: Column) -> Column:
    """Whether a does not begin below b."""
    return b["lower"].isNull() | (a["lower"].isNotNull() & F.coalesce((a["lower"] > b["lower"]) | ((a["lower"] == b["lower"]) & (_left_closed(b) | ~_left_closed(a))), F.lit(False)))


def _upper_reaches(a: Column, b: Column) -> Column:
    """Whether a does not end above b."""
    return b["upper"].isNull() | (a["upper"].isNotNull() & F.coalesce((a["upper"] < b["upper"]) | ((a["upper"] == b["upper"]) & (_right_closed(b) | ~_right_closed(a))), F.lit(False)))


def _meets(a: Column, b: Column) -> Column:
    return F.coalesce((a["upper"] == b["lower"]) & (_right_closed(a) != _left_closed(b)), F.lit(False))


_TESTS = {
    "contains": lambda a, b: _holds(a, b),
    "contained_by": lambda a, b: _holds(b, a),
    "overlaps": lambda a, b: ~a["empty"] & ~b["empty"] & ~_before(a, b) & ~_before(b, a),
    "strictly_left_of": lambda a, b: ~a["empty"] & ~b["empty"] & _before(a, b),
    "strictly_right_of": lambda a, b: ~a["empty"] & ~b["empty"] & _before(b, a),
    "does_not_extend_right_of": lambda a, b: ~a["empty"] & ~b["empty"] & _upper_reaches(a, b),
    "does_not_extend_left_of": lambda a, b: ~a["empty"] & ~b["empty"] & _lower_reaches(a, b),
    "adjacent_to": lambda a, b: ~a["empty"] & ~b["empty"] & (_meets(a, b) | _meets(b, a)),
}


@lowers(*[f"range.{name}" for name in _TESTS])
def _test(expr: Expr, a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), _TESTS[expr.op.removeprefix("range.")](a, b))


@lowers("range.contains_point")
def _contains_point(expr: Expr, a: Column, p: Column) -> Column:
    above = a["lower"].isNull() | (a["lower"] < p) | ((a["lower"] == p) & _left_closed(a))
    below = a["upper"].isNull() | (a["upper"] > p) | ((a["upper"] == p) & _right_closed(a))
    return F.when(a.isNotNull() & p.isNotNull(), ~a["empty"] & above & below)
