"""Comparisons, junctions, tests, text patterns and quantifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsupportedError
from ..kinds import Kind
from ..plans.expr import Expr, lowers

#: Bracket classes of POSIX patterns and what Java calls them.
POSIX_CLASSES = {
    "alpha": r"\p{IsAlphabetic}", "digit": r"\p{Nd}", "alnum": r"\p{IsAlphabetic}\p{Nd}", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "space": r"\s", "blank": r"\p{Blank}",
    "punct": r"\p{Punct}", "cntrl": r"\p{Cntrl}", "xdigit": r"\p{XDigit}", "print": r"\p{Print}", "graph": r"\p{Graph}", "word": r"\w",
}


def java_pattern(posix: str) -> str:
    """A POSIX pattern in Java's syntax; what cannot be said there is refused."""
    if posix.startswith("***") or "[[=" in posix or "[[." in posix or "[=" in posix or "[." in posix:
        raise UnsupportedError(f"pattern {posix!r}")
    if "[[:<:]]" in posix or "[[:>:]]" in posix:
        posix = posix.replace("[[:<:]]", r"\b(?=\w)").replace("[[:>:]]", r"\b(?<=\w)")

    def known(m):
        if m[1] not in POSIX_CLASSES:
            raise UnsupportedError(f"character class {m[0]}")
        return POSIX_CLASSES[m[1]]

    out = re.sub(r"\[:(\w+):\]", known, posix)
    for escape, java in ((r"\m", r"\b(?=\w)"), (r"\M", r"\b(?<=\w)"), (r"\y", r"\b"), (r"\Y", r"\B"), (r"\Z", r"\z")):
        out = re.sub(r"(?<!\\)((?:\\\\)*)" + re.escape(escape), lambda m, j=java: m[1] + j, out)
    return out


def sort_key(col: Column, kind: Kind) -> Column:
    """A column that orders and compares as the kind does."""
    if kind.name == "enum":
        return F.array_position(F.array(*[F.lit(x) for x in kind.labels]), col)
    if kind.name == "interval":
        return (col["months"].cast("decimal(38,0)") * 30 + col["days"]) * 86_400_000_000 + col["micros"]
    if kind.name == "inet":
        from .inet import inet_key

        return inet_key(col)
    if kind.name == "jsonb":
        from .jsonb import canonical

        return canonical(col)
    return col


#: Kinds of which different values can be equal: 1 day and 24 hours, 1 and 1.0 in documents, spellings of an address.
EQUAL_BY_KEY = ("interval", "jsonb", "inet")


def equality_key(col: Column, kind: Kind) -> Column:
    """A column that is the same for values the kind holds equal."""
    return sort_key(col, kind) if kind.name in EQUAL_BY_KEY else col


def _sides(expr: Expr, a: Column, b: Column):
    left, right = expr.args[0].kind, expr.args[1].kind
    right = right.elem if expr.args[1].op in ("any", "all") else right
    return sort_key(a, left), sort_key(b, right)


COMPARE = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "is_distinct_from": lambda a, b: ~a.eqNullSafe(b),
    "is_not_distinct_from": lambda a, b: a.eqNullSafe(b),
    "like": lambda a, b: F.like(a, b),
    "ilike": lambda a, b: F.ilike(a, b),
    "regex": lambda a, b: F.rlike(a, b),
    "iregex": lambda a, b: F.rlike(a, F.concat(F.lit("(?iu)"), b)),
    "starts_with": lambda a, b: F.startswith(a, b),
}


@lowers(*COMPARE)
def _compare(expr: Expr, a: Column, b: Column) -> Column:
    right, compare = expr.args[1], COMPARE[expr.op]
    if expr.op in ("regex", "iregex"):
        if right.op != "value":
            raise UnsupportedError("patterns are given as values, since they are translated")
        b = F.lit(java_pattern(right.payload))
    if right.op in ("any", "all"):
        test = lambda x: compare(*_sides(expr, a, x))
        return F.exists(b, test) if right.op == "any" else F.forall(b, test)
    return compare(*_sides(expr, a, b))


@lowers("any", "all")
def _quantified(expr: Expr, array: Column) -> Column:
    return array


@lowers("in")
def _in(expr: Expr, a: Column, *values: Column) -> Column:
    a = sort_key(a, expr.args[0].kind)
    return a.isin(*[sort_key(v, e.kind) for v, e in zip(values, expr.args[1:], strict=True)])


@lowers("and")
def _and(expr: Expr, *parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


@lowers("or")
def _or(expr: Expr, *parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


@lowers("not")
def _not(expr: Expr, a: Column) -> Column:
    return ~a


@lowers("is_null")
def _is_null(expr: Expr, a: Column) -> Column:
    return a.isNull()


@lowers("is_not_null")
def _is_not_null(expr: Expr, a: Column) -> Column:
    return a.isNotNull()


@lowers("is_true", "is_not_true", "is_false", "is_not_false")
def _truth(expr: Expr, a: Column) -> Column:
    same = a.eqNullSafe(F.lit(expr.op in ("is_true", "is_not_true")))
    return ~same if "not" in expr.op else same
