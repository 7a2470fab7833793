"""Expression trees and the builder that makes them.

An ``Expr`` is an operation over other expressions with a kind.  ``lower`` turns
a tree into a Spark column; how each operation is lowered is registered by the
modules in ``tarn.functions``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import kinds as K
from ..errors import KindError, ScopeError, UndefinedParameterError
from ..kinds import UNSET, Kind, comparable, kind_of
from .literals import literal

LOWER: dict[str, Callable[..., Column]] = {}


def lowers(*ops: str):
    """Registers ``fn(expr, *columns)`` as the lowering of operations."""

    def register(fn):
        LOWER.update(dict.fromkeys(ops, fn))
        return fn

    return register


def _arg(value) -> Expr:
    return value if isinstance(value, Expr) else Expr("value", (), kind_of(value), value)


@dataclass(frozen=True)
class Expr:
    op: str
    args: tuple[Expr, ...] = ()
    kind: Kind = K.BOOLEAN
    payload: Any = None
    alias: str | None = field(default=None, compare=False)

    __hash__ = None

    def __bool__(self):
        raise KindError("an expression has no truth value; use and_, or_ and not_")

    def __iter__(self):
        raise KindError("an expression has no items")

    def as_(self, key: str) -> Expr:
        return replace(self, alias=key)

    @property
    def aggregates(self) -> bool:
        return self.op.startswith("agg.") or any(a.aggregates for a in self.args)

    def walk(self):
        yield self
        for a in self.args:
            yield from a.walk()

    # operands

    def _operand(self, value, what: str) -> Expr:
        if value is UNSET or value is None:
            raise UndefinedParameterError(f"{what} takes no null; is_null tests for it")
        if isinstance(value, Expr):
            other = value.kind.elem if value.op in ("any", "all") else value.kind
            if not comparable(self.kind, other):
                raise KindError(f"{self.kind} does not compare with {other}")
            if value.op == "value" and value.kind.name != self.kind.name:
                return replace(value, kind=self.kind) if self.kind.name not in K.NUMERIC else value
            return value
        if self.kind.name in K.NUMERIC and kind_of(value).name in K.NUMERIC:
            return _arg(value)
        return Expr("value", (), self.kind, value)

    def _compare(self, op: str, value, kinds=None) -> Expr:
        if kinds and self.kind.name not in (*kinds, "void"):
            raise KindError(f"{op} is not for {self.kind}")
        if self.op == "value" and isinstance(value, Expr) and value.op in ("any", "all"):
            return Expr(op, (replace(self, kind=value.kind.elem), value))
        return Expr(op, (self, self._operand(value, op)))

    def _text(self, op: str, value) -> Expr:
        return self._compare(op, value, (*K.TEXTUAL, "custom"))

    # every kind

    def eq(self, v):
        return self._compare("eq", v)

    def ne(self, v):
        return self._compare("ne", v)

    def is_distinct_from(self, v):
        return self._compare("is_distinct_from", v)

    def is_not_distinct_from(self, v):
        return self._compare("is_not_distinct_from", v)

    def is_null(self):
        return Expr("is_null", (self,))

    def is_not_null(self):
        return Expr("is_not_null", (self,))

    def in_(self, values):
        if isinstance(values, Expr):
            return self._compare("eq", Expr("any", (values,), values.kind))
        values = list(values)
        if not values:
            return Expr("value", (), K.BOOLEAN, False)
        return Expr("in", (self, *[self._operand(v, "in") for v in values]))

    def not_in(self, values):
        if isinstance(values, Expr):
            return self._compare("ne", Expr("all", (values,), values.kind))
        values = list(values)
        if not values:
            return Expr("value", (), K.BOOLEAN, True)
        return Expr("not", (self.in_(values),))

    # ordered kinds

    def gt(self, v):
        return self._compare("gt", v, K.ORDERED)

    def gte(self, v):
        return self._compare("gte", v, K.ORDERED)

    def lt(self, v):
        return self._compare("lt", v, K.ORDERED)

    def lte(self, v):
        return self._compare("lte", v, K.ORDERED)

    def between(self, bounds):
        low, high = bounds
        return Expr("and", (self.gte(low), self.lte(high)))

    def not_between(self, bounds):
        return Expr("not", (self.between(bounds),))

    # booleans

    def _truth(self, op: str) -> Expr:
        if self.kind.name != "boolean":
            raise KindError(f"{op} is not for {self.kind}")
        return Expr(op, (self,))

    def is_true(self):
        return self._truth("is_true")

    def is_not_true(self):
        return self._truth("is_not_true")

    def is_false(self):
        return self._truth("is_false")

    def is_not_false(self):
        return self._truth("is_not_false")

    # texts

    def like(self, v):
        return self._text("like", v)

    def not_like(self, v):
        return Expr("not", (self.like(v),))

    def ilike(self, v):
        return self._text("ilike", v)

    def not_ilike(self, v):
        return Expr("not", (self.ilike(v),))

    def regex(self, v):
        return self._text("regex", v)

    def not_regex(self, v):
        return Expr("not", (self.regex(v),))

    def iregex(self, v):
        return self._text("iregex", v)

    def not_iregex(self, v):
        return Expr("not", (self.iregex(v),))

    def starts_with(self, v):
        return self._text("starts_with", v)

    # arrays, jsonb, ranges, inet

    def _family(self) -> str:
        name = self.kind.base.name if self.kind.name == "custom" else self.kind.name
        return "range" if name in K.RANGES else name

    def _within(self, op: str, value, families: tuple[str, ...]) -> Expr:
        family = self._family()
        if family not in families:
            raise KindError(f"{op} is not for {self.kind}")
        if family == "range" and op in ("contains",) and not isinstance(value, (dict, Expr)) and not (isinstance(value, str) and value[:1] in "[(e"):
            point = K.DATE if self.kind.name == "daterange" else K.TIMESTAMPTZ
            return Expr("range.contains_point", (self, Expr("value", (), point, value)))
        if family == "range" and op == "contains" and isinstance(value, Expr) and value.kind.name in K.MOMENTS:
            return Expr("range.contains_point", (self, value))
        return Expr(f"{family}.{op}", (self, self._operand(value, op)))

    def contains(self, v):
        return self._within("contains", v, ("array", "jsonb", "range"))

    def contained_by(self, v):
        return self._within("contained_by", v, ("array", "jsonb", "range"))

    def overlaps(self, v):
        return self._within("overlaps", v, ("array", "range", "inet"))

    def strictly_left_of(self, v):
        return self._within("strictly_left_of", v, ("range",))

    def strictly_right_of(self, v):
        return self._within("strictly_right_of", v, ("range",))

    def does_not_extend_right_of(self, v):
        return self._within("does_not_extend_right_of", v, ("range",))

    def does_not_extend_left_of(self, v):
        return self._within("does_not_extend_left_of", v, ("range",))

    def adjacent_to(self, v):
        return self._within("adjacent_to", v, ("range",))

    def is_subnet_of(self, v):
        return self._within("is_subnet_of", v, ("inet",))

    def is_subnet_or_equal(self, v):
        return self._within("is_subnet_or_equal", v, ("inet",))

    def is_supernet_of(self, v):
        return self._within("is_supernet_of", v, ("inet",))

    def is_supernet_or_equal(self, v):
        return self._within("is_supernet_or_equal", v, ("inet",))

    def matches(self, query: str):
        if self._family() != "tsvector":
            raise KindError(f"matches is not for {self.kind}")
        return Expr("tsvector.matches", (self,), K.BOOLEAN, query)

    # vectors

    def _distance(self, op: str, v) -> Expr:
        if self.kind.name != "vector":
            raise KindError(f"{op} is not for {self.kind}")
        return Expr(op, (self, self._operand(v, op)), K.DOUBLE)

    def l2_distance(self, v):
        return self._distance("vector.l2", v)

    def cosine_distance(self, v):
        return self._distance("vector.cosine", v)

    def inner_product(self, v):
        """The negative inner product, so that smaller is nearer."""
        return self._distance("vector.inner", v)

    # arithmetic

    def _math(self, op: str, value) -> Expr:
        from ..functions.arithmetic import result_kind

        other = value if isinstance(value, Expr) else self._math_value(op, value)
        return Expr(op, (self, other), result_kind(op, self.kind, other.kind))

    def _math_value(self, op: str, value) -> Expr:
        if self.kind.name in ("timestamp", "timestamptz", "interval") and isinstance(value, str):
            return Expr("value", (), K.INTERVAL, value)
        return _arg(value)

    def plus(self, v):
        return self._math("plus", v)

    def minus(self, v):
        return self._math("minus", v)

    def times(self, v):
        return self._math("times", v)

    def divided_by(self, v):
        return self._math("divided_by", v)

    def mod(self, v):
        return self._math("mod", v)


class Scope:
    """The tables an expression may refer to."""

    def __init__(self, tables):
        self.tables = {}
        for t in tables:
            if t.alias in self.tables:
                raise ScopeError(f"table {t.alias} is in scope already")
            self.tables[t.alias] = t

    def ref(self, name: str) -> Expr:
        alias, _, key = name.partition(".")
        if alias not in self.tables or key not in self.tables[alias].columns:
            raise ScopeError(f"{name} is not in scope")
        return Expr("ref", (), self.tables[alias].columns[key].kind, (alias, key))


class Builder:
    """What callbacks get as ``eb``: references, parameters, junctions, functions."""

    def __init__(self, scope: Scope):
        from ..functions.catalog import Functions, Json

        self.scope = scope
        self.fn = Functions(self)
        self.json = Json(self)

    def ref(self, name: str) -> Expr:
        return self.scope.ref(name)

    def val(self, value, kind: Kind | None = None) -> Expr:
        return Expr("value", (), kind or kind_of(value), value)

    def operand(self, arg) -> Expr:
        """A function's argument: an expression, or the name of a column in scope."""
        return arg if isinstance(arg, Expr) else self.ref(arg)

    def and_(self, parts) -> Expr:
        return _junction("and", parts)

    def or_(self, parts) -> Expr:
        return _junction("or", parts)

    def not_(self, part: Expr) -> Expr:
        return Expr("not", (part,))

    def case(self):
        from ..functions.case import Case

        return Case(self)

    def nest(self, alias: str, keys: list[str] | None = None) -> Expr:
        if alias not in self.scope.tables:
            raise ScopeError(f"{alias} is not in scope")
        table = self.scope.tables[alias]
        chosen = list(table.columns) if keys is None else list(keys)
        for key in chosen:
            self.ref(f"{alias}.{key}")
        return Expr("nest", (), Kind("custom", type_name="object"), (alias, tuple(chosen)), alias)


def _junction(op: str, parts) -> Expr:
    flat = []
    for p in parts:
        if p.kind.name != "boolean":
            raise KindError(f"{op} joins conditions, not {p.kind}")
        flat += p.args if p.op == op else [p]
    if not flat:
        return Expr("value", (), K.BOOLEAN, op == "and")
    return flat[0] if len(flat) == 1 else Expr(op, tuple(flat))


def expression_builder(*tables) -> Builder:
    """A builder outside a query."""
    return Builder(Scope(tables))


def condition(builder: Builder, *args) -> Expr:
    """The three forms of a condition: ``(column, value)``, a callback, or an expression."""
    if len(args) == 2:
        return builder.operand(args[0]).eq(args[1])
    (given,) = args
    found = given if isinstance(given, Expr) else given(builder)
    if found.kind.name != "boolean":
        raise KindError(f"a condition is boolean, not {found.kind}")
    return found


class Env:
    """Where references are looked up while a tree is lowered."""

    def __init__(self, override: Callable[[Expr], Column | None] = lambda e: None):
        self.override = override
        #: Columns that raw SQL refers to by name; the frame gets them before it is used.
        self.hoisted: dict[str, Column] = {}

    def hoist(self, expr: Expr) -> str:
        name = f"#sql{len(self.hoisted)}"
        self.hoisted[name] = self.lower(expr)
        return name

    def lower(self, expr: Expr) -> Column:
        from .. import functions  # noqa: F401  registers the lowerings

        done = self.override(expr)
        if done is not None:
            return done
        if expr.op == "ref":
            return F.col(f"`{expr.payload[0]}.{expr.payload[1]}`")
        if expr.op == "value":
            return literal(expr.payload, expr.kind)
        if expr.op == "column":
            return expr.payload
        if expr.op == "nest":
            alias, keys = expr.payload
            fields = [self.lower(Expr("ref", (), K.TEXT, (alias, k))).alias(k) for k in keys]
            there = self.lower(Expr("ref", (), K.BOOLEAN, (alias, "#row")))
            return F.when(there, F.struct(*fields) if fields else F.struct(F.lit(True).alias("#row")))
        if expr.op.startswith("sql."):
            return LOWER[expr.op](expr, self)
        return LOWER[expr.op](expr, *[self.lower(a) for a in expr.args])
