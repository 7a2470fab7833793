"""``eb.fn`` and ``eb.json``: the functions by name, with their result kinds."""

from __future__ import annotations

from .. import kinds as K
from ..errors import KindError, UnsupportedError
from ..kinds import Kind, comparable
from ..plans.expr import Expr, _arg
from .aggregates import avg_kind, sum_kind
from .dates import FIELDS, UNITS

#: Kinds that values are cast to.
CAST_TARGETS = ("smallint", "integer", "bigint", "real", "double", "decimal", "boolean", "text", "varchar", "uuid", "date", "time", "timestamp", "timestamptz", "interval", "jsonb")


def _need(expr: Expr, kinds, what: str) -> Expr:
    if expr.kind.name not in (*kinds, "void"):
        raise KindError(f"{what} is not for {expr.kind}")
    return expr


class Functions:
    def __init__(self, builder):
        self._b = builder

    def _e(self, arg) -> Expr:
        return self._b.operand(arg)

    def _text(self, arg, what: str) -> Expr:
        return _need(self._e(arg), (*K.TEXTUAL, "custom"), what)

    @staticmethod
    def _value(arg) -> Expr:
        return _arg(arg)

    def _same(self, first: Expr, rest) -> list[Expr]:
        out = []
        for r in rest:
            e = r if isinstance(r, Expr) else Expr("value", (), first.kind, r)
            if not comparable(first.kind, e.kind):
                raise KindError(f"{first.kind} and {e.kind} do not mix")
            out.append(e)
        return out

    # strings

    def lower(self, t):
        return Expr("lower", (self._text(t, "lower"),), K.TEXT)

    def upper(self, t):
        return Expr("upper", (self._text(t, "upper"),), K.TEXT)

    def length(self, t):
        return Expr("length", (self._text(t, "length"),), K.INTEGER)

    def concat(self, *parts):
        return Expr("concat", tuple(self._value(p) if not isinstance(p, str) else self._named_or_text(p) for p in parts), K.TEXT)

    def _named_or_text(self, p: str) -> Expr:
        alias, _, key = p.partition(".")
        table = self._b.scope.tables.get(alias)
        return self._b.ref(p) if table and key in table.columns else _arg(p)

    def trim(self, t):
        return Expr("trim", (self._text(t, "trim"),), K.TEXT)

    def ltrim(self, t):
        return Expr("ltrim", (self._text(t, "ltrim"),), K.TEXT)

    def rtrim(self, t):
        return Expr("rtrim", (self._text(t, "rtrim"),), K.TEXT)

    def substring(self, t, start, count=None):
        args = [self._text(t, "substring"), self._value(start)] + ([] if count is None else [self._value(count)])
        return Expr("substring", tuple(args), K.TEXT)

    def replace(self, t, old, new):
        return Expr("replace", (self._text(t, "replace"), self._value(old), self._value(new)), K.TEXT)

    def strpos(self, t, part):
        return Expr("strpos", (self._text(t, "strpos"), self._value(part)), K.INTEGER)

    def left(self, t, n):
        return Expr("left", (self._text(t, "left"), self._value(n)), K.TEXT)

    def right(self, t, n):
        return Expr("right", (self._text(t, "right"), self._value(n)), K.TEXT)

    def split_part(self, t, mark, n):
        return Expr("split_part", (self._text(t, "split_part"), self._value(mark), self._value(n)), K.TEXT)

    # conditional

    def coalesce(self, first, *rest):
        first = self._e(first)
        return Expr("coalesce", (first, *self._same(first, [self._e(r) if isinstance(r, str) and "." in r and r.partition(".")[0] in self._b.scope.tables else r for r in rest])), first.kind)

    def nullif(self, value, other):
        value = self._e(value)
        return Expr("nullif", (value, *self._same(value, [other])), value.kind)

    def greatest(self, *parts):
        return self._extreme("greatest", parts)

    def least(self, *parts):
        return self._extreme("least", parts)

    def _extreme(self, op, parts):
        first = _need(self._e(parts[0]), K.ORDERED, op)
        return Expr(op, (first, *self._same(first, [self._e(p) if isinstance(p, str) and first.kind.name not in K.TEXTUAL else p for p in parts[1:]])), first.kind)

    def cast(self, value, to: Kind | str):
        kind = Kind(to) if isinstance(to, str) else to
        if kind.name not in CAST_TARGETS:
            raise UnsupportedError(f"no cast to {kind}")
        return Expr("cast", (self._e(value),), kind)

    # math

    def abs(self, n):
        e = _need(self._e(n), K.NUMERIC, "abs")
        return Expr("abs", (e,), e.kind)

    def round(self, n, places: int | None = None):
        e = _need(self._e(n), K.NUMERIC, "round")
        if places is not None and e.kind.name != "decimal":
            raise KindError("rounding to places is for decimals")
        return Expr("round", (e,), e.kind if e.kind.name == "decimal" else K.DOUBLE, places)

    def ceil(self, n):
        return self._whole("ceil", n)

    def floor(self, n):
        return self._whole("floor", n)

    def _whole(self, op, n):
        e = _need(self._e(n), K.NUMERIC, op)
        return Expr(op, (e,), Kind("decimal", precision=38, scale=0) if e.kind.name == "decimal" else K.DOUBLE)

    # dates

    def now(self):
        return Expr("now", (), K.TIMESTAMPTZ)

    def current_date(self):
        return Expr("current_date", (), K.DATE)

    def date_trunc(self, unit: str, value):
        if unit not in UNITS:
            raise KindError(f"{unit!r} is no unit")
        e = _need(self._e(value), (*K.MOMENTS, "interval"), "date_trunc")
        return Expr("date_trunc", (e,), K.TIMESTAMPTZ if e.kind.name == "date" else e.kind, unit)

    def extract(self, field: str, value):
        if field not in FIELDS:
            raise KindError(f"{field!r} is no field")
        e = _need(self._e(value), (*K.MOMENTS, "interval", "time"), "extract")
        return Expr("extract", (e,), Kind("decimal", precision=38, scale=6), field)

    def to_char(self, value, template: str):
        return Expr("to_char", (self._e(value),), K.TEXT, template)

    # arrays and quantifiers

    def cardinality(self, a):
        return Expr("cardinality", (_need(self._e(a), ("array",), "cardinality"),), K.INTEGER)

    def any(self, array):
        e = array if isinstance(array, Expr) else self._b.ref(array) if isinstance(array, str) else _arg(array)
        return Expr("any", (_need(e, ("array",), "any"),), e.kind)

    def all(self, array):
        return Expr("all", self.any(array).args, self.any(array).kind)

    # JSON

    def jsonb_build_object(self, fields: dict):
        args = tuple(self._e(v) if isinstance(v, Expr) or isinstance(v, str) and v.partition(".")[0] in self._b.scope.tables else _arg(v) for v in fields.values())
        return Expr("jsonb_build_object", args, K.JSONB, tuple(fields))

    # aggregates

    def count(self, x=None):
        return Expr("agg.count", () if x is None else (self._e(x),), K.BIGINT)

    def count_distinct(self, x):
        return Expr("agg.count_distinct", (self._e(x),), K.BIGINT)

    def sum(self, x):
        e = self._e(x)
        return Expr("agg.sum", (e,), sum_kind(e.kind))

    def avg(self, x):
        e = self._e(x)
        return Expr("agg.avg", (e,), avg_kind(e.kind))

    def min(self, x):
        e = _need(self._e(x), K.ORDERED, "min")
        return Expr("agg.min", (e,), e.kind)

    def max(self, x):
        e = _need(self._e(x), K.ORDERED, "max")
        return Expr("agg.max", (e,), e.kind)

    def array_agg(self, x):
        e = self._e(x)
        return Expr("agg.array", (e,), K.array_of(e.kind))

    def string_agg(self, x, delimiter: str):
        return Expr("agg.string", (self._text(x, "string_agg"),), K.TEXT, delimiter)

    def bool_and(self, x):
        return Expr("agg.bool_and", (_need(self._e(x), ("boolean",), "bool_and"),), K.BOOLEAN)

    def bool_or(self, x):
        return Expr("agg.bool_or", (_need(self._e(x), ("boolean",), "bool_or"),), K.BOOLEAN)

    def jsonb_agg(self, x):
        return Expr("agg.jsonb", (self._e(x),), K.JSONB)


class Json:
    def __init__(self, builder):
        self._b = builder

    def _doc(self, arg) -> Expr:
        return _need(self._b.operand(arg), ("jsonb",), "a JSON accessor")

    def get(self, doc, *path):
        return Expr("json.get", (self._doc(doc),), K.JSONB, path)

    def text(self, doc, *path):
        return Expr("json.text", (self._doc(doc),), K.TEXT, path)

    def has_key(self, doc, key: str):
        return Expr("json.has_key", (self._doc(doc),), K.BOOLEAN, (key,))

    def has_any_key(self, doc, keys):
        return Expr("json.has_any_key", (self._doc(doc),), K.BOOLEAN, tuple(keys))

    def has_all_keys(self, doc, keys):
        return Expr("json.has_all_keys", (self._doc(doc),), K.BOOLEAN, tuple(keys))

    def path_exists(self, doc, path: str):
        return Expr("json.path_exists", (self._doc(doc),), K.BOOLEAN, path)

    def path_matches(self, doc, path: str):
        return Expr("json.path_matches", (self._doc(doc),), K.BOOLEAN, path)

    def type_of(self, doc):
        return Expr("json.type_of", (self._doc(doc),), K.TEXT)

    def length(self, doc):
        return Expr("json.length", (self._doc(doc),), K.INTEGER)
