"""JSON documents, kept as text and read through variants."""

from __future__ import annotations

import decimal
import json
import re
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsupportedError
from ..plans.expr import Expr, lowers


def canonical(col: Column) -> Column:
    """Equal documents as equal text: keys ordered, numbers in one form."""
    text = F.to_json(F.parse_json(col))
    return F.regexp_replace(text, r"(?<=[\[,:\d])(\d+)\.0(?=[,\]}]|$)", "$1")


def _quoted(key: str) -> str:
    return "['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _step(doc: Column, step) -> Column:
    """One step of a path on JSON text, as JSON text; null if there is nothing."""
    if isinstance(step, int) and step >= 0:
        path = f"$[{step}]"
    elif isinstance(step, int):
        size = F.json_array_length(doc)
        arrays = F.from_json(doc, "array<variant>")
        found = F.when(size >= -step, F.element_at(arrays, F.lit(step)))
        return F.when(size.isNotNull(), F.to_json(found))
    else:
        path = "$" + _quoted(step)
    return F.to_json(F.try_variant_get(F.parse_json(doc), path, "variant"))


def get(doc: Column, path) -> Column:
    for step in path:
        doc = _step(doc, step)
    return doc


def as_text(doc: Column) -> Column:
    """A string's characters, other documents as they are; JSON null is null."""
    text = F.try_variant_get(F.parse_json(doc), "$", "string")
    is_string = F.startswith(F.ltrim(doc), F.lit('"'))
    return F.when(F.trim(doc) == "null", F.lit(None)).when(is_string, text).otherwise(doc)


@lowers("json.get")
def _get(expr: Expr, a: Column) -> Column:
    return get(a, expr.payload)


@lowers("json.text")
def _text(expr: Expr, a: Column) -> Column:
    return as_text(get(a, expr.payload))


def _keys(a: Column) -> Column:
    """Keys of an object, or the strings among an array's elements, or a string itself."""
    strings = F.transform(F.filter(F.from_json(a, "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))
    start = F.substring(F.ltrim(a), 1, 1)
    scalar = F.when(start == '"', F.array(as_text(a)))
    return F.when(start == "{", F.json_object_keys(a)).when(start == "[", strings).otherwise(F.coalesce(scalar, F.array().cast("array<string>")))


@lowers("json.has_key", "json.has_any_key", "json.has_all_keys")
def _has(expr: Expr, a: Column) -> Column:
    tests = [F.array_contains(_keys(a), k) for k in expr.payload]
    if not tests:
        return F.when(a.isNotNull(), F.lit(expr.op == "json.has_all_keys"))
    out = tests[0]
    for t in tests[1:]:
        out = out | t if expr.op == "json.has_any_key" else out & t
    return F.when(a.isNotNull(), out)


@lowers("json.type_of")
def _type_of(expr: Expr, a: Column) -> Column:
    start = F.substring(F.ltrim(a), 1, 1)
    names = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}
    out = F.when(a.isNull(), F.lit(None).cast("string"))
    for mark, name in names.items():
        out = out.when(start == mark, name)
    return out.otherwise("number")


@lowers("json.length")
def _length(expr: Expr, a: Column) -> Column:
    size = F.json_array_length(a)
    wrong = F.raise_error(F.lit("cannot get array length of a non-array")).cast("int")
    return F.when(a.isNotNull(), F.when(size.isNull(), wrong).otherwise(size))


def contains_document(a, b) -> bool:
    """Whether document ``a`` contains ``b``."""
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and contains_document(a[k], v) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(contains_document(x, y) if isinstance(y, (dict, list)) else _equal(x, y) for x in a) for y in b)
    return _equal(a, b)


def _equal(a, b) -> bool:
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def _is(v: Column, *types: str) -> Column:
    """Whether a variant is of a type, by the first letters of its name."""
    name = F.schema_of_variant(v)
    return reduce(lambda a, b: a | b, [F.startswith(name, F.lit(t)) for t in types])


def _elements(v: Column) -> Column:
    """A variant array's elements, null of others."""
    return F.try_variant_get(v, "$", "array<variant>")


_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def _exact(value) -> decimal.Decimal | None:
    """A number with at most 20 digits before the point and 18 behind it, else None."""
    d = decimal.Decimal(str(value))
    return d if d == d.quantize(decimal.Decimal(1).scaleb(-18)) and abs(d) < 10**19 else None


def _expressible(b) -> bool:
    """Whether all numbers of a constant document can be compared as decimals."""
    if isinstance(b, dict):
        return all(map(_expressible, b.values()))
    if isinstance(b, list):
        return all(map(_expressible, b))
    try:
        return isinstance(b, (bool, str)) or b is None or _exact(b) is not None
    except decimal.InvalidOperation:
        return False


def _same_scalar(v: Column, b) -> Column:
    """Whether a variant equals a constant scalar."""
    if b is None:
        return _is(v, "VOID")
    if isinstance(b, bool):
        return _is(v, "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == b)
    if isinstance(b, str):
        return _is(v, "STRING") & (F.try_variant_get(v, "$", "string") == b)
    return _is(v, *_NUMBERS) & (F.try_variant_get(v, "$", "decimal(38,18)") == F.lit(_exact(b)).cast("decimal(38,18)"))


def _some(v: Column, test) -> Column:
    """Whether an element of a variant array meets a test."""
    return F.coalesce(F.exists(_elements(v), lambda e: F.coalesce(test(e), F.lit(False))), F.lit(False))


def _holds(v: Column, b) -> Column:
    """Whether a variant contains a constant document."""
    if isinstance(b, dict):
        out = _is(v, "OBJECT")
        for key, value in b.items():
            out = out & F.coalesce(_holds(F.try_variant_get(v, "$" + _quoted(key), "variant"), value), F.lit(False))
        return out
    if isinstance(b, list):
        out = _is(v, "ARRAY")
        for y in b:
            out = out & _some(v, partial(_holds, b=y))
        return out
    return _same_scalar(v, b)


@lowers("jsonb.contains", "jsonb.contained_by")
def _contains(expr: Expr, a: Column, b: Column) -> Column:
    a, b = (a, b) if expr.op == "jsonb.contains" else (b, a)
    inner = expr.args[1 if expr.op == "jsonb.contains" else 0]
    if inner.op == "value" and inner.payload is not None and _expressible(inner.payload):
        document, v = inner.payload, F.parse_json(a)
        out = _holds(v, document)
        if not isinstance(document, (dict, list)):
            out = out | _some(v, partial(_same_scalar, b=document))
        return F.when(a.isNotNull(), F.coalesce(out, F.lit(False)))

    # two columns: containment is recursive to any depth, which no expression can say
    @F.pandas_udf("boolean")
    def holds(x, y):
        import json

        import pandas as pd

        scalar = lambda p, q: isinstance(p, list) and not isinstance(q, (dict, list)) and any(_equal(e, q) for e in p)
        out = []
        for p, q in zip(x, y, strict=True):
            if p is None or q is None:
                out.append(None)
                continue
            p, q = json.loads(p), json.loads(q)
            out.append(contains_document(p, q) or scalar(p, q))
        return pd.Series(out, dtype="object")

    return holds(a, b)


_PATH = re.compile(r"\s*(?:(strict|lax)\s+)?(\$(?:\.(?:\"[^\"]+\"|\w+)|\[(?:\d+|\*)\])*)\s*(?:\?\s*\(\s*@((?:\.\w+)*)\s*(==|!=|<>|<=|>=|<|>)\s*(.+?)\s*\)|(==|!=|<>|<=|>=|<|>)\s*(.+?))?\s*$")


def parse_path(path: str):
    """``(steps, member, operator, value, is_filter)`` of the supported jsonpath forms."""
    m = _PATH.match(path)
    if not m or m[1] == "strict":
        raise UnsupportedError(f"jsonpath {path!r}")
    steps = []
    for part in re.findall(r"\.\"([^\"]+)\"|\.(\w+)|\[(\d+|\*)\]", m[2]):
        steps.append(part[0] or part[1] or ("*" if part[2] == "*" else int(part[2])))
    member = re.findall(r"\w+", m[3] or "")
    operator, text = (m[4], m[5]) if m[4] else (m[6], m[7])
    try:
        value = json.loads(text) if text else None
    except ValueError:
        raise UnsupportedError(f"jsonpath {path!r}") from None
    return steps, member, operator, value, bool(m[4])


def _walk(docs: list, steps) -> list:
    for step in steps:
        out = []
        for d in docs:
            if step == "*":
                out += d if isinstance(d, list) else [d]
            elif isinstance(step, int):
                items = d if isinstance(d, list) else [d]
                out += items[step : step + 1]
            else:
                for e in d if isinstance(d, list) else [d]:
                    if isinstance(e, dict) and step in e:
                        out.append(e[step])
        docs = out
    return docs


def _meets(x, operator: str, y) -> bool:
    if operator in ("==", "!=", "<>"):
        return _equal(x, y) == (operator == "==")
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if not (number(x) and number(y) or isinstance(x, str) and isinstance(y, str)):
        return False
    return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[operator]


def _reaches(v: Column, steps, leaf) -> Column:
    """Whether some value at the end of the steps meets ``leaf``; arrays are unwrapped as the lax mode does."""
    if not steps:
        return leaf(v)
    step, rest = steps[0], steps[1:]
    sure = lambda c: F.coalesce(c, F.lit(False))
    is_array = _is(v, "ARRAY")
    if step == "*":
        return F.when(is_array, sure(F.exists(_elements(v), lambda e: sure(_reaches(e, rest, leaf))))).otherwise(sure(_reaches(v, rest, leaf)))
    if isinstance(step, int):
        item = F.get(_elements(v), F.lit(step))
        return F.when(is_array, item.isNotNull() & sure(_reaches(item, rest, leaf))).otherwise(F.lit(step == 0) & sure(_reaches(v, rest, leaf)))

    def member(e):
        found = F.try_variant_get(e, "$" + _quoted(step), "variant")
        return found.isNotNull() & sure(_reaches(found, rest, leaf))

    return F.when(is_array, sure(F.exists(_elements(v), lambda e: _is(e, "OBJECT") & member(e)))).otherwise(_is(v, "OBJECT") & member(v))


def _leaf(member, operator, value, is_filter):
    """What the value at a path's end has to be."""

    def meets(v: Column) -> Column:
        if operator in ("==", "!=", "<>"):
            same = F.coalesce(_same_scalar(v, value), F.lit(False))
            return same if operator == "==" else ~same
        if isinstance(value, bool) or value is None:
            return F.lit(False)
        compare = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[operator]
        if isinstance(value, str):
            return _is(v, "STRING") & compare(F.try_variant_get(v, "$", "string"), F.lit(value))
        return _is(v, *_NUMBERS) & compare(F.try_variant_get(v, "$", "decimal(38,18)"), F.lit(_exact(value)).cast("decimal(38,18)"))

    if operator is None:
        return lambda v: F.lit(True)
    if not is_filter:
        return meets
    inner = lambda v: F.coalesce(_reaches(v, member, meets), F.lit(False))
    return lambda v: F.when(_is(v, "ARRAY"), F.coalesce(F.exists(_elements(v), inner), F.lit(False))).otherwise(inner(v))


@lowers("json.path_exists", "json.path_matches")
def _path(expr: Expr, a: Column) -> Column:
    steps, member, operator, value, is_filter = parse_path(expr.payload)
    exists = expr.op == "json.path_exists"
    if exists and operator and not is_filter or not exists and (is_filter or not operator):
        raise UnsupportedError(f"jsonpath {expr.payload!r}")

    if value is None and operator is None or not isinstance(value, (dict, list)) and _expressible(value):
        return F.when(a.isNotNull(), F.coalesce(_reaches(F.parse_json(a), steps, _leaf(member, operator, value, is_filter)), F.lit(False)))

    @F.pandas_udf("boolean")
    def found(x):
        import json

        import pandas as pd

        out = []
        for text in x:
            if text is None:
                out.append(None)
                continue
            docs = _walk([json.loads(text)], steps)
            if is_filter:
                docs = [d for d in (docs if not any(isinstance(d, list) for d in docs) else [e for d in docs for e in (d if isinstance(d, list) else [d])]) if any(_meets(v, operator, value) for v in _walk([d], member))]
            out.append(bool(docs) if exists else any(_meets(d, operator, value) for d in docs))
        return pd.Series(out, dtype="object")

    return found(a)


@lowers("jsonb_build_object")
def _build(expr: Expr, *values: Column) -> Column:
    return json_object(list(zip(expr.payload, values, [e.kind for e in expr.args], strict=True)))


def json_object(fields) -> Column:
    """An object's text from ``(key, column, kind)``; nulls stay as JSON null."""
    parts = []
    for i, (key, value, kind) in enumerate(fields):
        parts.append(F.lit(("," if i else "") + json.dumps(key, ensure_ascii=False) + ":"))
        parts.append(json_value(value, kind))
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def json_value(col: Column, kind) -> Column:
    """A value's JSON text."""
    from .strings import as_text as shown

    if kind.name == "jsonb":
        return F.coalesce(col, F.lit("null"))
    if kind.name in ("smallint", "integer", "bigint", "decimal", "real", "double"):
        return F.coalesce(shown(col, kind), F.lit("null"))
    if kind.name == "boolean":
        return F.coalesce(col.cast("string"), F.lit("null"))
    if kind.name in ("array", "vector"):
        from .. import kinds as K

        elem = kind.elem if kind.name == "array" else K.REAL
        items = F.transform(col, lambda x: json_value(x, elem))
        return F.when(col.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
    if kind.name == "custom" and kind.type_name == "object":
        return F.coalesce(F.to_json(col, {"ignoreNullFields": "false"}), F.lit("null"))
    text = shown(col, kind) if kind.name not in ("timestamp", "timestamptz") else F.replace(shown(col, kind), F.lit(" "), F.lit("T"))
    packed = F.to_json(F.array(text))
    quoted = F.regexp_replace(packed, r"^\[|\]$", "")
    return F.when(col.isNull(), F.lit("null")).otherwise(quoted)
