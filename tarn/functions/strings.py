"""String functions, and values as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kinds import Kind
from ..plans.expr import Expr, lowers


def as_text(col: Column, kind: Kind, boolean: tuple[str, str] = ("t", "f")) -> Column:
    """A value's text as a query result shows it."""
    if kind.name == "boolean":
        return F.when(col, boolean[0]).when(~col, boolean[1])
    if kind.name in ("real", "double"):
        return _float_text(col, 1e6 if kind.name == "real" else 1e15)
    if kind.name == "timestamp":
        return _moment_text(col)
    if kind.name == "timestamptz":
        return F.concat(_moment_text(col), F.lit("+00"))
    if kind.name == "time":
        return F.substring(_moment_text(F.timestamp_micros(col)), 12, 15)
    return col.cast("string")


def _float_text(col: Column, exponent_from: float) -> Column:
    """Shortest digits, with an exponent below 0.0001 and from a size on; at least two exponent digits."""
    text, size = col.cast("string"), F.abs(col)
    digits = F.regexp_replace(text.cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
    short = F.regexp_replace(text, r"\.0$", "")
    plain = F.when(F.contains(text, F.lit("E")), digits).otherwise(short)
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1)
    padded = F.lpad(F.regexp_replace(power, "-", ""), 2, "0")
    signed = F.concat(mantissa, F.when(F.startswith(power, F.lit("-")), "e-").otherwise("e+"), F.when(F.length(power) > 3, F.regexp_replace(power, "-", "")).otherwise(padded))
    # sizes that are written without an exponent here but with one there
    moved = F.regexp_replace(F.regexp_replace(F.regexp_replace(short, r"\.", ""), r"^(-?[0-9])([0-9]*)$", "$1.$2"), r"\.?0*$", "")
    spread = F.concat(moved, F.lit("e+"), F.lpad((F.length(F.regexp_replace(F.split_part(short, F.lit("."), F.lit(1)), "-", "")) - 1).cast("string"), 2, "0"))
    within = (size < exponent_from) & ((size >= 1e-4) | (size == 0))
    special = F.isnan(col.cast("double")) | (size == float("inf"))
    return F.when(special, text).when(within, plain).when(F.contains(text, F.lit("E")), signed).otherwise(spread)


def _moment_text(col: Column) -> Column:
    seconds = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    fraction = F.regexp_replace(F.date_format(col, "SSSSSS"), "0+$", "")
    return F.when(fraction == "", seconds).otherwise(F.concat(seconds, F.lit("."), fraction))


@lowers("lower", "upper", "length")
def _plain(expr: Expr, a: Column) -> Column:
    return getattr(F, expr.op)(a)


@lowers("trim", "ltrim", "rtrim")
def _trim(expr: Expr, a: Column) -> Column:
    return getattr(F, expr.op)(a)


@lowers("concat")
def _concat(expr: Expr, *parts: Column) -> Column:
    texts = [as_text(p, e.kind) for p, e in zip(parts, expr.args, strict=True)]
    return F.concat_ws("", *texts) if texts else F.lit("")


@lowers("substring")
def _substring(expr: Expr, text: Column, start: Column, count: Column | None = None) -> Column:
    first = F.greatest(start, F.lit(1))
    if count is None:
        return F.substring(text, first, F.length(text))
    upto = F.when(count < 0, F.raise_error(F.lit("negative substring length not allowed"))).otherwise(F.greatest(start.cast("long") + count - first, F.lit(0)))
    return F.substring(text, first, upto.cast("int"))


@lowers("replace")
def _replace(expr: Expr, text: Column, old: Column, new: Column) -> Column:
    return F.replace(text, old, new)


@lowers("strpos")
def _strpos(expr: Expr, text: Column, part: Column) -> Column:
    return F.position(part, text)


@lowers("left")
def _left(expr: Expr, text: Column, n: Column) -> Column:
    return F.substring(text, F.lit(1), F.when(n < 0, F.greatest(F.length(text) + n, F.lit(0))).otherwise(n))


@lowers("right")
def _right(expr: Expr, text: Column, n: Column) -> Column:
    kept = F.when(n < 0, F.greatest(F.length(text) + n, F.lit(0))).otherwise(F.least(n, F.length(text)))
    return F.substring(text, F.length(text) - kept + 1, kept)


@lowers("split_part")
def _split_part(expr: Expr, text: Column, mark: Column, n: Column) -> Column:
    return F.split_part(text, mark, n)


@lowers("coalesce")
def _coalesce(expr: Expr, *parts: Column) -> Column:
    return F.coalesce(*parts).cast(expr.kind.spark) if expr.kind.name != "decimal" else F.coalesce(*parts)


@lowers("nullif")
def _nullif(expr: Expr, a: Column, b: Column) -> Column:
    from .predicates import EQUAL_BY_KEY, equality_key

    left, right = expr.args[0].kind, expr.args[1].kind
    if left.name in EQUAL_BY_KEY:
        return F.when(F.coalesce(equality_key(a, left) == equality_key(b, right), F.lit(False)), F.lit(None)).otherwise(a)
    return F.nullif(a, b)


@lowers("greatest", "least")
def _extreme(expr: Expr, *parts: Column) -> Column:
    if len(parts) == 1:
        return parts[0]
    if expr.kind.name in ("enum", "interval", "inet"):
        from .predicates import sort_key

        keyed = [F.when(p.isNotNull(), F.struct(sort_key(p, expr.kind).alias("k"), p.alias("v"))) for p in parts]
        return getattr(F, expr.op)(*keyed)["v"]
    return getattr(F, expr.op)(*parts)




@lowers("key text")
def _key_text(expr: Expr, a: Column) -> Column:
    """A page key's exact text."""
    kind = expr.args[0].kind
    if kind.name == "bytea":
        return F.hex(a)
    if kind.name in ("real", "double"):
        return a.cast("string")
    if kind.name in ("timestamp", "timestamptz"):
        return F.date_format(a, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return a.cast("string")


@lowers("key")
def _key(expr: Expr, text: Column) -> Column:
    """A page key from its text."""
    return F.unhex(text) if expr.kind.name == "bytea" else text.cast(expr.kind.spark)
