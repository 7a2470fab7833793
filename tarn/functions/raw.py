"""Raw SQL fragments: Spark SQL text with expressions, values and identifiers put in.

``sql("extract(year from {})", eb.ref("t.at"))`` fills the braces in order.
Values are quoted, never pasted.
"""

from __future__ import annotations

import datetime as dt
import decimal
import string
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import kinds as K
from ..errors import UnsupportedError
from ..kinds import Kind, kind_of
from ..plans.expr import Expr, lowers


@dataclass(frozen=True)
class Identifier:
    name: str

    @property
    def text(self) -> str:
        return ".".join(f"`{p.replace('`', '``')}`" for p in self.name.split("."))


@dataclass(frozen=True)
class Joined:
    parts: tuple
    separator: str = ", "


def sql(text: str, *values, kind: Kind = K.TEXT) -> Expr:
    """A fragment of a kind; ``{}`` in the text takes the next value."""
    return Expr("sql.fragment", (), kind, (text, values))


def sql_id(name: str) -> Identifier:
    return Identifier(name)


def sql_lit(value) -> Expr:
    return Expr("value", (), kind_of(value), value)


def sql_join(parts, separator: str = ", ") -> Joined:
    return Joined(tuple(parts), separator)


def _sql_text(value) -> str:
    """A Python value as Spark SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}" if -(2**31) <= value < 2**31 else f"{value}L"
    if isinstance(value, float):
        return f"double('{value!r}')"
    if isinstance(value, decimal.Decimal):
        return f"{value}BD"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP{'' if value.tzinfo else '_NTZ'} '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(map(_sql_text, value)) + ")"
    raise UnsupportedError(f"{type(value).__name__} in raw SQL")


@lowers("sql.fragment")
def _fragment(expr: Expr, env) -> Column:
    def placed(value) -> str:
        if isinstance(value, Identifier):
            return value.text
        if isinstance(value, Joined):
            return value.separator.join(placed(p) for p in value.parts)
        if not isinstance(value, Expr):
            return _sql_text(value)
        if value.op == "value":
            return _sql_text(value.payload)
        if value.op == "sql.fragment":
            return "(" + filled(*value.payload) + ")"
        if value.op == "ref" and env.override(value) is None:
            return f"`{value.payload[0]}.{value.payload[1]}`"
        return f"`{env.hoist(value)}`"

    def filled(text: str, values) -> str:
        given, out = iter(values), []
        for words, name, _, _ in string.Formatter().parse(text):
            out.append(words)
            if name is not None:
                out.append(placed(next(given)))
        return "".join(out)

    return F.expr(filled(*expr.payload)).cast(expr.kind.spark) if expr.kind.name != "decimal" else F.expr(filled(*expr.payload))
