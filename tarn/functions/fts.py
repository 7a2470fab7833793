"""Full text matching: a tsquery is parsed here and becomes a condition on the vector's lexemes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsupportedError
from ..plans.expr import Expr, lowers

_TOKEN = re.compile(r"\s*(?:(<->|<\d+>)|([&|!()])|'((?:[^']|'')+)'(:\*)?|([^\s&|!()<>':]+)(:\*)?)")
#: A lexeme of a tsvector's text and its places.
_LEXEME = r"(?:'((?:[^']|'')*)'|([^\s':]+))(?::([0-9A-D,]+))?"


def parse(query: str):
    """Nested tuples: ``("word", lexeme, prefix)``, ``("not", x)``, ``("and" | "or", x, y)``, ``("phrase", x, y, distance)``."""
    tokens, at = [], 0
    while at < len(query.rstrip()):
        m = _TOKEN.match(query, at)
        if not m:
            raise UnsupportedError(f"tsquery at {query[at:]!r}")
        if m[1]:
            tokens.append(("phrase", 1 if m[1] == "<->" else int(m[1][1:-1])))
        elif m[2]:
            tokens.append((m[2],))
        else:
            tokens.append(("word", (m[3] or m[5]).replace("''", "'"), bool(m[4] or m[6])))
        at = m.end()
    tree, rest = _level(tokens, 0)
    if rest:
        raise UnsupportedError(f"tsquery {query!r}")
    return tree


def _level(tokens, depth):
    names = [("|", "or"), ("&", "and"), ("phrase", "phrase")]
    if depth == 3:
        return _unary(tokens)
    left, tokens = _level(tokens, depth + 1)
    while tokens and tokens[0][0] == names[depth][0]:
        right, rest = _level(tokens[1:], depth + 1)
        left, tokens = (names[depth][1], left, right, *tokens[0][1:]), rest
    return left, tokens


def _unary(tokens):
    if not tokens:
        raise UnsupportedError("a tsquery that ends early")
    head, rest = tokens[0], tokens[1:]
    if head[0] == "!":
        inner, rest = _unary(rest)
        return ("not", inner), rest
    if head[0] == "(":
        inner, rest = _level(rest, 0)
        if not rest or rest[0][0] != ")":
            raise UnsupportedError("a tsquery with an open bracket")
        return inner, rest[1:]
    if head[0] != "word":
        raise UnsupportedError(f"tsquery operator {head[0]}")
    return head, rest


@lowers("tsvector.matches")
def _matches(expr: Expr, a: Column) -> Column:
    words = F.regexp_extract_all(a, F.lit(_LEXEME), F.lit(0))
    lexeme = lambda w: F.replace(F.regexp_replace(F.regexp_replace(w, r"(?<=')?:[0-9A-D,]+$", ""), "^'|'$", ""), F.lit("''"), F.lit("'"))
    lexemes = F.transform(words, lexeme)

    def places(node) -> Column:
        """Where a word or phrase ends."""
        if node[0] == "word":
            own = F.filter(words, lambda w: _same(lexeme(w), node))
            listed = F.transform(own, lambda w: F.split(F.regexp_extract(w, r":([0-9A-D,]+)$", 1), ","))
            return F.transform(F.filter(F.flatten(listed), lambda p: p != ""), lambda p: F.regexp_replace(p, "[A-D]", "").cast("int"))
        if node[0] == "phrase":
            before, after = places(node[1]), places(node[2])
            return F.filter(after, lambda p: F.array_contains(before, p - node[3]))
        raise UnsupportedError("phrases of other than words")

    def holds(node) -> Column:
        if node[0] == "word":
            return F.exists(lexemes, lambda x: _same(x, node))
        if node[0] == "not":
            return ~holds(node[1])
        if node[0] == "phrase":
            return F.size(places(node)) > 0
        a, b = holds(node[1]), holds(node[2])
        return a & b if node[0] == "and" else a | b

    return F.when(a.isNotNull(), holds(parse(expr.payload)))


def _same(lexeme: Column, node) -> Column:
    return F.startswith(lexeme, F.lit(node[1])) if node[2] else lexeme == node[1]
