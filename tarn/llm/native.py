"""Small helpers for writing operators as SQL expressions."""

from __future__ import annotations

#: Fixed value: words are what lies between white space.
WORDS_SQL = r"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+', 0)"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
