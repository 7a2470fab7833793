"""Pages by key (seek) and by number, and batches in key order."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, replace

from ..errors import InvalidCursorError, ScopeError
from ..plans.expr import Expr
from ..plans.frames import Order


@dataclass(frozen=True)
class CursorPage:
    rows: list
    next_cursor: str | None
    has_more: bool


@dataclass(frozen=True)
class NumberedPage:
    rows: list
    page: int
    per_page: int
    has_more: bool
    total: int | None = None


def encode_cursor(by: list[str], direction: str, after: list[str]) -> str:
    text = json.dumps({"by": by, "direction": direction, "after": after}, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(cursor: str, by: list[str], direction: str) -> list[str]:
    try:
        found = json.loads(base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True))
        after = found["after"]
        fits = found["by"] == by and found["direction"] == direction and len(after) == len(by) and all(isinstance(a, str) for a in after)
    except (ValueError, KeyError, TypeError):
        raise InvalidCursorError("the cursor is damaged") from None
    if not fits:
        raise InvalidCursorError("the cursor belongs to another query")
    return after


def seek(keys: list[Expr], after: list[Expr], descending: bool) -> Expr:
    """Rows behind a place, as comparisons of single columns that reach the scan."""
    parts = []
    for i, (key, value) in enumerate(zip(keys, after, strict=True)):
        same = [k.eq(v) for k, v in zip(keys[:i], after[:i], strict=True)]
        beyond = key.lt(value) if descending else key.gt(value)
        parts.append(Expr("and", (*same, beyond)) if same else beyond)
    return Expr("or", tuple(parts)) if len(parts) > 1 else parts[0]


class Paginated:
    def _by(self, by) -> tuple[list[str], list[Expr]]:
        names = [by] if isinstance(by, str) else list(by)
        node = self.node
        if not names:
            raise ScopeError("pages need a key")
        if node.order_by or node.limit is not None or node.offset:
            raise ScopeError("a paged query has no order, limit or offset of its own")
        keys = []
        for name in names:
            key = self.eb.ref(name)
            alias, column = key.payload
            if not any(e.op == "ref" and e.payload == key.payload and e.alias == column for e in node.outputs):
                raise ScopeError(f"{name} is a page key, so it is selected under its own name")
            declared = self.eb.scope.tables[alias].columns[column]
            optional = any(j.how in ("left", "full") and j.table.alias == alias for j in node.joins) or any(j.how in ("right", "full") for j in node.joins) and alias == node.table.alias
            if declared.null or optional:
                raise ScopeError(f"{name} is a page key, so it is never null")
            keys.append(key)
        return names, keys

    def _ordered(self, keys, direction: str):
        if direction not in ("asc", "desc"):
            raise ValueError("pages go asc or desc")
        down = direction == "desc"
        return self._node(order_by=tuple(Order(k, down, down) for k in keys))

    def _behind(self, keys, texts: list[str], direction: str):
        """The query's rows behind a place given as exact key texts."""
        values = []
        for key, text in zip(keys, texts, strict=True):
            given = Expr("value", (), replace(key.kind, name="text", labels=()) if key.kind.name != "text" else key.kind, text)
            values.append(given if key.kind.name in ("text", "varchar", "uuid", "enum") else Expr("key", (given,), key.kind))
        return self._node(where=(*self.node.where, seek(keys, values, direction == "desc")))

    def _keyed_rows(self, keys, n: int) -> tuple[list, list[list[str]]]:
        """The first ``n`` rows and the texts of their keys, which lose no digits."""
        from ..plans.frames import build

        db = self._database()
        extra = [Expr("key text", (k,), replace(k.kind, name="text", labels=()), alias=f"#key{i}") for i, k in enumerate(keys)]
        node = replace(self.node, outputs=(*self.node.outputs, *extra), limit=n)
        decode, found = db.decoder(self.node), build(node, db.load).collect()
        return [decode(r) for r in found], [[r[f"#key{i}"] for i in range(len(keys))] for r in found]

    def paginate_by_cursor(self, per_page: int, by, direction: str = "asc", after: str | None = None) -> CursorPage:
        names, keys = self._by(by)
        query = self._ordered(keys, direction)
        if after is not None:
            query = query._behind(keys, decode_cursor(after, names, direction), direction)
        rows, texts = query._keyed_rows(keys, _positive(per_page) + 1)
        more = len(rows) > per_page
        cursor = encode_cursor(names, direction, texts[per_page - 1]) if more else None
        return CursorPage(rows[:per_page], cursor, more)

    def paginate_by_offset(self, page: int, per_page: int, by, direction: str = "asc", count_total: bool = False) -> NumberedPage:
        _, keys = self._by(by)
        start = (_positive(page) - 1) * _positive(per_page)
        rows = self._ordered(keys, direction).offset(start).limit(per_page + 1).execute()
        total = self.frame().count() if count_total else None
        return NumberedPage(rows[:per_page], page, per_page, len(rows) > per_page, total)

    def iterate_chunks(self, size: int, by, direction: str = "asc"):
        """Every row in batches; each batch is a query behind the last row."""
        _, keys = self._by(by)
        query = self._ordered(keys, _positive(size) and direction)
        texts = None
        while True:
            at = query if texts is None else query._behind(keys, texts, direction)
            rows, found = at._keyed_rows(keys, size)
            if rows:
                yield rows
            if len(rows) < size:
                return
            texts = found[-1]


def _positive(n) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError(f"{n!r} is no count of rows")
    return n
