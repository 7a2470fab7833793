"""The select builder: immutable, each call returns a new query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..errors import KindError, ScopeError
from ..kinds import comparable
from ..plans.expr import Builder, Expr, Scope, condition
from ..plans.frames import Join, Order, SelectNode, build
from ..schema import Table
from .pagination import Paginated
from .query import Query

LOCKS = ("for update", "for no key update", "for share", "for key share")


class Joining:
    """A join that still needs its condition."""

    def __init__(self, query: Select, table: Table, how: str):
        self._query, self._table, self._how = query, table, how

    def on(self, *args) -> Select:
        node = self._query.node
        scope = Scope([*node.tables, self._table])
        eb = Builder(scope)
        if len(args) == 2 and isinstance(args[1], str) and args[1].partition(".")[0] in scope.tables:
            left, right = eb.ref(args[0]), eb.ref(args[1])
            if not comparable(left.kind, right.kind):
                raise KindError(f"{left.kind} does not compare with {right.kind}")
            test = left.eq(right)
        else:
            test = condition(eb, *args)
        return self._query._node(joins=(*node.joins, Join(self._table, self._how, test)))


class Select(Query, Paginated):
    def __init__(self, table: Table, database=None):
        self.node, self._db = SelectNode(table), database

    def _node(self, **changes) -> Select:
        return self._with(node=replace(self.node, **changes))

    @property
    def eb(self) -> Builder:
        return Builder(Scope(self.node.tables))

    def _keys(self) -> list[str]:
        return [e.alias for e in self.node.outputs]

    # joins

    def _join(self, table: Table, how: str) -> Joining:
        Scope([*self.node.tables, table])  # refuses a name that is taken
        return Joining(self, table, how)

    def inner_join(self, table: Table) -> Joining:
        return self._join(table, "inner")

    def left_join(self, table: Table) -> Joining:
        return self._join(table, "left")

    def right_join(self, table: Table) -> Joining:
        return self._join(table, "right")

    def full_join(self, table: Table) -> Joining:
        return self._join(table, "full")

    def cross_join(self, table: Table) -> Select:
        self._join(table, "cross")
        return self._node(joins=(*self.node.joins, Join(table, "cross")))

    # rows and columns

    def where(self, *args) -> Select:
        return self._node(where=(*self.node.where, condition(self.eb, *args)))

    def select(self, *columns) -> Select:
        """Names of columns, aliased expressions, lists of these, or callbacks that return them."""
        return self._node(outputs=with_outputs(self.eb, self.node.outputs, columns))

    def select_all(self, alias: str) -> Select:
        if alias not in self.eb.scope.tables:
            raise ScopeError(f"{alias} is not in scope")
        return self.select(*[f"{alias}.{k}" for k in self.eb.scope.tables[alias].columns])

    def distinct(self) -> Select:
        return self._node(distinct=True, distinct_on=())

    def distinct_on(self, keys) -> Select:
        return self._node(distinct=False, distinct_on=tuple(self._key(k) for k in keys))

    def _key(self, key) -> Expr:
        """A selected key, a column, an expression or a callback."""
        if isinstance(key, Expr):
            return key
        if callable(key):
            return key(self.eb)
        for e in self.node.outputs:
            if e.alias == key:
                return replace(e, alias=None)
        return self.eb.ref(key)

    def group_by(self, *keys) -> Select:
        flat = [k for key in keys for k in (key if isinstance(key, (list, tuple)) else [key])]
        found = []
        for k in flat:
            e = self._key(k)
            found += e if isinstance(e, (list, tuple)) else [e]
        return self._node(group_by=(*self.node.group_by, *found))

    def having(self, *args) -> Select:
        return self._node(having=(*self.node.having, condition(self.eb, *args)))

    def order_by(self, key, direction: str = "asc", nulls: str | None = None) -> Select:
        if direction not in ("asc", "desc") or nulls not in (None, "first", "last"):
            raise ValueError("order_by takes asc or desc, and nulls first or last")
        order = Order(self._key(key), direction == "desc", nulls == "first" if nulls else direction == "desc")
        return self._node(order_by=(*self.node.order_by, order))

    def limit(self, n: int) -> Select:
        return self._node(limit=_natural(n))

    def offset(self, n: int) -> Select:
        return self._node(offset=_natural(n))

    # locks: accepted and checked; stored versions never change, so there is nothing to lock

    def _lock(self, strength: str) -> Select:
        return self._node(lock=(strength, (), ""))

    def for_update(self) -> Select:
        return self._lock(LOCKS[0])

    def for_no_key_update(self) -> Select:
        return self._lock(LOCKS[1])

    def for_share(self) -> Select:
        return self._lock(LOCKS[2])

    def for_key_share(self) -> Select:
        return self._lock(LOCKS[3])

    def _locked(self):
        if not self.node.lock:
            raise KindError("choose a lock first")
        return self.node.lock

    def of(self, *aliases: str) -> Select:
        strength, _, wait = self._locked()
        for a in aliases:
            if a not in self.eb.scope.tables:
                raise ScopeError(f"{a} is not in scope")
        return self._node(lock=(strength, aliases, wait))

    def skip_locked(self) -> Select:
        strength, of, _ = self._locked()
        return self._node(lock=(strength, of, "skip locked"))

    def no_wait(self) -> Select:
        strength, of, _ = self._locked()
        return self._node(lock=(strength, of, "nowait"))

    # pieces

    def when(self, test, build: Callable[[Select], Select]) -> Select:
        return build(self) if test else self

    def pipe(self, piece: Fragment) -> Select:
        missing = [t.alias for t in piece.tables if t.alias not in self.eb.scope.tables]
        if missing:
            raise ScopeError(f"the piece needs {', '.join(missing)}")
        return piece.build(self)

    # running

    def frame(self) -> DataFrame:
        """The plan as a DataFrame, in the declared order of columns."""
        return build(self.node, self._database().load)

    def _database(self):
        if self._db is None:
            raise ScopeError("the query belongs to no database; run it by db.batch or db.run")
        return self._db

    def execute(self, timeout: float | str | None = None, signal=None):
        return self._database()._run(self, timeout, signal)

    def _result(self, database):
        df = build(self.node, database.load)
        decode = database.decoder(self.node)
        rows = lambda n: [decode(r) for r in (df.collect() if n is None else df.limit(n).collect())]
        return self._shaped(rows, df.count)

    def describe(self):
        """The result's schema; no job runs."""
        return self.frame().schema

    def to_node(self) -> SelectNode:
        return self.node

    def to_where_node(self) -> tuple[Expr, ...]:
        return self.node.where

    def explain(self, mode: str = "formatted") -> str:
        df = self.frame()
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def stream(self, batch_size: int = 1000, read_ahead: bool = False):
        from ..streaming.rows import RowStream

        return RowStream(self, batch_size, read_ahead)


def _natural(n) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError(f"{n!r} is no number of rows")
    return n


def with_outputs(eb: Builder, outputs: tuple[Expr, ...], columns) -> tuple[Expr, ...]:
    found = list(outputs)
    queue = list(columns)
    while queue:
        c = queue.pop(0)
        if isinstance(c, (list, tuple)):
            queue = [*c, *queue]
        elif isinstance(c, Expr):
            if not c.alias:
                raise ScopeError("a selected expression needs a key; use as_")
            found.append(c)
        elif callable(c):
            queue.insert(0, c(eb))
        else:
            found.append(eb.ref(c).as_(c.partition(".")[2]))
    keys = [e.alias for e in found]
    if len(set(keys)) != len(keys):
        raise ScopeError(f"key {next(k for k in keys if keys.count(k) > 1)} is selected twice")
    return tuple(found)


@dataclass(frozen=True)
class Fragment:
    tables: tuple[Table, ...]
    build: Callable[[Select], Select]


def fragment(tables, build: Callable[[Select], Select]) -> Fragment:
    """A piece for any query that contains the tables."""
    return Fragment(tuple(tables) if isinstance(tables, (list, tuple)) else (tables,), build)


def select_from(table: Table) -> Select:
    return Select(table)
