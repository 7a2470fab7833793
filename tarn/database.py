"""A database: tables, queries, batches, transactions, raw SQL, import and export."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from .errors import BatchError, QueryCanceled, QueryError, ScopeError, SerializationFailure, TransactionRolledBack, TransactionTimeout, UndefinedColumn, UndefinedTable
from .functions.dates import STARTED
from .operators.query import Query
from .operators.select import Select
from .operators.write import Delete, Insert, Update
from .plans.expr import Expr
from .plans.frames import SelectNode
from .schema import Table
from .sources.store import Store, View


@dataclass(frozen=True)
class QueryEvent:
    """What ``on_query`` gets when a query has ended."""

    tag: str | None
    kind: str
    seconds: float
    row_count: int | None
    error: BaseException | None


def session(spark: SparkSession) -> SparkSession:
    """Settings that results depend on: UTC, errors instead of nulls, run-time replanning."""
    for key, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.ansi.enabled", "true"), ("spark.sql.adaptive.enabled", "true")):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


class Database:
    """Tables come from ``sources`` (a folder of ``<name>.parquet``, or a dict of paths or frames) or from the store.

    ``store`` names the folder of tables that are written.
    """

    def __init__(self, spark: SparkSession, sources: str | dict | None = None, store: str | None = None, on_query: Callable[[QueryEvent], None] | None = None):
        self.spark, self.sources, self.on_query = session(spark), sources, on_query
        self.store = Store(spark, store) if store else None
        self._view: View | None = None
        self._listeners: dict[str, list] = {}

    def close(self) -> None:
        self._listeners.clear()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    # tables

    def create(self, *tables: Table) -> None:
        """Makes empty tables in the store."""
        with self._writing() as view:
            for t in tables:
                if t.source in view.state.paths:
                    raise ScopeError(f"table {t.source} exists")
                view.stage(t, [])

    def load(self, table: Table) -> DataFrame:
        view = self._view or (View(self.store) if self.store else None)
        if view and table.source in view.state.paths:
            return view.load(table)
        found = None
        if isinstance(self.sources, dict):
            found = self.sources.get(table.source)
        elif self.sources:
            found = f"{self.sources}/{table.source}.parquet"
        if found is None:
            raise UndefinedTable(f"table {table.source} does not exist")
        try:
            df = found if isinstance(found, DataFrame) else self.spark.read.parquet(found)
        except AnalysisException as e:
            raise UndefinedTable(f"table {table.source} does not exist") from e
        missing = [table.db_name(k) for k in table.columns if table.db_name(k) not in df.columns]
        if missing:
            raise UndefinedColumn(f"table {table.source} has no column {missing[0]}")
        return df

    # queries

    def select_from(self, table: Table) -> Select:
        return Select(table, self)

    def insert_into(self, table: Table) -> Insert:
        return Insert(table, self)

    def update(self, table: Table) -> Update:
        return Update(table, self)

    def delete_from(self, table: Table) -> Delete:
        return Delete(table, self)

    def sql(self, text: str, **params) -> RawQuery:
        """A whole Spark SQL statement; ``:name`` in it takes a parameter."""
        return RawQuery(text, params, self)

    def run(self, query: Query):
        """Runs a query that was made without a database."""
        return query._with(_db=self).execute()

    def _run(self, query: Query, timeout=None, signal: threading.Event | None = None):
        began, error, result = time.perf_counter(), None, None
        tag = f"tarn-{uuid.uuid4().hex}"
        sc = self.spark.sparkContext
        canceled: list[str] = []
        seconds = _seconds(timeout)
        stop = threading.Event()

        def watch():
            end = None if seconds is None else time.monotonic() + seconds
            while not stop.wait(0.02):
                if signal is not None and signal.is_set():
                    canceled.append("aborted")
                elif end is not None and time.monotonic() > end:
                    canceled.append("timed out")
                else:
                    continue
                sc.cancelJobsWithTag(tag)
                # jobs that start after the first cancel are stopped too
                if stop.wait(0.2):
                    return

        if signal is not None and signal.is_set():
            raise QueryCanceled("aborted")
        watcher = threading.Thread(target=watch, daemon=True) if signal is not None or seconds is not None else None
        sc.addJobTag(tag)
        if watcher:
            watcher.start()
        try:
            result = query._result(self)
            return result
        except PySparkException as e:
            error = QueryCanceled(canceled[0]) if canceled else _wrapped(e)
            raise error from e
        except Exception as e:
            error = QueryCanceled(canceled[0]) if canceled and "cancel" in str(e).lower() else e
            if error is e:
                raise
            raise error from e
        finally:
            stop.set()
            sc.removeJobTag(tag)
            if self.on_query:
                rows = len(result) if isinstance(result, list) else getattr(result, "row_count", None if result is None else 1)
                self.on_query(QueryEvent(query._tag, type(query).__name__.lower(), time.perf_counter() - began, rows, error))

    @contextmanager
    def _writing(self):
        if self._view is not None:
            yield self._view
            return
        if self.store is None:
            raise ScopeError("this database has no store to write to")
        view = View(self.store)
        yield view
        view.publish()

    # results

    def decoder(self, node: SelectNode) -> Callable[[Row], dict]:
        return self.decoder_of(node.outputs, {t.alias: t for t in node.tables})

    def decoder_of(self, outputs: tuple[Expr, ...], tables: dict[str, Table] | None = None) -> Callable[[Row], dict]:
        steps = []
        for e in outputs:
            codec = None
            if e.op == "ref" and tables and e.payload[0] in tables:
                codec = tables[e.payload[0]].columns[e.payload[1]].codec
            steps.append((e.alias, codec.decode if codec else None))

        def decode(row: Row) -> dict:
            return {key: _plain(row[key]) if fn is None or row[key] is None else fn(row[key]) for key, fn in steps}

        return decode

    # several at once

    def batch(self, queries: list[Query], transaction: bool | dict = False) -> list:
        """Results by position.  In a transaction all or nothing; else each on its own, and errors at the end."""
        if transaction:
            options = transaction if isinstance(transaction, dict) else {}
            return self.transaction(lambda tx: [tx.run(q) for q in queries], **options)
        outcomes: list[Any] = []
        for q in queries:
            try:
                outcomes.append(self.run(q))
            except Exception as e:  # noqa: BLE001  it is part of the outcome
                outcomes.append(e)
        if any(isinstance(o, Exception) for o in outcomes):
            raise BatchError(outcomes)
        return outcomes

    def transaction(self, work: Callable[[Transaction], Any], isolation: str = "repeatable read", read_only: bool = False, deferrable: bool = False, retries: int = 0, settings: dict | None = None, timeout=None, durable: bool = False):
        """``work(tx)`` against one snapshot; what it wrote is published at once if it returns, dropped if it raises."""
        if isolation not in ("read committed", "repeatable read", "serializable"):
            raise ValueError(f"{isolation!r} is no isolation level")
        if self.store is None:
            raise ScopeError("this database has no store")
        for turn in range(retries + 1):
            tx = Transaction(self, View(self.store, read_only), settings or {}, _seconds(timeout))
            try:
                return tx._outermost(work)
            except SerializationFailure:
                if turn == retries:
                    raise

    # import and export, notices, checks

    def copy_from(self, table: Table, path: str) -> int:
        from .sources.copy import copy_from

        return copy_from(self, table, path)

    def copy_rows(self, table: Table, rows) -> int:
        from .sources.copy import copy_rows

        return copy_rows(self, table, rows)

    def copy_to(self, query: Select, path: str) -> None:
        from .sources.copy import copy_to

        copy_to(query, path)

    def copy_lines(self, query: Select):
        from .sources.copy import copy_lines

        return copy_lines(query)

    def copy_writer(self, table: Table):
        """A text file object; the lines written to it are appended when it is closed."""
        from .sources.copy import CopyWriter

        return CopyWriter(self, table)

    def copy_reader(self, query: Select):
        """A text file object that reads the result's lines as they are computed."""
        from .sources.copy import CopyReader

        return CopyReader(query)

    def listen(self, channel: str, handler: Callable[[str], None]) -> Callable[[], None]:
        """Calls ``handler(payload)`` for notices of this database object; returns what ends it."""
        self._listeners.setdefault(channel, []).append(handler)
        return lambda: self._listeners.get(channel, []).remove(handler)

    def notify(self, channel: str, payload: str = "") -> None:
        for handler in list(self._listeners.get(channel, [])):
            handler(payload)

    def verify(self, tables: list[Table], strict: bool = False):
        from .verify import verify

        return verify(self, tables, strict)


class Transaction(Database):
    """What the work of a transaction gets: the database's methods over one snapshot."""

    def __init__(self, parent: Database, view: View, settings: dict, seconds: float | None):
        self.spark, self.sources, self.on_query, self.store = parent.spark, parent.sources, parent.on_query, parent.store
        self._listeners, self._view, self._parent = parent._listeners, view, parent
        self._settings, self._saved = dict(settings), {}
        self._started = parent._started if isinstance(parent, Transaction) else datetime.now(timezone.utc)
        self._end = None if seconds is None else time.monotonic() + seconds
        self._after_commit: list[Callable] = []
        self._after_rollback: list[Callable] = []
        self._failed: BaseException | None = None
        self._notices: list[tuple[str, str]] = []

    def _run(self, query, timeout=None, signal=None):
        if self._failed is not None:
            raise TransactionRolledBack("a statement of this transaction failed") from self._failed
        if self._end is not None:
            left = self._end - time.monotonic()
            if left <= 0:
                raise TransactionTimeout("the transaction took too long")
            timeout = left if timeout is None else min(left, _seconds(timeout))
        saved, token = self._view.savepoint(), STARTED.set(self._started)
        try:
            return super()._run(query, timeout, signal)
        except BaseException as e:
            self._view.restore(saved)
            self._failed = e
            raise
        finally:
            STARTED.reset(token)

    def set_local(self, name: str, value: str) -> None:
        """A session setting until the transaction ends."""
        self._saved.setdefault(name, self.spark.conf.get(name, None))
        self.spark.conf.set(name, value)

    def after_commit(self, fn: Callable) -> None:
        self._after_commit.append(fn)

    def after_rollback(self, fn: Callable) -> None:
        self._after_rollback.append(fn)

    def notify(self, channel: str, payload: str = "") -> None:
        self._notices.append((channel, payload))

    def transaction(self, work, durable: bool = False, **options):
        """A savepoint."""
        if durable:
            raise ScopeError("a durable transaction is not inside another")
        saved, inner = self._view.savepoint(), Transaction(self, self._view, {}, None)
        inner._end = self._end
        try:
            out = inner._worked(work)
        except BaseException:
            self._view.restore(saved)
            inner._restore_settings()
            for fn in inner._after_rollback:
                fn()
            raise
        inner._restore_settings()
        self._after_commit += inner._after_commit
        self._after_rollback += inner._after_rollback
        self._notices += inner._notices
        return out

    def execute_and_commit(self, query: Query):
        """Runs a query as the transaction's last one; the commit follows at once."""
        out = self.run(query)
        self._commit()
        return out

    def _worked(self, work):
        for name, value in self._settings.items():
            self.set_local(name, value)
        out = work(self)
        if self._failed is not None:
            raise self._failed
        return out

    def _commit(self) -> None:
        if not getattr(self, "_done", False):
            self._view.publish()
            self._done = True

    def _outermost(self, work):
        try:
            out = self._worked(work)
            self._commit()
        except BaseException:
            self._restore_settings()
            for fn in self._after_rollback:
                fn()
            raise
        self._restore_settings()
        for fn in self._after_commit:
            fn()
        for channel, payload in self._notices:
            self._parent.notify(channel, payload)
        return out

    def _restore_settings(self) -> None:
        for name, value in self._saved.items():
            if value is None:
                self.spark.conf.unset(name)
            else:
                self.spark.conf.set(name, value)
        self._saved = {}


class RawQuery(Query):
    def __init__(self, text: str, params: dict, database: Database):
        self._text, self._params, self._db = text, params, database

    def frame(self) -> DataFrame:
        return self._db.spark.sql(self._text, args=self._params)

    def _keys(self):
        return self.frame().columns

    def expect_rows(self, n: int, error=None):
        return self._with(_expected=n, _error=error)

    def execute(self, timeout=None, signal=None):
        return self._db._run(self, timeout, signal)

    def describe(self):
        return self.frame().schema

    def _result(self, database):
        df = self.frame()
        if self._expected is not None:
            found = df.collect()
            self._check_count(len(found))
            return [_plain(r) for r in found]
        return self._shaped(lambda n: [_plain(r) for r in (df.collect() if n is None else df.limit(n).collect())], df.count)


def _plain(value):
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def _seconds(timeout) -> float | None:
    """Seconds of a number, or of text such as ``2s`` and ``500ms``."""
    if timeout is None or isinstance(timeout, (int, float)):
        return timeout
    for unit, factor in (("ms", 0.001), ("min", 60), ("s", 1), ("h", 3600)):
        if timeout.endswith(unit):
            return float(timeout.removesuffix(unit)) * factor
    return float(timeout) / 1000


def _wrapped(error: PySparkException) -> QueryError:
    condition = error.getCondition() or ""
    if condition.startswith("TABLE_OR_VIEW_NOT_FOUND"):
        return UndefinedTable(str(error).splitlines()[0])
    if condition.startswith("UNRESOLVED_COLUMN"):
        return UndefinedColumn(str(error).splitlines()[0])
    return QueryError(str(error).splitlines()[0])
