"""Inserts, upserts, updates and deletes over the snapshot store."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import KindError, NotNullViolation, QueryError, ScopeError, UndefinedParameterError, UniqueViolation
from ..kinds import UNSET
from ..plans.expr import Builder, Env, Expr, Scope, condition
from ..plans.frames import named_frame
from ..plans.literals import literal
from ..schema import Table
from .query import Query
from .select import with_outputs


@dataclass(frozen=True)
class Written:
    row_count: int


def _writable(table: Table, key: str) -> None:
    if key not in table.columns:
        raise ScopeError(f"{table.source} has no column {key}")
    if not table.columns[key].writable:
        raise KindError(f"{table.source}.{key} is {table.columns[key].fill} and never written")


class Write(Query):
    def __init__(self, table: Table, database=None):
        self.table, self._db = table, database
        self._outputs: tuple[Expr, ...] = ()

    def _scope(self) -> list[Table]:
        return [self.table]

    def _keys(self):
        return [e.alias for e in self._outputs]

    def returning(self, *columns):
        return self._with(_outputs=with_outputs(Builder(Scope(self._scope())), self._outputs, columns))

    def returning_all(self):
        return self.returning(*[f"{self.table.alias}.{k}" for k in self.table.columns])

    def expect_rows(self, n: int, error=None):
        return self._with(_expected=n, _error=error)

    def execute(self, timeout=None, signal=None):
        if self._db is None:
            raise ScopeError("the query belongs to no database")
        return self._db._run(self, timeout, signal)

    def _result(self, database):
        with database._writing() as view:
            affected = self._affect(view, database)
            count = affected.count()
            self._check_count(count)
            if not self._outputs:
                return Written(count)
            env = Env()
            shown = affected.select(*[env.lower(e).alias(e.alias) for e in self._outputs])
            decode = database.decoder_of(self._outputs)
            return self._shaped(lambda n: [decode(r) for r in (shown.collect() if n is None else shown.limit(n).collect())], lambda: count)

    # shared steps

    def _write(self, view, df: DataFrame) -> tuple[str, DataFrame]:
        path = view.store.new_path(self.table)
        df.write.parquet(path)
        return path, view.store.spark.read.parquet(path)

    def _stored(self, df: DataFrame, extra: list[Column] = ()) -> DataFrame:
        """Columns ``alias.key`` under their database names."""
        t = self.table
        own = [F.col(f"`{t.alias}.{k}`").cast(c.kind.spark).alias(t.db_name(k)) for k, c in t.columns.items()]
        return df.select(*own, *extra)

    def _check_nulls(self, df: DataFrame) -> None:
        needed = [k for k, c in self.table.columns.items() if not c.null]
        if needed:
            seen = df.agg(*[F.max(F.col(f"`{self.table.db_name(k)}`").isNull().cast("int")).alias(k) for k in needed]).first()
            bad = [k for k in needed if seen[k]]
            if bad:
                raise NotNullViolation(f"null in {self.table.source}.{bad[0]}", self.table.source, (bad[0],))

    def _located(self, view) -> DataFrame:
        """The table's rows as ``alias.key`` columns, each with its ``#file``."""
        named = [F.col(f"`{self.table.db_name(k)}`").cast(c.kind.spark).alias(f"{self.table.alias}.{k}") for k, c in self.table.columns.items()]
        return view.located(self.table).select(*named, "`#file`")

    def _check_unique(self, new: DataFrame, old: list[DataFrame], keys: list[tuple[str, ...]]) -> None:
        """No key of the ``new`` rows stands in them twice or in ``old`` rows, of which only the keys are read."""
        for key in keys:
            names = [self.table.db_name(k) for k in key]
            own = new.select(*[F.col(f"`{n}`") for n in names])
            present = reduce(lambda a, b: a & b, [F.col(f"`{n}`").isNotNull() for n in names])
            twice = own.where(present).groupBy(*own.columns).count().where("count > 1")
            # the new rows are the smaller side: as the right one they can be broadcast
            if not twice.isEmpty() or any(not df.select(*own.columns).join(own, names, "left_semi").isEmpty() for df in old):
                raise UniqueViolation(f"duplicate {', '.join(key)} in {self.table.source}", self.table.source, tuple(key))

    def _unique_keys(self) -> list[tuple[str, ...]]:
        return [(k,) for k, c in self.table.columns.items() if c.is_unique]

    def _generated(self, df: DataFrame) -> DataFrame:
        """Columns computed from the row's others."""
        eb = Builder(Scope([self.table]))
        for k, c in self.table.columns.items():
            if c.fill == "generated" and c.value is not UNSET:
                df = df.withColumn(f"{self.table.alias}.{k}", Env().lower(c.value(eb)).cast(c.kind.spark))
        return df


class Insert(Write):
    _rows: tuple[dict, ...] = ()
    _conflict: tuple | None = None
    _action: tuple | None = None

    def values(self, rows):
        rows = [rows] if isinstance(rows, dict) else list(rows)
        for row in rows:
            for key, value in row.items():
                _writable(self.table, key)
                if value is UNSET:
                    raise UndefinedParameterError(f"{key} has no value")
        return self._with(_rows=(*self._rows, *rows))

    def on_conflict(self, *keys):
        keys = [k for key in keys for k in (key if isinstance(key, (list, tuple)) else [key])]
        for k in keys:
            if k not in self.table.columns:
                raise ScopeError(f"{self.table.source} has no column {k}")
        return Conflict(self, tuple(keys))

    def _new_rows(self, view) -> tuple[DataFrame, dict[str, int]]:
        """The rows to insert as ``alias.key`` columns, with defaults and identities."""
        t, spark = self.table, view.store.spark
        identity, out = {}, []
        for k, c in t.columns.items():
            if c.fill == "identity":
                identity[f"{t.source}.{k}"] = view.state.identity.get(f"{t.source}.{k}", 0)
        plain, built = [], []
        for row in self._rows:
            values = {}
            for k, c in t.columns.items():
                if c.fill == "identity":
                    identity[f"{t.source}.{k}"] += 1
                    values[k] = identity[f"{t.source}.{k}"]
                elif c.fill == "generated":
                    values[k] = None
                elif k in row:
                    v = row[k]
                    values[k] = c.codec.encode(v) if c.codec and v is not None and not isinstance(v, Expr) else v
                elif c.fill == "default" and c.value is not UNSET:
                    values[k] = c.value() if callable(c.value) else c.value
                elif c.fill == "default" or c.null:
                    values[k] = None
                else:
                    raise NotNullViolation(f"{t.source}.{k} needs a value", t.source, (k,))
            (plain if all(_direct(v, t.columns[k].kind) for k, v in values.items()) else built).append(values)
        if plain:
            from pyspark.sql import types as T

            schema = T.StructType([T.StructField(f"{t.alias}.{k}", c.kind.spark) for k, c in t.columns.items()])
            out.append(spark.createDataFrame([tuple(_python(r[k], t.columns[k].kind) for k in t.columns) for r in plain], schema))
        env = Env()
        for r in built:
            cols = [(env.lower(v) if isinstance(v, Expr) else literal(v, t.columns[k].kind)).cast(t.columns[k].kind.spark).alias(f"{t.alias}.{k}") for k, v in r.items()]
            out.append(spark.range(1).select(*cols))
        if not out:
            raise ScopeError("an insert needs rows")
        return self._generated(reduce(DataFrame.unionByName, out)), identity

    def _affect(self, view, database) -> DataFrame:
        t = self.table
        new, identity = self._new_rows(view)
        paths = list(view.state.paths.get(t.source, []))
        old = view.load(t)
        if self._conflict is None:
            path, written = self._write(view, self._stored(new))
            self._check_nulls(written)
            self._check_unique(written, [old], self._unique_keys())
            view.stage(t, [*paths, path], identity)
            return named_frame(t, written, False)
        key, partial = self._conflict
        _, written = self._write(view, self._stored(new))
        self._check_nulls(written)
        named_old, proposed = named_frame(t, old, False), named_frame(t, written, False)
        env, matched = Env(), named_old
        if partial is not None:
            matched = named_old.where(env.lower(partial))
        names = [f"{t.alias}.{k}" for k in key]
        quoted = [F.col(f"`{n}`") for n in names]
        # the old keys that are proposed again: the proposed rows are the side to broadcast
        taken = matched.select(*quoted).join(proposed.select(*quoted), names, "left_semi")
        fresh = proposed.join(taken, names, "left_anti")
        if self._action[0] == "nothing":
            path, added = self._write(view, self._stored(fresh.dropDuplicates(names)))
            view.stage(t, [*paths, path], identity)
            return named_frame(t, added, False)
        twice = proposed.groupBy(*quoted).count().where("count > 1")
        if not twice.isEmpty():
            raise QueryError("an upsert cannot touch a row twice")
        excluded = t.as_("excluded")
        other = proposed.toDF(*[c.replace(f"{t.alias}.", "excluded.", 1) for c in proposed.columns]).withColumn("#met", F.lit(True))
        on = reduce(lambda a, b: a & b, [F.col(f"`{t.alias}.{k}`") == F.col(f"`excluded.{k}`") for k in key])
        if partial is not None:
            on = on & env.lower(partial)
        changes, test = self._changes(excluded)
        hit = F.coalesce(F.col("`#met`"), F.lit(False))
        if test is not None:
            hit = hit & F.coalesce(env.lower(test), F.lit(False))
        touched, kept = view.split(t, self._located(view).join(other, on, "left").where(hit))
        pairs = named_frame(t, view.load(t, touched), False).join(other, on, "left").withColumn("#hit", hit)
        updated = pairs.select(*[_changed(env, t, k, changes) for k in t.columns], "#hit")
        both = self._generated(updated.unionByName(fresh.withColumn("#hit", F.lit(True))))
        path, whole = self._write(view, self._stored(both, [F.col("`#hit`")]))
        changed = whole.where(F.col("`#hit`"))
        self._check_nulls(changed)
        self._check_unique(changed, [whole.where(~F.col("`#hit`")), view.load(t, kept)], self._unique_keys())
        view.stage(t, [*kept, path], identity)
        return named_frame(t, changed, False)

    def _changes(self, excluded: Table):
        t = self.table
        eb = Builder(Scope([t, excluded]))
        what, given, test = self._action
        if what == "merge":
            keys = given or [k for k in dict.fromkeys(k for r in self._rows for k in r) if k not in self._conflict[0]]
            changes = {k: eb.ref(f"excluded.{k}") for k in keys}
        else:
            changes = given(_Excluded(eb), eb)
        for k in changes:
            _writable(t, k)
        return changes, None if test is None else condition(eb, test)


class _Excluded:
    def __init__(self, eb):
        self._eb = eb

    def __getattr__(self, key):
        return self._eb.ref(f"excluded.{key}")


class Conflict:
    def __init__(self, insert: Insert, keys: tuple[str, ...], partial=None):
        self._insert, self._on, self._partial = insert, keys, partial

    def where(self, *args):
        """Conflicts only with rows that meet a condition, as of a partial unique index."""
        return Conflict(self._insert, self._on, condition(Builder(Scope([self._insert.table])), *args))

    def _done(self, action) -> Insert:
        return self._insert._with(_conflict=(self._on, self._partial), _action=action)

    def do_nothing(self) -> Insert:
        return self._done(("nothing",))

    def merge(self, keys: list[str] | None = None, where=None) -> Insert:
        return self._done(("merge", keys, where))

    def do_update(self, build, where=None) -> Insert:
        """``build(excluded, eb)`` returns the new values by key."""
        return self._done(("update", build, where))


def _direct(value, kind) -> bool:
    return not isinstance(value, Expr) and kind.name not in ("daterange", "tstzrange")


def _python(value, kind):
    """A value as ``createDataFrame`` takes it for a kind."""
    import datetime as dt
    import decimal
    import json

    from ..plans.literals import interval_parts, time_micros

    if value is None:
        return None
    if kind.name == "jsonb":
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    if kind.name == "interval":
        return interval_parts(value)
    if kind.name == "time":
        return time_micros(value)
    if kind.name == "decimal":
        return decimal.Decimal(str(value))
    if kind.name in ("real", "double"):
        return float(value)
    if kind.name == "vector":
        return [float(v) for v in value]
    if kind.name == "array":
        return [_python(v, kind.elem) for v in value]
    if kind.name == "date" and isinstance(value, str):
        return dt.date.fromisoformat(value)
    if kind.name in ("timestamp", "timestamptz") and isinstance(value, str):
        return dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    if kind.name == "enum" and value not in kind.labels:
        raise KindError(f"{value!r} is no label of {kind}")
    if kind.name == "custom":
        return _python(value, kind.base)
    return value


def _changed(env: Env, table: Table, key: str, changes: dict, hit: str = "#hit") -> Column:
    name, kind = f"{table.alias}.{key}", table.columns[key].kind
    if key not in changes:
        return F.col(f"`{name}`")
    value = changes[key]
    codec = table.columns[key].codec
    if isinstance(value, Expr):
        new = env.lower(value)
    else:
        new = literal(codec.encode(value) if codec and value is not None else value, kind)
    return F.when(F.col(f"`{hit}`"), new.cast(kind.spark)).otherwise(F.col(f"`{name}`")).alias(name)


class Conditional(Write):
    _where: tuple[Expr, ...] = ()
    _all: bool = False

    def where(self, *args):
        return self._with(_where=(*self._where, condition(Builder(Scope(self._scope())), *args)))

    def all_rows(self):
        return self._with(_all=True)

    def _test(self, env: Env) -> Column:
        tests = [F.coalesce(env.lower(w), F.lit(False)) for w in self._where]
        return reduce(lambda a, b: a & b, tests, F.lit(True))


class Update(Conditional):
    _set: dict = {}
    _each: tuple | None = None

    def _scope(self):
        return [self.table, self._each[2]] if self._each else [self.table]

    def set(self, values):
        """Values by key, or a callback that gets ``eb``; a second call adds to and replaces the first."""
        given = values(Builder(Scope(self._scope()))) if callable(values) else values
        given = {k: v for k, v in given.items() if v is not UNSET}
        for k in given:
            _writable(self.table, k)
        return self._with(_set={**self._set, **given})

    def set_each(self, rows: list[dict], key, as_: str = "row"):
        """Each row's own values, matched by ``key``; a key left out keeps its value, None sets null."""
        keys = (key,) if isinstance(key, str) else tuple(key)
        seen = set()
        for row in rows:
            if any(row.get(k) is None for k in keys):
                raise ScopeError(f"a row without {', '.join(keys)}")
            at = tuple(row[k] for k in keys)
            if at in seen:
                raise ScopeError(f"two rows of {at}")
            seen.add(at)
            for k in row:
                if k not in keys:
                    _writable(self.table, k)
        columns = {k: replace(self.table.columns[k], null=True, fill=None) for k in dict.fromkeys([*keys, *(k for r in rows for k in r)])}
        return self._with(_each=(tuple(rows), keys, Table(as_, columns)))

    def _affect(self, view, database) -> DataFrame:
        t = self.table
        if not (self._where or self._all or self._each):
            raise ScopeError("an update needs where, all_rows or set_each")
        env, changes = Env(), dict(self._set)
        hit = self._test(env)
        if self._each:
            rows, keys, source = self._each
            hit = hit & F.coalesce(F.col("`#given`"), F.lit(False))
            eb = Builder(Scope([t, source]))
            for k in source.columns:
                if k not in keys and k not in changes:
                    own, old = eb.ref(f"{source.alias}.{k}"), eb.ref(f"{t.alias}.{k}")
                    given = Expr("column", (), payload=F.col(f"`#set.{k}`"))
                    changes[k] = Expr("case", (given, own, old), t.columns[k].kind)
        if not changes:
            raise ScopeError("an update sets something")

        def aimed(df):
            return (self._joined(view, df, *self._each) if self._each else df).withColumn("#hit", hit)

        touched, kept = view.split(t, aimed(self._located(view)).where(F.col("`#hit`")))
        df = aimed(named_frame(t, view.load(t, touched), False))
        extra = [c for c in df.columns if self._each and c.startswith(f"{self._each[2].alias}.")]
        new = df.select(*[_changed(env, t, k, changes) for k in t.columns], *[F.col(f"`{c}`") for c in extra], "#hit")
        path, whole = self._write(view, self._stored(self._generated(new), [F.col(f"`{c}`") for c in [*extra, "#hit"]]))
        changed = whole.where(F.col("`#hit`"))
        self._check_nulls(changed)
        changed_unique = [key for key in self._unique_keys() if set(key) & set(changes)]
        self._check_unique(changed, [whole.where(~F.col("`#hit`")), view.load(t, kept)], changed_unique)
        view.stage(t, [*kept, path] if touched else kept)
        own = [F.col(f"`{t.db_name(k)}`").alias(f"{t.alias}.{k}") for k in t.columns]
        return changed.select(*own, *[F.col(f"`{c}`") for c in extra])

    def _joined(self, view, df, rows, keys, source: Table) -> DataFrame:
        from pyspark.sql import types as T

        fields = [T.StructField(f"{source.alias}.{k}", c.kind.spark) for k, c in source.columns.items()]
        fields += [T.StructField(f"#set.{k}", T.BooleanType()) for k in source.columns]
        data = [(*[_python(r.get(k), c.kind) for k, c in source.columns.items()], *[k in r for k in source.columns]) for r in rows]
        given = view.store.spark.createDataFrame(data, T.StructType(fields)).withColumn("#given", F.lit(True))
        on = reduce(lambda a, b: a & b, [F.col(f"`{self.table.alias}.{k}`") == F.col(f"`{source.alias}.{k}`") for k in keys])
        # rows given by the caller are held by the driver already; few enough of them are sent to all executors
        return df.join(F.broadcast(given) if len(rows) <= 100_000 else given, on, "left")


class Delete(Conditional):
    def _affect(self, view, database) -> DataFrame:
        t = self.table
        if not (self._where or self._all):
            raise ScopeError("a delete needs where or all_rows")
        hit = self._test(Env())
        if self._all and not self._where:
            df = named_frame(t, view.load(t), False)
            view.stage(t, [])
            return df
        touched, kept = view.split(t, self._located(view).where(hit))
        df = named_frame(t, view.load(t, touched), False)
        if touched:
            kept.append(self._write(view, self._stored(df.where(~hit)))[0])
        view.stage(t, kept)
        return df.where(hit)


def insert_into(table: Table) -> Insert:
    return Insert(table)


def update(table: Table) -> Update:
    return Update(table)


def delete_from(table: Table) -> Delete:
    return Delete(table)
