"""From a select's parts to a DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import KindError, ScopeError
from ..functions.predicates import EQUAL_BY_KEY, equality_key, sort_key
from ..schema import Table
from .expr import Env, Expr


@dataclass(frozen=True)
class Join:
    table: Table
    how: str
    on: Expr | None = None


@dataclass(frozen=True)
class Order:
    key: Expr
    descending: bool = False
    nulls_first: bool = False


@dataclass(frozen=True)
class SelectNode:
    """A select as declared; every builder call makes a new one."""

    table: Table
    joins: tuple[Join, ...] = ()
    where: tuple[Expr, ...] = ()
    outputs: tuple[Expr, ...] = ()
    group_by: tuple[Expr, ...] = ()
    having: tuple[Expr, ...] = ()
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False
    distinct_on: tuple[Expr, ...] = ()
    lock: tuple[str, tuple[str, ...], str] | None = None
    label: str | None = None
    frames: Any = field(default=None, compare=False)

    @property
    def tables(self) -> list[Table]:
        return [self.table, *(j.table for j in self.joins)]

    @property
    def aggregated(self) -> bool:
        return bool(self.group_by) or bool(self.having) or any(e.aggregates for e in (*self.outputs, *(o.key for o in self.order_by)))


def named_frame(table: Table, frame: DataFrame, marked: bool) -> DataFrame:
    """The stored frame with columns ``alias.key``; ``marked`` adds one that tells rows from outer join nulls."""
    chosen = [F.col(f"`{table.db_name(k)}`").cast(c.kind.spark).alias(f"{table.alias}.{k}") for k, c in table.columns.items()]
    if marked:
        chosen.append(F.lit(True).alias(f"{table.alias}.#row"))
    return frame.select(*chosen)


def _apply_hoisted(df: DataFrame, env: Env) -> DataFrame:
    if env.hoisted:
        df = df.withColumns(env.hoisted)
        env.hoisted = {}
    return df


def joined_frame(node: SelectNode, load) -> DataFrame:
    nested = {e.payload[0] for out in node.outputs for e in out.walk() if e.op == "nest"}
    env = Env()
    df = named_frame(node.table, load(node.table), node.table.alias in nested)
    for j in node.joins:
        right = named_frame(j.table, load(j.table), j.table.alias in nested)
        if j.how == "cross":
            df = df.crossJoin(right)
        elif j.on is None:
            raise ScopeError(f"the join of {j.table.alias} has no condition")
        else:
            on = env.lower(j.on)
            if env.hoisted:
                raise KindError("raw SQL in a join condition takes columns and values only")
            df = df.join(right, on, j.how)
    return df


def order_columns(orders, lowered) -> list[Column]:
    """Nulls last when ascending and first when descending, unless said otherwise."""
    out = []
    for o, c in zip(orders, lowered, strict=True):
        name = ("desc" if o.descending else "asc") + ("_nulls_first" if o.nulls_first else "_nulls_last")
        out.append(getattr(c, name)())
    return out


def build(node: SelectNode, load) -> DataFrame:
    if node.lock and node.aggregated:
        raise KindError(f"{node.lock[0]} is not allowed with aggregates or group by")
    if node.lock and (node.distinct or node.distinct_on):
        raise KindError(f"{node.lock[0]} is not allowed with distinct")
    keys = [e.alias for e in node.outputs]
    df, env = joined_frame(node, load), Env()
    if node.where:
        tests = [env.lower(w) for w in node.where]
        df = _apply_hoisted(df, env).filter(reduce(lambda a, b: a & b, tests))
    hidden = [f"#o{i}" for i in range(len(node.order_by))]
    order_exprs = [o.key for o in node.order_by]
    if node.aggregated:
        df = _aggregate(node, df, env, keys, hidden, order_exprs)
        if node.having:
            df = df.filter(reduce(lambda a, b: a & b, [F.col(f"`#h{i}`") for i in range(len(node.having))]))
        ons = [F.col(f"`#d{i}`") for i in range(len(node.distinct_on))]
    else:
        columns = [env.lower(e).alias(k) for e, k in zip(node.outputs, keys, strict=True)]
        columns += [sort_key(env.lower(e), e.kind).alias(h) for e, h in zip(order_exprs, hidden, strict=True)]
        columns += [env.lower(e).alias(f"#d{i}") for i, e in enumerate(node.distinct_on)]
        df = _apply_hoisted(df, env).select(*columns)
        ons = [F.col(f"`#d{i}`") for i in range(len(node.distinct_on))]
    sort = order_columns(node.order_by, [F.col(f"`{h}`") for h in hidden])
    if node.distinct_on:
        for on, o in zip(node.distinct_on, node.order_by, strict=False):
            if on != o.key and o.key not in node.distinct_on:
                raise KindError("distinct_on keys come first in order_by")
        first = Window.partitionBy(*ons).orderBy(*(sort or ons))
        df = df.withColumn("#first", F.row_number().over(first)).filter(F.col("`#first`") == 1)
    elif node.distinct:
        outer = [e for e in order_exprs if not any(e == x or (e.op == "column") for x in node.outputs)]
        if outer:
            raise KindError("with distinct, order_by keys are selected ones")
        df = _distinct(df, node, keys, hidden)
    if sort:
        df = df.orderBy(*sort)
    if node.offset:
        df = df.offset(node.offset)
    if node.limit is not None:
        df = df.limit(node.limit)
    return df.select(*[F.col(f"`{k}`") for k in keys])


def _distinct(df: DataFrame, node: SelectNode, keys, hidden) -> DataFrame:
    """One row of those whose values the kinds hold equal."""
    keyed = {f"#e{i}": equality_key(F.col(f"`{k}`"), e.kind) for i, (e, k) in enumerate(zip(node.outputs, keys, strict=True)) if e.kind.name in EQUAL_BY_KEY}
    if not keyed:
        return df.distinct()
    plain = [k for e, k in zip(node.outputs, keys, strict=True) if e.kind.name not in EQUAL_BY_KEY]
    return df.withColumns(keyed).dropDuplicates([*plain, *keyed])


def _aggregate(node: SelectNode, df: DataFrame, env: Env, keys, hidden, order_exprs) -> DataFrame:
    groups = [env.lower(g) for g in node.group_by]
    df = _apply_hoisted(df, env)
    names = [f"#g{i}" for i in range(len(groups))]
    grouped = list(node.group_by)
    determined = _determined(node)

    def override(e: Expr):
        for g, name in zip(grouped, names, strict=True):
            if e == g:
                # of values that are equal but not the same, one stands for the group
                return F.min(F.col(f"`{name}v`")) if g.kind.name in EQUAL_BY_KEY else F.col(f"`{name}`")
        if e.op.startswith("agg."):
            return inner.lower(e)
        if e.op == "ref":
            if e.payload[0] in determined:
                return F.first(inner.lower(e))
            raise KindError(f"{'.'.join(e.payload)} is neither grouped nor aggregated")
        return None

    inner, outer = Env(), Env(override)
    columns = [outer.lower(e).alias(k) for e, k in zip(node.outputs, keys, strict=True)]
    columns += [outer.lower(h).alias(f"#h{i}") for i, h in enumerate(node.having)]
    columns += [sort_key(outer.lower(e), e.kind).alias(h) for e, h in zip(order_exprs, hidden, strict=True)]
    columns += [outer.lower(e).alias(f"#d{i}") for i, e in enumerate(node.distinct_on)]
    if inner.hoisted:
        df = df.withColumns(inner.hoisted)
    if outer.hoisted:
        raise KindError("raw SQL over aggregates takes columns and values only")
    if names:
        df = df.withColumns({name: equality_key(c, g.kind) for name, c, g in zip(names, groups, grouped, strict=True)} | {f"{name}v": c for name, c, g in zip(names, groups, grouped, strict=True) if g.kind.name in EQUAL_BY_KEY})
    if not columns:
        columns = [F.count(F.lit(1)).alias("#n")]
    return df.groupBy(*[F.col(f"`{n}`") for n in names]).agg(*columns)


def _determined(node: SelectNode) -> set[str]:
    """Tables whose rows a grouped unique key decides."""
    refs = [g.payload for g in node.group_by if g.op == "ref"]
    return {t.alias for t in node.tables if any(a == t.alias and k in t.unique_keys for a, k in refs)}


