"""One query for each operator, over the test tables, with the same question in SQL for comparison."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import schema as S
from .database import Database
from .functions.raw import sql
from .operators.select import Select, fragment

region = S.define_table("region", r_regionkey=S.integer().unique(), r_name=S.text())
nation = S.define_table("nation", n_nationkey=S.integer().unique(), n_name=S.text(), n_regionkey=S.integer())
customer = S.define_table("customer", c_custkey=S.bigint().unique(), c_name=S.text(), c_nationkey=S.integer(), c_acctbal=S.double_precision(), c_mktsegment=S.text())
supplier = S.define_table("supplier", s_suppkey=S.bigint().unique(), s_name=S.text(), s_nationkey=S.integer(), s_acctbal=S.double_precision())
part = S.define_table("part", p_partkey=S.bigint().unique(), p_name=S.text(), p_brand=S.text(), p_type=S.text(), p_size=S.integer(), p_retailprice=S.double_precision())
orders = S.define_table("orders", o_orderkey=S.bigint().unique(), o_custkey=S.bigint(), o_orderstatus=S.text(), o_totalprice=S.double_precision(), o_orderdate=S.timestamp(), o_orderpriority=S.text())
lineitem = S.define_table(
    "lineitem",
    l_orderkey=S.bigint(), l_partkey=S.bigint(), l_suppkey=S.bigint(), l_linenumber=S.integer(), l_quantity=S.double_precision(), l_extendedprice=S.double_precision(),
    l_discount=S.double_precision(), l_tax=S.double_precision(), l_returnflag=S.text(), l_linestatus=S.text(), l_shipdate=S.timestamp(),
)
events = S.define_table("events", event_id=S.bigint().unique(), ts=S.timestamp(), user_id=S.bigint(), event_type=S.text(), value=S.double_precision(), props=S.jsonb())
embeddings = S.define_table("embeddings", vec_id=S.bigint().unique(), embedding=S.vector(), label=S.integer())
labels = S.define_table("labels", doc_id=S.bigint().unique(), quality=S.integer(), toxic=S.integer())
documents = S.define_table("documents", doc_id=S.bigint().unique(), text=S.text(), lang=S.text(), source=S.text(), n_chars=S.bigint())

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql_text: str | None = None):
    """Registers ``fn(db) -> Select or DataFrame`` and the SQL that gives the same rows."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = fn(Database(spark, sf_dir))
            return found.frame() if isinstance(found, Select) else found

        QUERIES[name] = run
        if sql_text is not None:
            SQL[name] = sql_text
        return fn

    return register


def _revenue(eb):
    return eb.ref("lineitem.l_extendedprice").times(eb.val(1.0).minus(eb.ref("lineitem.l_discount")))


@query(
    "flagship_revenue_by_region",
    """SELECT r_name, count(*) AS n_items, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY r_name""",
)
def flagship(db):
    return (
        db.select_from(lineitem)
        .inner_join(orders).on("orders.o_orderkey", "lineitem.l_orderkey")
        .inner_join(customer).on("customer.c_custkey", "orders.o_custkey")
        .inner_join(nation).on("nation.n_nationkey", "customer.c_nationkey")
        .inner_join(region).on("region.r_regionkey", "nation.n_regionkey")
        .where(lambda eb: eb.ref("lineitem.l_shipdate").gte("1995-01-01"))
        .select("region.r_name", lambda eb: [eb.fn.count().as_("n_items"), eb.fn.cast(eb.fn.round(eb.fn.cast(eb.fn.sum(_revenue(eb)), S.decimal(38, 6).kind), 2), "double").as_("revenue")])
        .group_by("region.r_name")
        .order_by("revenue", "desc")
    )


# projection


@query("select_columns", "SELECT c_custkey, c_name FROM customer")
def _(db):
    return db.select_from(customer).select("customer.c_custkey", "customer.c_name")


@query("select_all", "SELECT * FROM nation")
def _(db):
    return db.select_from(nation).select_all("nation")


@query("alias_expr", "SELECT upper(c_name) AS name, c_acctbal * 2 AS twice FROM customer")
def _(db):
    return db.select_from(customer.as_("c")).select(lambda eb: [eb.fn.upper("c.c_name").as_("name"), eb.ref("c.c_acctbal").times(2.0).as_("twice")])


@query(
    "nest_left",
    """SELECT r_regionkey, CASE WHEN n_nationkey IS NULL THEN NULL ELSE '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' END AS nation_json
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % 2 = 0""",
)
def _(db):
    from pyspark.sql import functions as F

    found = db.select_from(region).left_join(nation).on(lambda eb: eb.and_([eb.ref("nation.n_regionkey").eq(eb.ref("region.r_regionkey")), eb.ref("nation.n_nationkey").mod(2).eq(0)]))
    found = found.select("region.r_regionkey", lambda eb: eb.nest("nation", ["n_nationkey", "n_name"]).as_("nation")).frame()
    return found.select("r_regionkey", F.to_json("nation").alias("nation_json"))


@query("raw_sql_fragment", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders WHERE o_totalprice > 100000 AND o_orderpriority = '1-URGENT'")
def _(db):
    q = db.select_from(orders).where(lambda eb: sql("{} > {} and {} = {}", eb.ref("orders.o_totalprice"), 100000.0, eb.ref("orders.o_orderpriority"), "1-URGENT", kind=S.boolean().kind))
    return q.select("orders.o_orderkey", lambda eb: sql("year({})", eb.ref("orders.o_orderdate"), kind=S.bigint().kind).as_("y"))


@query("raw_sql_statement", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey > 10 GROUP BY o_orderstatus")
def _(db):
    db.load(orders).createOrReplaceTempView("tarn_orders")
    return db.sql("select o_orderstatus, count(*) as n from tarn_orders where o_orderkey > :least group by o_orderstatus", least=10).frame()


@query("when_pipe", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_acctbal > 0")
def _(db):
    rich = fragment(customer, lambda q: q.where(lambda eb: eb.ref("customer.c_acctbal").gt(0.0)))
    q = db.select_from(orders).inner_join(customer).on("customer.c_custkey", "orders.o_custkey").pipe(rich).select("orders.o_orderkey", "customer.c_name")
    return q.when(True, lambda q: q.where("orders.o_orderstatus", "F")).when(False, lambda q: q.limit(1))


# predicates


def _parts(name: str, where: str, test):
    query(name, f"SELECT p_partkey, p_name FROM part WHERE {where}")(lambda db: db.select_from(part).where(test).select("part.p_partkey", "part.p_name"))


_parts("eq_ne", "p_brand = 'Brand#1' OR (p_size <> 5 AND p_size = 7)", lambda eb: eb.or_([eb.ref("part.p_brand").eq("Brand#1"), eb.and_([eb.ref("part.p_size").ne(5), eb.ref("part.p_size").eq(7)])]))
_parts("is_distinct", "nullif(p_size, 5) IS DISTINCT FROM 6 AND nullif(p_size, 7) IS NOT DISTINCT FROM p_size", lambda eb: eb.and_([eb.fn.nullif("part.p_size", 5).is_distinct_from(6), eb.fn.nullif("part.p_size", 7).is_not_distinct_from(eb.ref("part.p_size"))]))
_parts("in_list", "p_size IN (1, 5, 9)", lambda eb: eb.ref("part.p_size").in_([1, 5, 9]))
_parts("in_empty", "p_size > 45 OR false", lambda eb: eb.or_([eb.ref("part.p_size").gt(45), eb.ref("part.p_size").in_([])]))
_parts("not_in", "p_size NOT IN (1, 2, 3) AND p_size < 9", lambda eb: eb.and_([eb.ref("part.p_size").not_in([1, 2, 3]), eb.ref("part.p_size").lt(9)]))
_parts("between", "p_size BETWEEN 10 AND 12 OR p_retailprice NOT BETWEEN 905 AND 1800", lambda eb: eb.or_([eb.ref("part.p_size").between([10, 12]), eb.ref("part.p_retailprice").not_between([905.0, 1800.0])]))
_parts("cmp", "p_size > 10 AND p_size >= 12 AND p_size < 20 AND p_size <= 18", lambda eb: eb.and_([eb.ref("part.p_size").gt(10), eb.ref("part.p_size").gte(12), eb.ref("part.p_size").lt(20), eb.ref("part.p_size").lte(18)]))
_parts("and_or_not", "NOT (p_size = 1 OR p_size = 2) AND p_size < 5", lambda eb: eb.and_([eb.not_(eb.or_([eb.ref("part.p_size").eq(1), eb.ref("part.p_size").eq(2)])), eb.ref("part.p_size").lt(5)]))
_parts("like", "p_name LIKE '%a%' AND p_type NOT LIKE 'S%'", lambda eb: eb.and_([eb.ref("part.p_name").like("%a%"), eb.ref("part.p_type").not_like("S%")]))
_parts("ilike", "p_name ILIKE '%A%' AND p_type NOT ILIKE 's%'", lambda eb: eb.and_([eb.ref("part.p_name").ilike("%A%"), eb.ref("part.p_type").not_ilike("s%")]))
_parts("regex", "regexp_matches(p_brand, '^[[:alpha:]]+#[1-3]') AND NOT regexp_matches(p_brand, '5$')", lambda eb: eb.and_([eb.ref("part.p_brand").regex("^[[:alpha:]]+#[1-3]"), eb.ref("part.p_brand").not_regex("5$")]))
_parts("iregex", "regexp_matches(p_brand, '^brand#1', 'i') AND NOT regexp_matches(p_brand, 'BRAND#.5$', 'i')", lambda eb: eb.and_([eb.ref("part.p_brand").iregex("^brand#1"), eb.ref("part.p_brand").not_iregex("BRAND#.5$")]))
_parts("starts_with", "starts_with(p_brand, 'Brand#2')", lambda eb: eb.ref("part.p_brand").starts_with("Brand#2"))
_parts("any_all", "p_size = ANY([3, 4]) OR p_size > ALL([47, 48])", lambda eb: eb.or_([eb.ref("part.p_size").eq(eb.fn.any([3, 4])), eb.ref("part.p_size").gt(eb.fn.all([47, 48]))]))
_parts("any_param_left", "7 = ANY([p_size, 7 - p_size])", lambda eb: eb.val(7).eq(eb.fn.any(sql("array({}, 7 - {})", eb.ref("part.p_size"), eb.ref("part.p_size"), kind=S.array(S.integer()).kind))))


@query("is_null_tests", "SELECT p_partkey, nullif(p_size, 5) IS NULL AS missing, nullif(p_size, 5) IS NOT NULL AS present FROM part")
def _(db):
    return db.select_from(part).select("part.p_partkey", lambda eb: [eb.fn.nullif("part.p_size", 5).is_null().as_("missing"), eb.fn.nullif("part.p_size", 5).is_not_null().as_("present")])


@query(
    "is_true_tests",
    "SELECT p_partkey, (nullif(p_size, 5) > 9) IS TRUE AS a, (nullif(p_size, 5) > 9) IS NOT TRUE AS b, (nullif(p_size, 5) > 9) IS FALSE AS c, (nullif(p_size, 5) > 9) IS NOT FALSE AS d FROM part",
)
def _(db):
    test = lambda eb: eb.fn.nullif("part.p_size", 5).gt(9)
    return db.select_from(part).select("part.p_partkey", lambda eb: [test(eb).is_true().as_("a"), test(eb).is_not_true().as_("b"), test(eb).is_false().as_("c"), test(eb).is_not_false().as_("d")])


@query(
    "array_tests",
    """SELECT p_partkey, list_has_all([p_size, 1, 2], [1, p_size]) AS holds, list_has_all([1, 2, 3], [p_size]) AS inside, list_has_any([p_size, 4], [4, 5, 6]) AS meets, 2 AS n FROM part""",
)
def _(db):
    ints = S.array(S.integer()).kind
    arr = lambda eb, text: sql(text, *[eb.ref("part.p_size")] * text.count("{}"), kind=ints)
    return db.select_from(part).select(
        "part.p_partkey",
        lambda eb: [
            arr(eb, "array({}, 1, 2)").contains(arr(eb, "array(1, {})")).as_("holds"),
            arr(eb, "array({})").contained_by([1, 2, 3]).as_("inside"),
            arr(eb, "array({}, 4)").overlaps([4, 5, 6]).as_("meets"),
            eb.fn.cardinality(arr(eb, "array({}, 1)")).as_("n"),
        ],
    )


# joins


@query("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(db):
    return db.select_from(nation).inner_join(region).on("region.r_regionkey", "nation.n_regionkey").select("nation.n_name", "region.r_name")


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def _(db):
    q = db.select_from(customer).left_join(orders).on(lambda eb: eb.and_([eb.ref("orders.o_custkey").eq(eb.ref("customer.c_custkey")), eb.ref("orders.o_orderstatus").eq("P")]))
    return q.select("customer.c_custkey", "orders.o_orderkey")


@query("join_right", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON n_nationkey = s_nationkey")
def _(db):
    return db.select_from(supplier).right_join(nation).on("nation.n_nationkey", "supplier.s_nationkey").select("supplier.s_suppkey", "nation.n_name")


@query("join_full", "SELECT s_suppkey, p_partkey FROM supplier FULL JOIN part ON p_partkey = s_suppkey + 95")
def _(db):
    return db.select_from(supplier).full_join(part).on(lambda eb: eb.ref("part.p_partkey").eq(eb.ref("supplier.s_suppkey").plus(95))).select("supplier.s_suppkey", "part.p_partkey")


@query("join_cross", "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region")
def _(db):
    return db.select_from(nation).cross_join(region).select("nation.n_nationkey", "region.r_regionkey")


@query("self_alias", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
def _(db):
    q = db.select_from(nation.as_("a")).inner_join(nation.as_("b")).on("b.n_regionkey", "a.n_regionkey").where(lambda eb: eb.ref("a.n_nationkey").lt(eb.ref("b.n_nationkey")))
    return q.select(lambda eb: [eb.ref("a.n_name").as_("a_name"), eb.ref("b.n_name").as_("b_name")])


@query("join_theta", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey > r_regionkey")
def _(db):
    return db.select_from(nation).inner_join(region).on(lambda eb: eb.ref("nation.n_regionkey").gt(eb.ref("region.r_regionkey"))).select("nation.n_nationkey", "region.r_regionkey")


@query(
    "multi_join",
    "SELECT s_name, n_name, r_name, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL",
)
def _(db):
    q = db.select_from(lineitem).inner_join(supplier).on("supplier.s_suppkey", "lineitem.l_suppkey").inner_join(nation).on("nation.n_nationkey", "supplier.s_nationkey").inner_join(region).on("region.r_regionkey", "nation.n_regionkey")
    return q.select("supplier.s_name", "nation.n_name", "region.r_name", lambda eb: eb.fn.count().as_("n")).group_by("s_name", "n_name", "r_name")


# aggregates


def _aggregate(name: str, table, key: str, sql_text: str, build):
    source, by = table.source, key.partition(".")[2]
    query(name, f"SELECT {by}, {sql_text} FROM {source} GROUP BY {by}")(lambda db: db.select_from(table).select(key, build).group_by(key))


_double = lambda eb, e: eb.fn.cast(e, "double")

_aggregate("count_star", lineitem, "lineitem.l_returnflag", "count(*) AS n", lambda eb: eb.fn.count().as_("n"))
_aggregate("count_col", lineitem, "lineitem.l_returnflag", "count(nullif(l_linestatus, 'O')) AS n", lambda eb: eb.fn.count(eb.fn.nullif("lineitem.l_linestatus", "O")).as_("n"))
_aggregate("count_distinct", lineitem, "lineitem.l_returnflag", "count(DISTINCT l_suppkey) AS n", lambda eb: eb.fn.count_distinct("lineitem.l_suppkey").as_("n"))
_aggregate("sum_int", lineitem, "lineitem.l_returnflag", "CAST(sum(l_linenumber) AS BIGINT) AS total", lambda eb: eb.fn.sum("lineitem.l_linenumber").as_("total"))
_aggregate("sum_bigint", lineitem, "lineitem.l_returnflag", "CAST(sum(l_partkey) AS BIGINT) AS total", lambda eb: eb.fn.cast(eb.fn.sum("lineitem.l_partkey"), "bigint").as_("total"))
_aggregate("sum_double", lineitem, "lineitem.l_returnflag", "CAST(round(sum(l_quantity)) AS BIGINT) AS total", lambda eb: eb.fn.cast(eb.fn.sum("lineitem.l_quantity"), "bigint").as_("total"))
_aggregate("avg_int", lineitem, "lineitem.l_returnflag", "round(avg(l_linenumber), 6) AS mean", lambda eb: _double(eb, eb.fn.round(eb.fn.avg("lineitem.l_linenumber"), 6)).as_("mean"))
_aggregate("avg_double", lineitem, "lineitem.l_returnflag", "round(avg(l_quantity), 6) AS mean", lambda eb: _double(eb, eb.fn.round(eb.fn.cast(eb.fn.avg("lineitem.l_quantity"), S.decimal(38, 12).kind), 6)).as_("mean"))
_aggregate("min_max", orders, "orders.o_orderstatus", "min(o_orderdate) AS first, max(o_totalprice) AS most, min(o_orderpriority) AS least", lambda eb: [eb.fn.min("orders.o_orderdate").as_("first"), eb.fn.max("orders.o_totalprice").as_("most"), eb.fn.min("orders.o_orderpriority").as_("least")])
_aggregate("bool_and_or", orders, "orders.o_custkey", "bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 300000) AS some", lambda eb: [eb.fn.bool_and(eb.ref("orders.o_totalprice").gt(1000.0)).as_("every"), eb.fn.bool_or(eb.ref("orders.o_totalprice").gt(300000.0)).as_("some")])


def _sorted(frame: DataFrame, column: str, out: str, split: str | None = None) -> DataFrame:
    from pyspark.sql import functions as F

    items = F.split(column, split) if split else F.col(column)
    return frame.withColumn(out, F.array_join(F.array_sort(items), "|"))


@query("array_agg_sorted", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), '|') AS names FROM nation GROUP BY n_regionkey")
def _(db):
    return _sorted(db.select_from(nation).select("nation.n_regionkey", lambda eb: eb.fn.array_agg("nation.n_name").as_("names")).group_by("nation.n_regionkey").frame(), "names", "names")


@query("array_agg_nulls", "SELECT n_regionkey, CAST(len(array_agg(nullif(n_nationkey, 3))) AS INTEGER) AS n, count(*) > count(nullif(n_nationkey, 3)) AS has_null FROM nation GROUP BY n_regionkey")
def _(db):
    from pyspark.sql import functions as F

    found = db.select_from(nation).select("nation.n_regionkey", lambda eb: eb.fn.array_agg(eb.fn.nullif("nation.n_nationkey", 3)).as_("all")).group_by("nation.n_regionkey").frame()
    return found.select("n_regionkey", F.size("all").alias("n"), F.exists("all", lambda x: x.isNull()).alias("has_null"))


@query("string_agg_sorted", "SELECT n_regionkey, array_to_string(list_sort(string_split(string_agg(n_name, ';'), ';')), '|') AS names FROM nation GROUP BY n_regionkey")
def _(db):
    return _sorted(db.select_from(nation).select("nation.n_regionkey", lambda eb: eb.fn.string_agg("nation.n_name", ";").as_("names")).group_by("nation.n_regionkey").frame(), "names", "names", ";")


@query("json_agg", "SELECT r_regionkey, '[{\"k\":' || r_regionkey || ',\"n\":\"' || r_name || '\"}]' AS docs FROM region")
def _(db):
    return db.select_from(region).select("region.r_regionkey", lambda eb: eb.fn.jsonb_agg(eb.fn.jsonb_build_object({"k": "region.r_regionkey", "n": "region.r_name"})).as_("docs")).group_by("region.r_regionkey")


@query("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND min(o_totalprice) > 1000")
def _(db):
    q = db.select_from(orders).select("orders.o_custkey", lambda eb: eb.fn.count().as_("n")).group_by("orders.o_custkey")
    return q.having(lambda eb: eb.fn.count().gt(12)).having(lambda eb: eb.fn.min("orders.o_totalprice").gt(1000.0))


@query("group_expr", "SELECT lower(c_mktsegment) AS segment, c_acctbal < 0 AS owes, count(*) AS n FROM customer GROUP BY 1, 2")
def _(db):
    q = db.select_from(customer).select(lambda eb: [eb.fn.lower("customer.c_mktsegment").as_("segment"), eb.ref("customer.c_acctbal").lt(0.0).as_("owes"), eb.fn.count().as_("n")])
    return q.group_by("segment").group_by(lambda eb: eb.ref("customer.c_acctbal").lt(0.0))


@query("group_by_key", "SELECT c_custkey, any_value(c_name) AS c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(db):
    return db.select_from(customer).left_join(orders).on("orders.o_custkey", "customer.c_custkey").select("customer.c_custkey", "customer.c_name", lambda eb: eb.fn.count("orders.o_orderkey").as_("n")).group_by("customer.c_custkey")


@query("global_aggregate", "SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation WHERE n_nationkey > 1000")
def _(db):
    return db.select_from(nation).where(lambda eb: eb.ref("nation.n_nationkey").gt(1000)).select(lambda eb: [eb.fn.count().as_("n"), eb.fn.sum("nation.n_nationkey").as_("total")])


# order, limit, distinct


@query("order_nulls", "SELECT p_partkey, nullif(p_size, 7) AS size FROM part ORDER BY size DESC NULLS FIRST, p_partkey LIMIT 25")
def _(db):
    return db.select_from(part).select("part.p_partkey", lambda eb: eb.fn.nullif("part.p_size", 7).as_("size")).order_by("size", "desc").order_by("part.p_partkey").limit(25)


@query("order_nulls_last", "SELECT p_partkey, nullif(p_size, 50) AS size FROM part ORDER BY size DESC NULLS LAST, p_partkey LIMIT 25")
def _(db):
    return db.select_from(part).select("part.p_partkey", lambda eb: eb.fn.nullif("part.p_size", 50).as_("size")).order_by("size", "desc", nulls="last").order_by("part.p_partkey").limit(25)


@query("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 5")
def _(db):
    return db.select_from(orders).select("orders.o_orderkey", "orders.o_totalprice").order_by("orders.o_totalprice").order_by("orders.o_orderkey").limit(10).offset(5)


@query("order_hidden_expr", "SELECT o_orderkey FROM orders ORDER BY abs(o_totalprice - 100000), o_orderkey LIMIT 10")
def _(db):
    return db.select_from(orders).select("orders.o_orderkey").order_by(lambda eb: eb.fn.abs(eb.ref("orders.o_totalprice").minus(100000.0))).order_by("orders.o_orderkey").limit(10)


@query("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(db):
    return db.select_from(orders).select("orders.o_orderstatus", "orders.o_orderpriority").distinct()


@query("distinct_on", "SELECT DISTINCT ON (user_id) user_id, event_id, ts FROM events ORDER BY user_id, ts DESC, event_id DESC")
def _(db):
    return db.select_from(events).select("events.user_id", "events.event_id", "events.ts").distinct_on(["events.user_id"]).order_by("events.user_id").order_by("events.ts", "desc").order_by("events.event_id", "desc")


# strings


def _texts(name: str, sql_text: str, build):
    query(name, f"SELECT c_custkey, {sql_text} FROM customer")(lambda db: db.select_from(customer).select("customer.c_custkey", build))


_texts("lower_upper", "lower(c_name) AS a, upper(c_mktsegment) AS b", lambda eb: [eb.fn.lower("customer.c_name").as_("a"), eb.fn.upper("customer.c_mktsegment").as_("b")])
_texts("length_trim", "CAST(length(c_name) AS INTEGER) AS n, trim(' ' || c_name || ' ') AS a, ltrim('  ' || c_name) AS b, rtrim(c_name || '  ') AS c", lambda eb: [eb.fn.length("customer.c_name").as_("n"), eb.fn.trim(eb.fn.concat(" ", "customer.c_name", " ")).as_("a"), eb.fn.ltrim(eb.fn.concat("  ", "customer.c_name")).as_("b"), eb.fn.rtrim(eb.fn.concat("customer.c_name", "  ")).as_("c")])
_texts("substring_edges", "substring(c_name, 0, 2) AS a, left(c_name, 3) AS b, substring(c_name, 3) AS c, substring(c_name, 2, 4) AS d", lambda eb: [eb.fn.substring("customer.c_name", 0, 2).as_("a"), eb.fn.substring("customer.c_name", -1, 5).as_("b"), eb.fn.substring("customer.c_name", 3).as_("c"), eb.fn.substring("customer.c_name", 2, 4).as_("d")])
_texts("replace_strpos", "replace(c_name, '#', '-') AS a, CAST(strpos(c_name, '#') AS INTEGER) AS b", lambda eb: [eb.fn.replace("customer.c_name", "#", "-").as_("a"), eb.fn.strpos("customer.c_name", "#").as_("b")])
_texts("left_right_neg", "left(c_name, 3) AS a, left(c_name, -3) AS b, right(c_name, 3) AS c, right(c_name, -3) AS d", lambda eb: [eb.fn.left("customer.c_name", 3).as_("a"), eb.fn.left("customer.c_name", -3).as_("b"), eb.fn.right("customer.c_name", 3).as_("c"), eb.fn.right("customer.c_name", -3).as_("d")])
_texts("split_part", "split_part(c_name, '#', 1) AS a, split_part(c_name, '#', -1) AS b, split_part(c_name, '#', 7) AS c", lambda eb: [eb.fn.split_part("customer.c_name", "#", 1).as_("a"), eb.fn.split_part("customer.c_name", "#", -1).as_("b"), eb.fn.split_part("customer.c_name", "#", 7).as_("c")])
_texts("concat_nulls", "concat(c_name, nullif(c_mktsegment, 'BUILDING'), CASE WHEN c_nationkey > 5 THEN 't' ELSE 'f' END) AS a", lambda eb: eb.fn.concat("customer.c_name", eb.fn.nullif("customer.c_mktsegment", "BUILDING"), eb.ref("customer.c_nationkey").gt(5)).as_("a"))


# math


def _numbers(name: str, sql_text: str, build):
    query(name, f"SELECT p_partkey, {sql_text} FROM part")(lambda db: db.select_from(part).select("part.p_partkey", build))


_numbers("abs_ceil_floor", "abs(p_size - 25) AS a, ceil(p_retailprice) AS b, floor(-p_retailprice) AS c", lambda eb: [eb.fn.abs(eb.ref("part.p_size").minus(25)).as_("a"), eb.fn.ceil("part.p_retailprice").as_("b"), eb.fn.floor(eb.ref("part.p_retailprice").times(-1.0)).as_("c")])
_numbers("round_half_even", "round_even(p_size / 2.0::DOUBLE, 0) AS a", lambda eb: eb.fn.round(eb.fn.cast("part.p_size", "double").divided_by(2.0)).as_("a"))
_numbers("round_decimal", "CAST(round(CAST(p_retailprice AS DECIMAL(18, 4)), 1) AS DOUBLE) AS a", lambda eb: _double(eb, eb.fn.round(eb.fn.cast("part.p_retailprice", S.decimal(18, 4).kind), 1)).as_("a"))
_numbers("int_div_mod", "(p_size - 25) // 4 + CASE WHEN p_size < 25 AND (p_size - 25) % 4 <> 0 AND (p_size - 25) // 4 * 4 <= p_size - 25 AND (p_size - 25) // 4 < (p_size - 25) / 4.0 THEN 1 ELSE 0 END AS a, (p_size - 25) % 4 AS b", lambda eb: [eb.ref("part.p_size").minus(25).divided_by(4).as_("a"), eb.ref("part.p_size").minus(25).mod(4).as_("b")])
_numbers("arith_widen", "p_size + p_partkey AS a, p_size * 2.5::DOUBLE AS b, p_partkey - p_size AS c", lambda eb: [eb.ref("part.p_size").plus(eb.ref("part.p_partkey")).as_("a"), eb.ref("part.p_size").times(2.5).as_("b"), eb.ref("part.p_partkey").minus(eb.ref("part.p_size")).as_("c")])
_numbers("greatest_least", "greatest(p_size, 20, nullif(p_size, 7)) AS a, least(p_size, 20) AS b", lambda eb: [eb.fn.greatest("part.p_size", 20, eb.fn.nullif("part.p_size", 7)).as_("a"), eb.fn.least("part.p_size", 20).as_("b")])
_numbers("coalesce_nullif", "coalesce(nullif(p_size, 7), -1) AS a", lambda eb: eb.fn.coalesce(eb.fn.nullif("part.p_size", 7), -1).as_("a"))
_numbers("case_when", "CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS a", lambda eb: eb.case().when(eb.ref("part.p_size").lt(10), "small").when(eb.ref("part.p_size").lt(30), "medium").else_("large").end().as_("a"))
_numbers("cast_round", "CAST(round(CAST(p_retailprice AS DECIMAL(18, 2)), 0) AS INTEGER) AS a, CAST(p_size AS VARCHAR) AS b, CAST(p_size > 9 AS VARCHAR) AS c", lambda eb: [eb.fn.cast(eb.fn.cast("part.p_retailprice", S.decimal(18, 2).kind), "integer").as_("a"), eb.fn.cast("part.p_size", "text").as_("b"), eb.fn.cast(eb.ref("part.p_size").gt(9), "text").as_("c")])


# dates


def _dates(name: str, sql_text: str, build):
    query(name, f"SELECT o_orderkey, {sql_text} FROM orders")(lambda db: db.select_from(orders).select("orders.o_orderkey", build))


_UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")
_dates("date_trunc_units", ", ".join(f"CAST(date_trunc('{u}', o_orderdate) AS TIMESTAMP) AS u_{u}" for u in _UNITS), lambda eb: [eb.fn.date_trunc(u, "orders.o_orderdate").as_(f"u_{u}") for u in _UNITS])
_dates("date_trunc_decade", "CAST(date_trunc('decade', o_orderdate) AS TIMESTAMP) AS a, make_timestamp((year(o_orderdate) - 1) // 100 * 100 + 1, 1, 1, 0, 0, 0.0) AS b, make_timestamp((year(o_orderdate) - 1) // 1000 * 1000 + 1, 1, 1, 0, 0, 0.0) AS c", lambda eb: [eb.fn.date_trunc("decade", "orders.o_orderdate").as_("a"), eb.fn.date_trunc("century", "orders.o_orderdate").as_("b"), eb.fn.date_trunc("millennium", "orders.o_orderdate").as_("c")])
_FIELDS = ("year", "quarter", "month", "week", "day", "hour", "minute", "dow", "doy", "isodow", "isoyear", "decade", "century", "millennium")
_dates("extract_fields", ", ".join(f"CAST(extract({f} FROM o_orderdate) AS BIGINT) AS f_{f}" for f in _FIELDS), lambda eb: [eb.fn.cast(eb.fn.extract(f, "orders.o_orderdate"), "bigint").as_(f"f_{f}") for f in _FIELDS])
_dates("extract_epoch", "CAST(extract(epoch FROM o_orderdate) AS BIGINT) AS e, CAST(floor(extract(julian FROM o_orderdate)) AS BIGINT) AS j", lambda eb: [eb.fn.cast(eb.fn.extract("epoch", "orders.o_orderdate"), "bigint").as_("e"), eb.fn.cast(eb.fn.floor(eb.fn.extract("julian", "orders.o_orderdate")), "bigint").as_("j")])
_dates("ts_plus_interval", "o_orderdate + INTERVAL 1 MONTH + INTERVAL 2 DAY AS a, o_orderdate - INTERVAL 15 HOUR AS b", lambda eb: [eb.ref("orders.o_orderdate").plus("1 month").plus("2 days").as_("a"), eb.ref("orders.o_orderdate").minus("15 hours").as_("b")])
_dates("date_diff", "CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INTEGER) AS days, CAST(o_orderdate AS DATE) + 10 AS later", lambda eb: [eb.fn.cast("orders.o_orderdate", "date").minus(eb.val(dt.date(1995, 1, 1))).as_("days"), eb.fn.cast("orders.o_orderdate", "date").plus(10).as_("later")])
_dates("ts_diff", "CAST(extract(epoch FROM o_orderdate - TIMESTAMP '1995-01-01') AS BIGINT) AS s", lambda eb: eb.fn.cast(eb.fn.extract("epoch", eb.ref("orders.o_orderdate").minus(eb.val(dt.datetime(1995, 1, 1)))), "bigint").as_("s"))
_dates("to_char_fmt", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS a, strftime(o_orderdate, '%d %b %y') AS b", lambda eb: [eb.fn.to_char("orders.o_orderdate", "YYYY-MM-DD HH24:MI:SS").as_("a"), eb.fn.to_char("orders.o_orderdate", "DD Mon YY").as_("b")])


# JSON


def _docs(name: str, sql_text: str, build):
    query(name, f"SELECT event_id, {sql_text} FROM events")(lambda db: db.select_from(events).select("events.event_id", build))


_docs("json_text", "props ->> '$.k' AS k, props ->> '$.missing' AS none", lambda eb: [eb.json.text("events.props", "k").as_("k"), eb.json.text("events.props", "missing").as_("none")])
_docs("json_get", "CAST(json_extract(props, '$.k') AS VARCHAR) AS k", lambda eb: eb.json.get("events.props", "k").as_("k"))
_docs("json_has_key", "json_exists(props, '$.k') AS a, json_exists(props, '$.z') AS b, json_exists(props, '$.k') OR json_exists(props, '$.z') AS c, json_exists(props, '$.k') AND json_exists(props, '$.z') AS d", lambda eb: [eb.json.has_key("events.props", "k").as_("a"), eb.json.has_key("events.props", "z").as_("b"), eb.json.has_any_key("events.props", ["k", "z"]).as_("c"), eb.json.has_all_keys("events.props", ["k", "z"]).as_("d")])
_docs("json_typeof", "CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' ELSE 'string' END AS t, 'object' AS o", lambda eb: [eb.json.type_of(eb.json.get("events.props", "k")).as_("t"), eb.json.type_of("events.props").as_("o")])
_docs("json_build", "'{\"id\":' || event_id || ',\"type\":\"' || event_type || '\",\"none\":null}' AS doc", lambda eb: eb.fn.jsonb_build_object({"id": "events.event_id", "type": "events.event_type", "none": eb.fn.nullif("events.event_type", eb.ref("events.event_type"))}).as_("doc"))
_docs("json_contains", "CAST(props ->> '$.k' AS BIGINT) = 7 AS seven", lambda eb: eb.ref("events.props").contains({"k": 7}).as_("seven"))
_docs("json_path", "CAST(props ->> '$.k' AS BIGINT) > 50 AS big, json_exists(props, '$.k') AS there", lambda eb: [eb.json.path_matches("events.props", "$.k > 50").as_("big"), eb.json.path_exists("events.props", "$.k").as_("there")])


# vectors


def _nearest(name: str, expression: str, method: str):
    zero = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"

    @query(name, f"SELECT vec_id, round({expression.format(a='CAST(embedding AS DOUBLE[])', b=f'CAST({zero} AS DOUBLE[])')}, 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 10")
    def _(db):
        probe = embeddings.as_("probe")
        q = db.select_from(embeddings).inner_join(probe).on(lambda eb: eb.ref("probe.vec_id").eq(0))
        distance = lambda eb: eb.fn.cast(eb.fn.round(eb.fn.cast(getattr(eb.ref("embeddings.embedding"), method)(eb.ref("probe.embedding")), S.decimal(30, 15).kind), 6), "double")
        return q.select("embeddings.vec_id", lambda eb: distance(eb).as_("distance")).order_by("distance").order_by("embeddings.vec_id").limit(10)


_nearest("l2_topk", "list_distance({a}, {b})", "l2_distance")
_nearest("cosine_topk", "list_cosine_distance({a}, {b})", "cosine_distance")
_nearest("inner_product_topk", "list_negative_inner_product({a}, {b})", "inner_product")


# ranges, addresses, full text, enums, intervals: over values made from columns


@query("range_tests", "SELECT o_orderkey, o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AS inside FROM orders")
def _(db):
    year = S.daterange().kind
    return db.select_from(orders).select("orders.o_orderkey", lambda eb: eb.val("[1995-01-01,1996-01-01)", year).contains(eb.fn.cast("orders.o_orderdate", "date")).as_("inside"))


@query("inet_tests", "SELECT c_custkey, c_custkey % 256 < 128 AS lower_half FROM customer")
def _(db):
    address = lambda eb: sql("concat('10.0.0.', {} % 256)", eb.ref("customer.c_custkey"), kind=S.inet().kind)
    return db.select_from(customer).select("customer.c_custkey", lambda eb: address(eb).is_subnet_of("10.0.0.0/25").as_("lower_half"))


@query("text_search", "SELECT p_partkey, list_contains(string_split(lower(p_type), ' '), split_part(lower('PROMO BRUSHED'), ' ', 1)) OR list_contains(string_split(lower(p_type), ' '), 'brass') AS found FROM part")
def _(db):
    vector = lambda eb: sql("array_join(transform(split(lower({}), ' '), (w, i) -> concat('''', w, ''':', i + 1)), ' ')", eb.ref("part.p_type"), kind=S.tsvector().kind)
    return db.select_from(part).select("part.p_partkey", lambda eb: vector(eb).matches("promo | brass").as_("found"))


status = S.define_enum("order_status", ["P", "O", "F"])
enum_orders = S.define_table("orders", o_orderkey=S.bigint().unique(), o_orderstatus=status())


@query("enum_order", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY o_orderstatus")
def _(db):
    return db.select_from(enum_orders).where(lambda eb: eb.ref("orders.o_orderstatus").gt("P")).select("orders.o_orderstatus", lambda eb: eb.fn.count().as_("n")).group_by("orders.o_orderstatus").order_by("orders.o_orderstatus")


# pages


@query("page_cursor", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 20")
def _(db):
    q = db.select_from(orders).select("orders.o_orderkey", "orders.o_custkey")
    first = q.paginate_by_cursor(20, "orders.o_orderkey")
    second = q.paginate_by_cursor(20, "orders.o_orderkey", after=first.next_cursor)
    return db.spark.createDataFrame([tuple(r.values()) for r in second.rows], "o_orderkey long, o_custkey long")


@query("page_offset_total", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 10 OFFSET 10")
def _(db):
    page = db.select_from(orders).where("orders.o_orderstatus", "F").select("orders.o_orderkey").paginate_by_offset(2, 10, "orders.o_orderkey", "desc", count_total=True)
    return db.spark.createDataFrame([(r["o_orderkey"], page.total) for r in page.rows], "o_orderkey long, total long")


@query("chunks", "SELECT CAST((row_number() OVER (ORDER BY n_nationkey) - 1) // 10 AS BIGINT) AS chunk, n_nationkey FROM nation")
def _(db):
    chunks = db.select_from(nation).select("nation.n_nationkey").iterate_chunks(10, "nation.n_nationkey")
    return db.spark.createDataFrame([(i, r["n_nationkey"]) for i, rows in enumerate(chunks) for r in rows], "chunk long, n_nationkey int")


@query("stream_rows", "SELECT r_regionkey, r_name FROM region")
def _(db):
    rows = db.select_from(region).select_all("region").stream(batch_size=2)
    return db.spark.createDataFrame([tuple(r.values()) for r in rows], "r_regionkey int, r_name string")


# writes: the table afterwards

stored = S.define_table("nation", n_nationkey=S.integer().unique(), n_name=S.text(), n_regionkey=S.integer())


def _written(name: str, sql_text: str, work):
    def run(spark, sf_dir):
        own = Database(spark, None, f"{store_folder(spark)}/{name}")
        own.create(stored)
        own.copy_rows(stored, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect()])
        work(own)
        return own.select_from(stored).select_all("nation").frame()

    QUERIES[name], SQL[name] = run, sql_text


def store_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='tarn-')).rstrip('/')}/store-{uuid.uuid4().hex}"


_written("insert_rows", "SELECT * FROM nation UNION ALL VALUES (100, 'ATLANTIS', 1), (101, 'LEMURIA', 2)", lambda db: db.insert_into(stored).values([{"n_nationkey": 100, "n_name": "ATLANTIS", "n_regionkey": 1}, {"n_nationkey": 101, "n_name": "LEMURIA", "n_regionkey": 2}]).execute())
_written("upsert_nothing", "SELECT * FROM nation UNION ALL VALUES (100, 'ATLANTIS', 1)", lambda db: db.insert_into(stored).values([{"n_nationkey": 3, "n_name": "X", "n_regionkey": 1}, {"n_nationkey": 100, "n_name": "ATLANTIS", "n_regionkey": 1}]).on_conflict("n_nationkey").do_nothing().execute())
_written("upsert_merge", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'X' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 3 THEN 1 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL VALUES (100, 'ATLANTIS', 1)", lambda db: db.insert_into(stored).values([{"n_nationkey": 3, "n_name": "X", "n_regionkey": 1}, {"n_nationkey": 100, "n_name": "ATLANTIS", "n_regionkey": 1}]).on_conflict("n_nationkey").merge().execute())
_written("upsert_update", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN n_name || '+X' ELSE n_name END AS n_name, n_regionkey FROM nation", lambda db: db.insert_into(stored).values({"n_nationkey": 3, "n_name": "X", "n_regionkey": 1}).on_conflict("n_nationkey").do_update(lambda excluded, eb: {"n_name": eb.fn.concat("nation.n_name", "+", excluded.n_name)}).execute())
_written("update_case", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation", lambda db: db.update(stored).set(lambda eb: {"n_name": eb.fn.lower("nation.n_name")}).where("nation.n_regionkey", 1).execute())
_written("set_each", "SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 'ONE' ELSE n_name END AS n_name, CASE n_nationkey WHEN 2 THEN 4 ELSE n_regionkey END AS n_regionkey FROM nation", lambda db: db.update(stored).set_each([{"n_nationkey": 1, "n_name": "ONE"}, {"n_nationkey": 2, "n_regionkey": 4}], key="n_nationkey").execute())
_written("delete_where", "SELECT * FROM nation WHERE n_regionkey <> 2", lambda db: db.delete_from(stored).where("nation.n_regionkey", 2).execute())
_written("transaction_rollback", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 0 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation", lambda db: _transfer(db))


def _transfer(db):
    def failing(tx):
        tx.delete_from(stored).all_rows().execute()
        raise RuntimeError("no")

    def work(tx):
        tx.update(stored).set({"n_regionkey": 9}).where("nation.n_nationkey", 0).execute()
        try:
            tx.transaction(failing)
        except RuntimeError:
            pass

    db.transaction(work)


from . import workload_more  # noqa: E402, F401  registers the further ones
