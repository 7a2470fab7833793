"""Further queries of the workload: writes' results, shapes, kinds of values, copies and transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import errors, fragment
from . import schema as S
from .database import Database
from .functions.raw import sql, sql_join
from .workload import QUERIES, SQL, customer, events, nation, orders, part, query, region, store_folder, stored

# whole numbers and equality


@query("bigint_div", "SELECT o_orderkey, (9007199254740993 + o_orderkey) // 3 AS third, -(9007199254740993 + o_orderkey) % 7 AS rest FROM orders")
def _(db):
    big = lambda eb: eb.val(9007199254740993, S.bigint().kind).plus(eb.ref("orders.o_orderkey"))
    return db.select_from(orders).select("orders.o_orderkey", lambda eb: [big(eb).divided_by(3).as_("third"), big(eb).times(-1).mod(7).as_("rest")])


def _interval(eb, text: str):
    return eb.fn.cast(sql(text, eb.ref("orders.o_orderkey"), kind=S.text().kind), "interval")


_LIKE_DAYS = "CASE {} % 4 WHEN 0 THEN '1 day' WHEN 1 THEN '24 hours' WHEN 2 THEN '1 month' ELSE '30 days' END"


@query("group_interval", "SELECT count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY o_orderkey % 4 < 2")
def _(db):
    found = db.select_from(orders).select(lambda eb: [_interval(eb, _LIKE_DAYS).as_("i"), eb.fn.count().as_("n"), eb.fn.max("orders.o_orderkey").as_("last")]).group_by(lambda eb: _interval(eb, _LIKE_DAYS))
    return found.frame().select("n", "last")


_LIKE_DOCUMENTS = """CASE {} % 4 WHEN 0 THEN '{{"a":11,"b":2}}' WHEN 1 THEN '{{"b":2, "a":11.0}}' WHEN 2 THEN '[1]' ELSE '[1, 1]' END"""


def _document(eb):
    return eb.fn.cast(sql(_LIKE_DOCUMENTS, eb.ref("orders.o_orderkey"), kind=S.text().kind), "jsonb")


@query("distinct_jsonb", "SELECT 3 AS n_distinct, 3 AS n_rows FROM (SELECT count(*) FROM orders)")
def _(db):
    counted = db.select_from(orders).select(lambda eb: eb.fn.count_distinct(_document(eb)).as_("n")).frame().first()["n"]
    rows = db.select_from(orders).select(lambda eb: _document(eb).as_("d")).distinct().frame().count()
    return db.spark.createDataFrame([(counted, rows)], "n_distinct int, n_rows int")


@query("nullif_interval", "SELECT o_orderkey, o_orderkey % 2 = 0 AS same FROM orders")
def _(db):
    text = "CASE {} % 2 WHEN 0 THEN '1 day' ELSE '2 days' END"
    return db.select_from(orders).select("orders.o_orderkey", lambda eb: eb.fn.nullif(_interval(eb, text), eb.val("24 hours", S.interval().kind)).is_null().as_("same"))


@query("jsonb_equality", "SELECT o_orderkey, o_orderkey % 4 < 2 AS same, o_orderkey % 4 >= 2 AS other FROM orders")
def _(db):
    document = {"a": 11, "b": 2}
    return db.select_from(orders).select("orders.o_orderkey", lambda eb: [_document(eb).eq(document).as_("same"), _document(eb).ne(document).as_("other")])


# predicates over arrays, documents, ranges, addresses and texts


@query("in_array", "SELECT o_orderkey, o_orderpriority IN ('1-URGENT', o_orderstatus) AS within, o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AS beyond FROM orders")
def _(db):
    within = lambda eb: sql("array('1-URGENT', {})", eb.ref("orders.o_orderstatus"), kind=S.array(S.text()).kind)
    return db.select_from(orders).select(
        "orders.o_orderkey",
        lambda eb: [eb.ref("orders.o_orderpriority").in_(within(eb)).as_("within"), eb.ref("orders.o_orderpriority").not_in(eb.val(["1-URGENT", "2-HIGH"])).as_("beyond")],
    )


@query("json_contained_by", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) < 3 AS held FROM events")
def _(db):
    return db.select_from(events).select("events.event_id", lambda eb: eb.or_([eb.ref("events.props").contained_by({"k": k}) for k in range(3)]).as_("held"))


@query("json_length", "SELECT o_orderkey, CAST(o_orderkey % 3 AS INTEGER) AS n FROM orders")
def _(db):
    items = lambda eb: eb.fn.cast(sql("concat('[', array_join(slice(array('1', '\"x\"'), 1, cast({} % 3 as int)), ','), ']')", eb.ref("orders.o_orderkey"), kind=S.text().kind), "jsonb")
    return db.select_from(orders).select("orders.o_orderkey", lambda eb: eb.json.length(items(eb)).as_("n"))


_RANGES = [
    ("held", "contains", "[1995-03-01,1995-04-01]", "d <= DATE '1995-03-01' AND d + 60 >= DATE '1995-04-02'"),
    ("holding", "contained_by", "[1995-01-01,1995-12-31]", "d >= DATE '1995-01-01' AND d + 60 <= DATE '1996-01-01'"),
    ("meeting", "overlaps", "[1995-06-01,1995-07-01)", "d < DATE '1995-07-01' AND d + 60 > DATE '1995-06-01'"),
    ("before", "strictly_left_of", "[1995-06-01,)", "d + 60 <= DATE '1995-06-01'"),
    ("after", "strictly_right_of", "(,1995-06-01)", "d >= DATE '1995-06-01'"),
    ("ends_within", "does_not_extend_right_of", "[1995-01-01,1996-01-01)", "d + 60 <= DATE '1996-01-01'"),
    ("starts_within", "does_not_extend_left_of", "[1995-01-01,1996-01-01)", "d >= DATE '1995-01-01'"),
    ("beside", "adjacent_to", "[1995-06-01,1995-07-01)", "d + 60 = DATE '1995-06-01' OR d = DATE '1995-07-01'"),
]


@query("range_pairs", "SELECT o_orderkey, " + ", ".join(f"({test}) AS {name}" for name, _, _, test in _RANGES) + " FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def _(db):
    span = lambda eb: sql("named_struct('empty', false, 'lower', cast({0} as date), 'upper', date_add(cast({0} as date), 60), 'bounds', '[)')".replace("{0}", "{}"), eb.ref("orders.o_orderdate"), eb.ref("orders.o_orderdate"), kind=S.daterange().kind)
    return db.select_from(orders).select("orders.o_orderkey", lambda eb: [getattr(span(eb), method)(given).as_(name) for name, method, given, _ in _RANGES])


@query(
    "inet_pairs",
    """SELECT c_custkey, c_custkey % 256 < 128 AS sub_equal, c_custkey % 256 = 7 AS same_host, c_custkey % 256 >= 4 AND c_custkey % 256 < 8 AS super_of, c_custkey % 256 >= 4 AND c_custkey % 256 < 8 AS meets
    FROM customer""",
)
def _(db):
    address = lambda eb: sql("concat('10.0.0.', {} % 256)", eb.ref("customer.c_custkey"), kind=S.inet().kind)
    return db.select_from(customer).select(
        "customer.c_custkey",
        lambda eb: [
            address(eb).is_subnet_or_equal("10.0.0.0/25").as_("sub_equal"),
            eb.val("10.0.0.7", S.inet().kind).is_supernet_or_equal(address(eb)).as_("same_host"),
            eb.val("10.0.0.4/30", S.inet().kind).is_supernet_of(address(eb)).as_("super_of"),
            address(eb).overlaps("10.0.0.4/30").as_("meets"),
        ],
    )


@query(
    "text_search_forms",
    """SELECT p_partkey, w[1] = 'promo' AND list_contains(w, 'brushed') AS both_words, NOT list_contains(w, 'promo') AS without, len(w) > 1 AND w[1] = 'promo' AND w[2] = 'brushed' OR len(w) > 2 AND w[2] = 'promo' AND w[3] = 'brushed' AS phrase,
    len([x FOR x IN w IF starts_with(x, 'bru')]) > 0 AS prefix FROM (SELECT p_partkey, string_split(lower(p_type), ' ') AS w FROM part)""",
)
def _(db):
    vector = lambda eb: sql("array_join(transform(split(lower({}), ' '), (w, i) -> concat('''', w, ''':', i + 1)), ' ')", eb.ref("part.p_type"), kind=S.tsvector().kind)
    forms = {"both_words": "promo & brushed", "without": "!promo", "phrase": "promo <-> brushed", "prefix": "bru:*"}
    return db.select_from(part).select("part.p_partkey", lambda eb: [vector(eb).matches(q).as_(name) for name, q in forms.items()])


# intervals, dates and casts


@query("interval_sum_avg", "SELECT o_orderstatus, CAST(sum(o_orderkey % 5) AS BIGINT) * 86400 + 3600 * count(*) AS total, count(*) AS n, round(CAST(sum(o_orderkey % 5) * 86400.0 / count(*) + 3600 AS DOUBLE), 4) AS mean FROM orders GROUP BY o_orderstatus")
def _(db):
    text = "concat({} % 5, ' days 1 hour')"
    q = db.select_from(orders).select("orders.o_orderstatus", lambda eb: [eb.fn.sum(_interval(eb, text)).as_("s"), eb.fn.avg(_interval(eb, text)).as_("m"), eb.fn.count().as_("n")]).group_by("orders.o_orderstatus")
    seconds = lambda c: (F.col(f"{c}.days") * F.lit(86400).cast("long") + F.col(f"{c}.micros") / F.lit(1_000_000.0))
    return q.frame().select("o_orderstatus", seconds("s").cast("long").alias("total"), "n", F.round(seconds("m"), 4).alias("mean"))


@query("interval_arith", "SELECT o_orderkey, CAST(o_orderkey % 4 + 2 AS INTEGER) AS days_more, CAST(o_orderkey % 4 - 2 AS INTEGER) AS days_less FROM orders")
def _(db):
    own = lambda eb: _interval(eb, "concat({} % 4, ' days')")
    q = db.select_from(orders).select("orders.o_orderkey", lambda eb: [own(eb).plus("2 days").as_("a"), own(eb).minus("2 days").as_("b")])
    return q.frame().select("o_orderkey", F.col("a.days").alias("days_more"), F.col("b.days").alias("days_less"))


@query("interval_from_text", "SELECT o_orderkey, CAST(12 + o_orderkey % 12 AS INTEGER) AS months, CAST(-3 AS INTEGER) AS days, CAST((o_orderkey % 24) * 3600000000 + 1500000 AS BIGINT) AS micros FROM orders")
def _(db):
    text = "concat('1 year ', {} % 12, ' mons -3 days ', lpad(cast({} % 24 as string), 2, '0'), ':00:01.5')"
    key = lambda eb: eb.ref("orders.o_orderkey")
    q = db.select_from(orders).select("orders.o_orderkey", lambda eb: eb.fn.cast(sql(text, key(eb), key(eb), kind=S.text().kind), "interval").as_("i"))
    return q.frame().select("o_orderkey", F.col("i.months").alias("months"), F.col("i.days").alias("days"), F.col("i.micros").alias("micros"))


@query(
    "cast_targets",
    """SELECT o_orderkey, CAST(o_orderkey % 30000 AS SMALLINT) AS small, CAST(o_custkey AS INTEGER) AS whole, CAST(o_custkey AS BIGINT) AS big, CAST(o_custkey AS FLOAT) AS single, CAST(o_custkey AS DOUBLE) AS double_, CAST(CAST(o_custkey AS DECIMAL(12,2)) AS VARCHAR) AS exact,
    substr(o_orderpriority, 1, 3) AS short, CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS moment, o_orderkey % 2 = 1 AS flag, '00000000-0000-0000-0000-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id FROM orders""",
)
def _(db):
    from . import kinds as K

    def targets(eb):
        key, cust = eb.ref("orders.o_orderkey"), eb.ref("orders.o_custkey")
        yes = sql("if({} % 2 = 1, 'true', 'false')", key, kind=S.text().kind)
        name = sql("concat('00000000-0000-0000-0000-', lpad(cast({} as string), 12, '0'))", key, kind=S.text().kind)
        cast = eb.fn.cast
        return [
            cast(key.mod(30000), "smallint").as_("small"), cast(cust, "integer").as_("whole"), cast(cust, "bigint").as_("big"), cast(cust, "real").as_("single"), cast(cust, "double").as_("double_"),
            cast(cast(cust, S.decimal(12, 2).kind), "text").as_("exact"), cast("orders.o_orderpriority", S.varchar(3).kind).as_("short"), cast("orders.o_orderdate", "date").as_("day"),
            cast(cast("orders.o_orderdate", "date"), K.TIMESTAMP).as_("moment"), cast(yes, "boolean").as_("flag"), cast(name, "uuid").as_("id"),
        ]

    return db.select_from(orders).select("orders.o_orderkey", targets)


@query(
    "date_units_rest",
    """SELECT o_orderkey, CAST(date_trunc('decade', o_orderdate) AS TIMESTAMP) AS decade, date_trunc('millisecond', o_orderdate) AS ms, CAST(date_part('century', o_orderdate) AS BIGINT) AS century, CAST(date_part('isoyear', o_orderdate) AS BIGINT) AS iso,
    CAST(date_part('decade', o_orderdate) AS BIGINT) AS tens, CAST(date_part('millennium', o_orderdate) AS BIGINT) AS thousands FROM orders""",
)
def _(db):
    whole = lambda eb, field: eb.fn.cast(eb.fn.extract(field, "orders.o_orderdate"), "bigint")
    return db.select_from(orders).select(
        "orders.o_orderkey",
        lambda eb: [
            eb.fn.date_trunc("decade", "orders.o_orderdate").as_("decade"), eb.fn.date_trunc("milliseconds", "orders.o_orderdate").as_("ms"), whole(eb, "century").as_("century"),
            whole(eb, "isoyear").as_("iso"), whole(eb, "decade").as_("tens"), whole(eb, "millennium").as_("thousands"),
        ],
    )


@query("now_and_today", "SELECT count(*) AS n, true AS ordered, true AS same_day FROM region")
def _(db):
    q = db.select_from(region).select(lambda eb: [eb.fn.now().gt("2020-01-01T00:00:00Z").as_("late"), eb.fn.cast(eb.fn.now(), "date").minus(eb.fn.current_date()).eq(0).as_("today")])
    return q.frame().agg(F.count("*").alias("n"), F.bool_and("late").alias("ordered"), F.bool_and("today").alias("same_day"))


# names, locks, plans and shapes


@query("sql_names", "SELECT o_orderkey, o_custkey + 1 AS next FROM orders WHERE o_orderstatus IN ('F', 'O')")
def _(db):
    return db.select_from(orders).where(lambda eb: sql("{} in ({})", eb.ref("orders.o_orderstatus"), sql_join(["F", "O"]), kind=S.boolean().kind)).select("orders.o_orderkey", lambda eb: eb.ref("orders.o_custkey").plus(1).as_("next"))


@query("empty_select", "SELECT count(*) AS n FROM region")
def _(db):
    rows = db.select_from(region).execute()
    return db.spark.createDataFrame([(sum(r == {} for r in rows),)], "n long")


@query("row_locks", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def _(db):
    return db.select_from(nation).where("nation.n_regionkey", 1).select("nation.n_nationkey", "nation.n_name").for_update()


@query("described", "SELECT unnest(['c_custkey', 'label']) AS key, unnest(['bigint', 'string']) AS kind")
def _(db):
    q = db.select_from(customer).select("customer.c_custkey", lambda eb: eb.fn.upper("customer.c_name").as_("label"))
    assert "Scan parquet" in q.explain()
    return db.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in q.describe().fields], "key string, kind string")


@query("shapes", "SELECT (SELECT min(r_name) FROM region) AS first_name, (SELECT count(*) FROM region) AS n, 'AFRICA' AS one, true AS none, 'NoRowError,TooManyRowsError' AS failures")
def _(db):
    q = db.select_from(region).select("region.r_name").order_by("region.r_name")
    failed = []
    for broken in (lambda: q.where("region.r_name", "?").expect_first().execute(), lambda: q.expect_one().execute()):
        try:
            broken()
        except (errors.NoRowError, errors.TooManyRowsError) as e:
            failed.append(type(e).__name__)
    row = (q.take_value().execute(), len(q.expect_non_empty().execute()), q.where("region.r_name", "AFRICA").expect_one().execute()["r_name"], q.where("region.r_name", "?").expect_at_most_one().execute() is None, ",".join(failed))
    return db.spark.createDataFrame([row], "first_name string, n long, one string, none boolean, failures string")


@query("codec_kind", "SELECT c_custkey, round(c_acctbal * 100) / 100 AS euros FROM customer WHERE c_custkey < 50")
def _(db):
    cents = S.Codec(encode=lambda v: v, decode=lambda v: round(v * 100) / 100)
    own = S.define_table("customer", c_custkey=S.bigint(), c_acctbal=S.double_precision().use_codec(cents))
    rows = db.select_from(own).where(lambda eb: eb.ref("customer.c_custkey").lt(50)).select("customer.c_custkey", "customer.c_acctbal").execute()
    return db.spark.createDataFrame([(r["c_custkey"], float(r["c_acctbal"])) for r in rows], "c_custkey long, euros double")


@query("fragments", "SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def _(db):
    asian = fragment(nation, lambda q: q.where("nation.n_regionkey", 2))
    return db.select_from(nation).pipe(asian).select("nation.n_nationkey")


@query("batch_of_queries", "SELECT (SELECT count(*) FROM nation) AS nations, (SELECT max(r_name) FROM region) AS last_region")
def _(db):
    count, last = db.batch([db.select_from(nation).select(lambda eb: eb.fn.count().as_("n")).take_value(), db.select_from(region).select(lambda eb: eb.fn.max("region.r_name").as_("m")).take_value()])
    return db.spark.createDataFrame([(count, last)], "nations long, last_region string")


# writes: what they return, and the rest of their forms

ledger = S.define_table("ledger", id=S.integer().identity(), code=S.text().unique(), n=S.integer().default(5), twice=S.integer().nullable().generated(lambda eb: eb.ref("ledger.n").times(2)))


def _store(spark, sf_dir, *tables):
    own = Database(spark, None, store_folder(spark))
    own.create(*tables)
    if stored in tables:
        own.copy_rows(stored, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect()])
    return own


def written(name: str, sql_text: str, schema: str, *tables):
    """Registers ``work(db) -> rows``, run on a store of its own."""

    def register(work):
        def run(spark, sf_dir):
            rows = work(_store(spark, sf_dir, *tables))
            return spark.createDataFrame([tuple(r.values()) if isinstance(r, dict) else r for r in rows], schema)

        QUERIES[name], SQL[name] = run, sql_text
        return work

    return register


_NATION = "n_nationkey int, n_name string"


@written("insert_returning", "SELECT * FROM (VALUES (1, 'a', 7, 14), (2, 'b', 5, 10)) t(id, code, n, twice)", "id int, code string, n int, twice int", ledger)
def _(db):
    return db.insert_into(ledger).values([{"code": "a", "n": 7}, {"code": "b"}]).returning_all().execute()


@written("update_returning", "SELECT n_nationkey, lower(n_name) AS n_name FROM nation WHERE n_regionkey = 3", _NATION, stored)
def _(db):
    return db.update(stored).set(lambda eb: {"n_name": eb.fn.lower("nation.n_name")}).where("nation.n_regionkey", 3).returning("nation.n_nationkey", "nation.n_name").execute()


@written("delete_returning", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 4", _NATION, stored)
def _(db):
    return db.delete_from(stored).where("nation.n_regionkey", 4).returning("nation.n_nationkey", "nation.n_name").execute()


@written("row_counts", "SELECT CAST(2 AS BIGINT) AS inserted, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS updated, (SELECT count(*) FROM nation WHERE n_regionkey = 2) AS deleted", "inserted long, updated long, deleted long", stored)
def _(db):
    made = db.insert_into(stored).values([{"n_nationkey": 100 + i, "n_name": "X", "n_regionkey": 9} for i in range(2)]).execute()
    changed = db.update(stored).set({"n_name": "Y"}).where("nation.n_regionkey", 1).execute()
    gone = db.delete_from(stored).where("nation.n_regionkey", 2).execute()
    return [(made.row_count, changed.row_count, gone.row_count)]


defaults = S.define_table("defaults", id=S.integer().identity(), n=S.integer().default(5), note=S.text().nullable())


@written("default_values", "SELECT 1 AS id, 5 AS n, CAST(NULL AS VARCHAR) AS note", "id int, n int, note string", defaults)
def _(db):
    db.insert_into(defaults).values({}).execute()
    return db.select_from(defaults).select_all("defaults").execute()


@written("upsert_partial", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'NEW' ELSE n_name END AS n_name, n_regionkey FROM nation", "n_nationkey int, n_name string, n_regionkey int", stored)
def _(db):
    conflict = db.insert_into(stored).values({"n_nationkey": 3, "n_name": "NEW", "n_regionkey": 1}).on_conflict("n_nationkey").where(lambda eb: eb.ref("nation.n_regionkey").lt(9))
    conflict.merge(["n_name"]).execute()
    return db.select_from(stored).select_all("nation").execute()


@written("copy_round_trip", "SELECT * FROM (VALUES (1, 'tab' || chr(9) || 'here'), (2, NULL), (3, 'line' || chr(10) || 'feed ' || chr(92) || ' slash')) t(k, v)", "k int, v string", S.define_table("notes", k=S.integer().unique(), v=S.text().nullable()))
def _(db):
    notes = S.define_table("notes", k=S.integer().unique(), v=S.text().nullable())
    db.copy_rows(notes, [(1, "tab\there"), (2, None), (3, "line\nfeed \\ slash")])
    out = f"{store_folder(db.spark)}-out"
    db.copy_to(db.select_from(notes).select_all("notes"), out)
    db.delete_from(notes).all_rows().execute()
    db.copy_from(notes, out)
    return db.select_from(notes).select_all("notes").execute()


@written("copy_lines", "SELECT n_nationkey || chr(9) || n_name || chr(9) || n_regionkey AS line FROM nation", "line string", stored)
def _(db):
    return [(line,) for line in db.copy_lines(db.select_from(stored).select_all("nation"))]


@written("copy_files", "SELECT CAST(3 AS BIGINT) AS n, '1' || chr(9) || 'x' AS first_line", "n long, first_line string", S.define_table("notes", k=S.integer().unique(), v=S.text().nullable()))
def _(db):
    notes = S.define_table("notes", k=S.integer().unique(), v=S.text().nullable())
    with db.copy_writer(notes) as f:
        f.write("1\tx\n2\t\\N\n3\tz")
    return [(f.row_count, db.copy_reader(db.select_from(notes).select_all("notes").order_by("notes.k")).readline().rstrip("\n"))]


@written("transaction_hooks", "SELECT unnest(['inner undone', 'committed', 'sent']) AS event, unnest([1, 2, 3]) AS place", "event string, place int", ledger)
def _(db):
    seen = []
    stop = db.listen("done", lambda payload: seen.append(payload))

    def work(tx):
        tx.after_commit(lambda: seen.append("committed"))
        tx.notify("done", "sent")
        tx.insert_into(ledger).values({"code": "a"}).execute()
        try:
            tx.transaction(lambda inner: (inner.after_rollback(lambda: seen.append("inner undone")), inner.delete_from(ledger).all_rows().execute(), 1 / 0))
        except ZeroDivisionError:
            pass

    db.transaction(work)
    stop()
    order = {"inner undone": 1, "committed": 2, "sent": 3}
    return [(e, order[e]) for e in seen]


@written("commit_and_conflict", "SELECT 'SerializationFailure' AS failure, CAST(1 AS BIGINT) AS kept, 'UniqueViolation:code' AS violated, 'ReadOnlyTransaction' AS refused", "failure string, kept long, violated string, refused string", ledger)
def _(db):
    kept = db.transaction(lambda tx: tx.execute_and_commit(tx.insert_into(ledger).values({"code": "a"}))).row_count

    def crossing(tx):
        tx.update(ledger).set({"n": 1}).all_rows().execute()
        db.update(ledger).set({"n": 2}).all_rows().execute()

    names = []
    for work in (crossing, lambda tx: tx.insert_into(ledger).values({"code": "a"}).execute()):
        try:
            db.transaction(work)
        except errors.SerializationFailure as e:
            names.append(type(e).__name__)
        except errors.UniqueViolation as e:
            names.append(f"{type(e).__name__}:{','.join(errors.violated_columns(e, ledger))}")
    try:
        db.transaction(lambda tx: tx.delete_from(ledger).all_rows().execute(), read_only=True)
    except errors.ReadOnlyTransaction as e:
        names.append(type(e).__name__)
    return [(names[0], kept, names[1], names[2])]


@query("events_and_tags", "SELECT 'all' AS tag, (SELECT count(*) FROM region) AS row_count, true AS failed")
def _(db):
    seen = []
    own = Database(db.spark, db.sources, on_query=seen.append)
    own.select_from(region).select("region.r_name").tag("all").execute()
    try:
        own.select_from(region).select(lambda eb: eb.val(1).divided_by(eb.ref("region.r_regionkey")).as_("x")).execute()
    except errors.QueryError:
        pass
    return db.spark.createDataFrame([(seen[0].tag, seen[0].row_count, seen[1].error is not None)], "tag string, row_count long, failed boolean")


@query("verified", "SELECT * FROM (VALUES ('column-extra', 'n_regionkey'), ('column-missing', 'gone'), ('column-type-mismatch', 'n_nationkey')) t(code, name)")
def _(db):
    drifted = S.define_table("nation", n_nationkey=S.text(), n_name=S.text(), gone=S.integer())
    report = db.verify([drifted])
    return db.spark.createDataFrame([(d.code, d.column) for d in report.diagnostics if d.code in ("column-extra", "column-missing", "column-type-mismatch")], "code string, name string")


@query("row_types", "SELECT unnest(['code', 'n']) AS key")
def _(db):
    assert ledger.select_type.fieldNames() == ["id", "code", "n", "twice"]
    return db.spark.createDataFrame([(k,) for k in ledger.insert_type.fieldNames()], "key string")
