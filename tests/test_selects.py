"""Selects over a small users and posts fixture; expected rows follow PostgreSQL."""

import datetime as dt
from decimal import Decimal

import pytest

import tarn
from tarn import Database, define_table, errors, sql

UTC = dt.timezone.utc
users = define_table(
    "users",
    {
        "id": tarn.integer().identity(), "name": tarn.text(), "email": tarn.text().nullable(), "age": tarn.integer(), "managerId": tarn.integer().nullable().name("manager_id"),
        "balance": tarn.decimal().default(Decimal(0)), "score": tarn.real().default(0.0), "tags": tarn.array(tarn.text()).default([]),
        "settings": tarn.jsonb().default({"theme": "light"}), "createdAt": tarn.timestamptz().name("created_at").default("2024-01-15T10:30:00Z"), "born": tarn.date().nullable(),
    },
)
posts = define_table("posts", id=tarn.integer().identity(), authorId=tarn.integer().nullable().name("author_id"), title=tarn.text(), views=tarn.bigint().default(0), published=tarn.boolean().default(False))


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    db = Database(spark, store=str(tmp_path_factory.mktemp("store")))
    db.create(users, posts)
    db.insert_into(users).values(
        [
            {"name": "Ada", "email": "ada@x.io", "age": 36, "balance": Decimal("10.5"), "score": 1.5, "tags": ["admin", "beta"], "settings": {"theme": "dark", "beta": True}, "born": "1990-12-10"},
            {"name": "Alan", "age": 41, "managerId": 1, "balance": Decimal(2), "score": 2.5, "tags": ["beta"]},
            {"name": "Grace", "email": "grace@x.io", "age": 25, "managerId": 1},
        ]
    ).execute()
    db.insert_into(posts).values(
        [
            {"authorId": 1, "title": "Engines", "views": 10, "published": True},
            {"authorId": 1, "title": "Notes", "views": 5},
            {"authorId": 2, "title": "Machines", "views": 7, "published": True},
            {"title": "Orphan", "views": 1, "published": True},
        ]
    ).execute()
    return db


def names(query):
    return sorted(r["name"] for r in query.select("users.name").execute())


def value(db, build):
    return db.select_from(users).where("users.id", 1).select(lambda eb: build(eb).as_("v")).expect_value().execute()


def test_joins(db):
    joined = lambda how: getattr(db.select_from(users), how)(posts)
    assert len(joined("inner_join").on("posts.authorId", "users.id").select("users.name").execute()) == 3
    assert len(joined("left_join").on("posts.authorId", "users.id").select("users.name", "posts.title").execute()) == 4
    assert len(joined("right_join").on("posts.authorId", "users.id").select("posts.title").execute()) == 4
    assert len(joined("full_join").on("posts.authorId", "users.id").select("users.name", "posts.title").execute()) == 5
    assert joined("cross_join").select(lambda eb: eb.fn.count().as_("n")).expect_value().execute() == 12
    pairs = db.select_from(users).inner_join(users.as_("boss")).on("boss.id", "users.managerId").select("users.name", lambda eb: eb.ref("boss.name").as_("boss")).order_by("users.name").execute()
    assert pairs == [{"name": "Alan", "boss": "Ada"}, {"name": "Grace", "boss": "Ada"}]


def test_nest(db):
    rows = db.select_from(users).left_join(posts).on(lambda eb: eb.and_([eb.ref("posts.authorId").eq(eb.ref("users.id")), eb.ref("posts.views").gt(5)])).select("users.id", lambda eb: eb.nest("posts", ["authorId", "title"])).order_by("users.id").execute()
    assert rows == [{"id": 1, "posts": {"authorId": 1, "title": "Engines"}}, {"id": 2, "posts": {"authorId": 2, "title": "Machines"}}, {"id": 3, "posts": None}]
    empty = db.select_from(posts).left_join(users).on(lambda eb: eb.ref("users.id").eq(2)).select("posts.id", lambda eb: eb.nest("users", ["email"]).as_("u")).limit(1).execute()
    assert empty[0]["u"] == {"email": None}


def test_predicates(db):
    where = lambda build: names(db.select_from(users).where(build))
    assert names(db.select_from(users).where("users.name", "Ada")) == ["Ada"]
    assert where(lambda eb: eb.ref("users.email").is_null()) == ["Alan"]
    assert where(lambda eb: eb.ref("users.managerId").is_distinct_from(1)) == ["Ada"]
    assert where(lambda eb: eb.ref("users.age").in_([36, 25])) == ["Ada", "Grace"]
    assert where(lambda eb: eb.ref("users.age").not_in([])) == ["Ada", "Alan", "Grace"]
    assert where(lambda eb: eb.ref("users.name").like("A%")) == ["Ada", "Alan"]
    assert where(lambda eb: eb.ref("users.name").regex("^[[:upper:]]l")) == ["Alan"]
    assert where(lambda eb: eb.ref("users.tags").contains(["beta"])) == ["Ada", "Alan"]
    assert where(lambda eb: eb.ref("users.tags").contained_by(["beta", "x"])) == ["Alan", "Grace"]
    assert where(lambda eb: eb.ref("users.tags").overlaps(["admin", "x"])) == ["Ada"]
    assert where(lambda eb: eb.val("admin").eq(eb.fn.any("users.tags"))) == ["Ada"]
    assert where(lambda eb: eb.ref("users.settings").contains({"theme": "dark"})) == ["Ada"]
    assert where(lambda eb: eb.json.text("users.settings", "theme").eq("light")) == ["Alan", "Grace"]
    assert where(lambda eb: eb.or_([])) == [] and where(lambda eb: eb.and_([])) == ["Ada", "Alan", "Grace"]


def test_aggregates(db):
    row = db.select_from(users).select(
        lambda eb: [
            eb.fn.sum("users.age").as_("ages"), eb.fn.avg("users.age").as_("mean"), eb.fn.sum("users.balance").as_("balance"), eb.fn.count_distinct("users.managerId").as_("bosses"),
            eb.fn.bool_or(eb.ref("users.age").gt(40)).as_("some"), eb.fn.bool_and(eb.ref("users.age").gt(40)).as_("every"), eb.fn.array_agg("users.email").as_("emails"), eb.fn.string_agg("users.email", ",").as_("joined"),
        ]
    ).expect_one().execute()
    assert (row["ages"], row["mean"], row["balance"], row["bosses"], row["some"], row["every"]) == (102, Decimal(34), Decimal("12.5"), 1, True, False)
    assert sorted(row["emails"], key=str) == [None, "ada@x.io", "grace@x.io"] and sorted(row["joined"].split(",")) == ["ada@x.io", "grace@x.io"]
    none = db.select_from(users).where("users.id", 99).select(lambda eb: [eb.fn.array_agg("users.id").as_("a"), eb.fn.jsonb_agg("users.id").as_("j"), eb.fn.sum("users.age").as_("s"), eb.fn.count().as_("n"), eb.fn.avg("users.age").as_("m")]).expect_one().execute()
    assert none == {"a": None, "j": None, "s": None, "n": 0, "m": None}
    grouped = db.select_from(users).left_join(posts).on("posts.authorId", "users.id").select("users.id", "users.name", lambda eb: eb.fn.count("posts.id").as_("n")).group_by("users.id").having(lambda eb: eb.fn.count("posts.id").gte(1)).order_by("n", "desc").execute()
    assert grouped == [{"id": 1, "name": "Ada", "n": 2}, {"id": 2, "name": "Alan", "n": 1}]
    with pytest.raises(errors.KindError):
        db.select_from(users).select("users.name", "users.age").group_by("users.age").execute()


def test_order_and_distinct(db):
    by_email = lambda *a, **k: [r["name"] for r in db.select_from(users).select("users.name").order_by("users.email", *a, **k).execute()]
    assert by_email() == ["Ada", "Grace", "Alan"] and by_email("desc") == ["Alan", "Grace", "Ada"]
    assert by_email(nulls="first") == ["Alan", "Ada", "Grace"] and by_email("desc", nulls="last") == ["Grace", "Ada", "Alan"]
    first = db.select_from(posts).select("posts.authorId", "posts.title").distinct_on(["posts.authorId"]).order_by("posts.authorId").order_by("posts.views").execute()
    assert first == [{"authorId": 1, "title": "Notes"}, {"authorId": 2, "title": "Machines"}, {"authorId": None, "title": "Orphan"}]
    assert len(db.select_from(posts).select("posts.published").distinct().execute()) == 2
    assert db.select_from(users).select("users.id").order_by("users.id").limit(1).offset(1).execute() == [{"id": 2}]


@pytest.mark.parametrize(
    "build,expected",
    [
        (lambda eb: eb.fn.substring(eb.val("hello"), 0, 2), "h"),
        (lambda eb: eb.fn.substring(eb.val("hello"), -2, 3), ""),
        (lambda eb: eb.fn.substring(eb.val("hello"), 2), "ello"),
        (lambda eb: eb.fn.left(eb.val("hello"), -2), "hel"),
        (lambda eb: eb.fn.right(eb.val("hello"), -9), ""),
        (lambda eb: eb.fn.right(eb.val("hello"), 2), "lo"),
        (lambda eb: eb.fn.split_part(eb.val("a,b,c"), ",", -1), "c"),
        (lambda eb: eb.fn.strpos(eb.val("hello"), "z"), 0),
        (lambda eb: eb.fn.concat("a", eb.fn.nullif(eb.val("x"), "x"), True, 1.0, 2.5), "at12.5"),
        (lambda eb: eb.fn.round(eb.val(2.5)), 2.0),
        (lambda eb: eb.fn.round(eb.val(Decimal("2.5"))), Decimal(3)),
        (lambda eb: eb.fn.cast(eb.val(2.5), "integer"), 2),
        (lambda eb: eb.fn.cast(eb.val(Decimal("2.5")), "integer"), 3),
        (lambda eb: eb.val(-7).divided_by(2), -3),
        (lambda eb: eb.val(-7).mod(3), -1),
        (lambda eb: eb.val(7).divided_by(Decimal("2")), Decimal("3.5")),
        (lambda eb: eb.fn.ceil(eb.val(1.2)), 2.0),
        (lambda eb: eb.fn.greatest(eb.val(1), 5, 3), 5),
        (lambda eb: eb.fn.coalesce(eb.fn.nullif(eb.val(1), 1), 9), 9),
        (lambda eb: eb.case().when(eb.val(1).gt(2), "a").else_("b").end(), "b"),
        (lambda eb: eb.fn.extract("dow", eb.val(dt.date(2024, 1, 14))), Decimal(0)),
        (lambda eb: eb.fn.extract("isodow", eb.val(dt.date(2024, 1, 14))), Decimal(7)),
        (lambda eb: eb.fn.extract("century", eb.val(dt.date(2000, 1, 1))), Decimal(20)),
        (lambda eb: eb.fn.extract("isoyear", eb.val(dt.date(2021, 1, 1))), Decimal(2020)),
        (lambda eb: eb.fn.extract("julian", eb.val(dt.date(2000, 1, 1))), Decimal(2451545)),
        (lambda eb: eb.fn.extract("epoch", eb.val("1 day 2 hours", tarn.interval().kind)), Decimal(93600)),
        (lambda eb: eb.fn.date_trunc("decade", eb.val(dt.datetime(2024, 5, 6, 7))), dt.datetime(2020, 1, 1)),
        (lambda eb: eb.fn.date_trunc("century", eb.val(dt.datetime(2024, 5, 6))), dt.datetime(2001, 1, 1)),
        (lambda eb: eb.val(dt.datetime(2024, 1, 31)).plus("1 month"), dt.datetime(2024, 2, 29)),
        (lambda eb: eb.val(dt.datetime(2024, 1, 1, 1, 30)).minus("15 hours"), dt.datetime(2023, 12, 31, 10, 30)),
        (lambda eb: eb.val(dt.date(2024, 3, 1)).minus(eb.val(dt.date(2024, 2, 1))), 29),
        (lambda eb: eb.val(dt.datetime(2024, 1, 2, 1)).minus(eb.val(dt.datetime(2024, 1, 1))), {"months": 0, "days": 1, "micros": 3_600_000_000}),
        (lambda eb: eb.fn.to_char(eb.val(dt.datetime(2024, 1, 5, 14, 3)), 'YYYY-MM-DD "at" HH24:MI'), "2024-01-05 at 14:03"),
        (lambda eb: eb.fn.to_char(eb.val(Decimal("1234.5")), "FM9,999.00"), "1,234.50"),
        (lambda eb: eb.fn.to_char(eb.val(7), "000"), " 007"),
        (lambda eb: eb.fn.cardinality(eb.val([1, 2])), 2),
        (lambda eb: eb.json.get("users.settings", "beta"), "true"),
        (lambda eb: eb.json.type_of("users.settings"), "object"),
        (lambda eb: eb.json.has_all_keys("users.settings", ["beta", "theme"]), True),
        (lambda eb: eb.json.text(eb.val({"a": [1, {"b": "x"}]}), "a", -1, "b"), "x"),
        (lambda eb: eb.json.length(eb.val([1], tarn.jsonb().kind)), 1),
        (lambda eb: eb.json.path_exists(eb.val({"a": [1, 5]}), "$.a[*] ? (@ > 4)"), True),
        (lambda eb: eb.json.path_matches(eb.val({"a": "x"}), '$.a == "y"'), False),
        (lambda eb: eb.val({"a": 1, "b": [1, 2]}).contains({"b": [2]}), True),
        (lambda eb: eb.val({"a": 1}).eq({"a": 1}), True),
        (lambda eb: eb.fn.jsonb_build_object({"n": "users.name", "none": eb.fn.nullif(eb.val(1), 1), "t": True}), '{"n":"Ada","none":null,"t":true}'),
        (lambda eb: eb.val([0.0, 0.0], tarn.vector().kind).l2_distance([3.0, 4.0]), 5.0),
        (lambda eb: eb.val([1.0, 2.0], tarn.vector().kind).inner_product([3.0, 4.0]), -11.0),
        (lambda eb: sql("{} + length({})", eb.ref("users.age"), eb.fn.lower("users.name"), kind=tarn.integer().kind), 39),
        (lambda eb: eb.val("10.1.2.3", tarn.inet().kind).is_subnet_of("10.0.0.0/8"), True),
        (lambda eb: eb.val("2001:db8::1", tarn.inet().kind).is_subnet_or_equal("2001:db8::/32"), True),
        (lambda eb: eb.val("10.0.0.9", tarn.inet().kind).lt("10.0.0.10"), True),
        (lambda eb: eb.val("'cat':1 'dog':2", tarn.tsvector().kind).matches("cat <-> dog & !bird"), True),
        (lambda eb: eb.val("'cat':1 'dog':3", tarn.tsvector().kind).matches("cat <-> dog | hor:*"), False),
        (lambda eb: eb.val("1 month", tarn.interval().kind).eq("30 days"), True),
    ],
)
def test_values(db, build, expected):
    got = value(db, build)
    assert got == expected and type(got) is type(expected)


@pytest.mark.parametrize(
    "a,method,b,expected",
    [
        ("[2024-01-01,2024-02-01)", "contains", "[2024-01-05,2024-01-31]", True),
        ("[2024-01-01,2024-02-01)", "contains", "[2024-01-05,2024-02-01]", False),
        ("[2024-01-01,2024-02-01)", "contains", dt.date(2024, 1, 31), True),
        ("[2024-01-01,2024-02-01)", "overlaps", "[2024-01-31,)", True),
        ("[2024-01-01,2024-02-01)", "overlaps", "[2024-02-01,)", False),
        ("[2024-01-01,2024-02-01)", "adjacent_to", "[2024-02-01,)", True),
        ("[2024-01-01,2024-02-01)", "strictly_left_of", "[2024-02-01,)", True),
        ("[2024-03-01,)", "strictly_right_of", "(,2024-02-01]", True),
        ("(,2024-02-01)", "does_not_extend_right_of", "(,2024-02-01]", True),
        ("(,2024-02-01)", "does_not_extend_left_of", "[2024-01-01,2024-02-01]", False),
        ("empty", "contained_by", "[2024-01-01,2024-01-02)", True),
        ("[2024-01-01,2024-01-31]", "eq", "[2024-01-01,2024-02-01)", True),
    ],
)
def test_ranges(db, a, method, b, expected):
    assert value(db, lambda eb: getattr(eb.val(a, tarn.daterange().kind), method)(b)) is expected


def test_enum_order(spark):
    mood = tarn.define_enum("mood", ["sad", "ok", "glad"])
    t = define_table("t", id=tarn.integer(), m=mood())
    db = Database(spark, {"t": spark.createDataFrame([(1, "glad"), (2, "sad"), (3, "ok")], "id int, m string")})
    assert [r["m"] for r in db.select_from(t).select("t.m").order_by("t.m").execute()] == ["sad", "ok", "glad"]
    assert db.select_from(t).select(lambda eb: [eb.fn.max("t.m").as_("most"), eb.fn.min("t.m").as_("least")]).expect_one().execute() == {"most": "glad", "least": "sad"}
    assert len(db.select_from(t).where(lambda eb: eb.ref("t.m").gt("sad")).select("t.id").execute()) == 2
    with pytest.raises(errors.KindError):
        db.select_from(t).where("t.m", "angry").select("t.id").execute()


def test_refusals(db):
    q = db.select_from(users)
    for broken, error in [
        (lambda: q.where(lambda eb: eb.ref("users.name").eq(1)).select("users.id").execute(), errors.KindError),
        (lambda: q.where(lambda eb: eb.ref("users.name").eq(None)), errors.UndefinedParameterError),
        (lambda: q.where(lambda eb: eb.ref("users.name").eq(tarn.UNSET)), errors.UndefinedParameterError),
        (lambda: q.select("posts.id"), errors.ScopeError),
        (lambda: q.select("users.id", "users.id"), errors.ScopeError),
        (lambda: q.inner_join(users), errors.ScopeError),
        (lambda: q.where(lambda eb: eb.ref("users.tags").gt(["a"])), errors.KindError),
        (lambda: q.where(lambda eb: eb.ref("users.age").like("1")), errors.KindError),
        (lambda: q.where(lambda eb: eb.ref("users.name").eq(eb.ref("users.age"))), errors.KindError),
        (lambda: q.limit(-1), ValueError),
        (lambda: list(q), TypeError),
        (lambda: bool(q), TypeError),
        (lambda: q.select("users.id", "users.name").take_value(), ValueError),
        (lambda: q.skip_locked(), errors.KindError),
        (lambda: q.select(lambda eb: eb.fn.count().as_("n")).for_update().execute(), errors.KindError),
        (lambda: q.select(lambda eb: eb.fn.date_trunc("eon", "users.createdAt").as_("x")), errors.KindError),
        (lambda: q.select(lambda eb: eb.fn.to_char("users.createdAt", "YYYY WW").as_("x")).execute(), errors.UnsupportedError),
    ]:
        with pytest.raises(error):
            broken()


def test_shapes(db):
    q = db.select_from(users).select("users.name").order_by("users.id")
    assert q.take_first().execute() == {"name": "Ada"} and q.take_value().execute() == "Ada"
    assert q.where("users.id", 9).take_first().execute() is None
    assert q.where("users.id", 2).expect_one().execute() == {"name": "Alan"}
    assert q.where("users.id", 9).expect_at_most_one().execute() is None
    assert len(q.expect_non_empty().execute()) == 3
    with pytest.raises(errors.NoRowError):
        q.where("users.id", 9).expect_first().execute()
    with pytest.raises(errors.TooManyRowsError) as many:
        q.expect_one().execute()
    assert many.value.count == 3
    with pytest.raises(LookupError):
        q.where("users.id", 9).expect_value(lambda e: LookupError("no user")).execute()
    assert db.select_from(users).execute() == [{}, {}, {}]


def test_pages(db):
    q = db.select_from(posts).select("posts.id", "posts.title")
    one = q.paginate_by_cursor(3, "posts.id")
    two = q.paginate_by_cursor(3, "posts.id", after=one.next_cursor)
    assert [r["id"] for r in one.rows + two.rows] == [1, 2, 3, 4] and one.has_more and not two.has_more and two.next_cursor is None
    down = q.paginate_by_cursor(3, "posts.id", "desc")
    assert [r["id"] for r in q.paginate_by_cursor(3, "posts.id", "desc", after=down.next_cursor).rows] == [1]
    for bad in ("???", one.next_cursor[:-3], down.next_cursor):
        with pytest.raises(errors.InvalidCursorError):
            q.paginate_by_cursor(3, "posts.id", after=bad)
    page = q.paginate_by_offset(2, 3, "posts.id", count_total=True)
    assert (len(page.rows), page.has_more, page.total) == (1, False, 4)
    assert [len(c) for c in q.iterate_chunks(2, "posts.id")] == [2, 2]
    by_time = db.select_from(users).select("users.createdAt", "users.id")
    assert [r["id"] for c in by_time.iterate_chunks(1, ["users.createdAt", "users.id"]) for r in c] == [1, 2, 3]
    with pytest.raises(errors.ScopeError):
        q.paginate_by_cursor(3, "posts.authorId")
    with pytest.raises(errors.ScopeError):
        q.order_by("posts.id").paginate_by_cursor(3, "posts.id")


def test_pieces_and_streams(db):
    published = tarn.fragment(posts, lambda q: q.where("posts.published", True))
    q = db.select_from(posts).pipe(published).select("posts.id").when(False, lambda q: q.limit(1))
    assert len(q.execute()) == 3
    with pytest.raises(errors.ScopeError):
        db.select_from(users).pipe(published)
    assert sum(len(b) for b in q.stream(batch_size=2).batches()) == 3
    assert len(next(q.stream(batch_size=2).batches())) == 2
    assert q.describe().fieldNames() == ["id"] and "Scan parquet" in q.explain()


def test_raw_statement_and_events(db, spark):
    seen = []
    own = Database(spark, {"t": spark.range(5)}, on_query=seen.append)
    t = define_table("t", id=tarn.bigint())
    own.select_from(t).select("t.id").tag("all").execute()
    assert seen[0].tag == "all" and seen[0].row_count == 5 and seen[0].error is None
    assert own.sql("select :n + 1 as v", n=1).expect_value().execute() == 2
    with pytest.raises(errors.UndefinedTable):
        own.sql("select * from nowhere").execute()
    with pytest.raises(errors.QueryError):
        own.select_from(t).select(lambda eb: eb.val(1).divided_by(eb.ref("t.id")).as_("x")).execute()
    assert isinstance(seen[-1].error, errors.QueryError)


def test_timeout(spark):
    own = Database(spark, {"t": spark.range(0, 10**12, 1, 4)})
    t = define_table("t", id=tarn.bigint())
    slow = own.select_from(t).select(lambda eb: eb.fn.sum(eb.fn.cast(eb.ref("t.id"), "double")).as_("s"))
    with pytest.raises(errors.QueryCanceled):
        slow.execute(timeout="700ms")


def test_codecs(spark):
    cents = tarn.Codec(encode=lambda v: int(v * 100), decode=lambda v: v / 100)
    t = define_table("t", price=tarn.integer().use_codec(cents))
    db = Database(spark, {"t": spark.createDataFrame([(250,)], "price int")})
    assert db.select_from(t).select("t.price").expect_value().execute() == 2.5


DOCS = ['{"a":1,"b":[1,2,{"c":"x"}],"d":null}', '{"a":1.0,"b":[]}', '{"a":"1","d":{"e":true}}', "[1,2,3]", '["x",[1],{"a":1}]', "1", '"x"', "null", "true", '{"a":[{"b":1},{"b":2.5}]}', '{"a":{"b":[3,4]}}', "[]", "{}", None]


@pytest.mark.parametrize("part", [{"a": 1}, {"a": 1.0}, {}, [], [1], [3, 1], {"b": [2]}, {"b": [{"c": "x"}]}, {"d": None}, {"d": {"e": True}}, 1, "x", True, [[1]], {"a": [{"b": 2.5}]}, {"a": {"b": [4]}}, ["x", {"a": 1}]])
def test_containment_of_constants_equals_the_plain_rule(spark, part):
    import json

    from tarn.functions import jsonb as J

    t = define_table("docs", id=tarn.integer(), doc=tarn.jsonb().nullable())
    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, doc string")
    got = Database(spark, {"docs": df}).select_from(t).select("docs.id", lambda eb: eb.ref("docs.doc").contains(part).as_("has"))
    plan = got.frame()._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan
    for r in got.execute():
        text = DOCS[r["id"]]
        doc = json.loads(text) if text is not None else None
        want = None if text is None else J.contains_document(doc, part) or (isinstance(doc, list) and not isinstance(part, (dict, list)) and any(J._equal(e, part) for e in doc))
        assert r["has"] == want, (text, part)


@pytest.mark.parametrize("path", ["$.a", "$.b[2].c", "$[0]", "$[*].a", "$.a.b", "$.a[*] ? (@.b > 2)", "$.b ? (@ == 2)", "$.d", "$.a ? (@ >= 1)", '$.a ? (@ == "1")', "$.d.e ? (@ == true)", "$.a ? (@ != 1)"])
def test_paths_equal_the_plain_walk(spark, path):
    import json

    from tarn.functions import jsonb as J

    t = define_table("docs", id=tarn.integer(), doc=tarn.jsonb().nullable())
    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, doc string")
    got = Database(spark, {"docs": df}).select_from(t).select("docs.id", lambda eb: eb.json.path_exists("docs.doc", path).as_("has"))
    assert "ArrowEvalPython" not in got.frame()._jdf.queryExecution().toString()
    steps, member, operator, value, is_filter = J.parse_path(path)
    for r in got.execute():
        if DOCS[r["id"]] is None:
            assert r["has"] is None
            continue
        docs = J._walk([json.loads(DOCS[r["id"]])], steps)
        if is_filter:
            docs = [e for d in docs for e in (d if isinstance(d, list) else [d])]
            docs = [d for d in docs if any(J._meets(v, operator, value) for v in J._walk([d], member))]
        assert r["has"] == bool(docs), (DOCS[r["id"]], path)
