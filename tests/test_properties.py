"""Rules of PostgreSQL in plain Python against the lowered expressions, on random values in one job each."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

import tarn
from tarn import Database, define_table
from tarn.functions.fts import parse
from tarn.operators.pagination import decode_cursor, encode_cursor
from tarn.plans.literals import interval_parts

RNG = random.Random(11)


def run(spark, schema, rows, columns, build):
    t = define_table("t", columns)
    db = Database(spark, {"t": spark.createDataFrame(rows, schema)})
    q = db.select_from(t).select("t.i", lambda eb: build(eb).as_("v"))
    return {r["i"]: r["v"] for r in q.execute()}


def test_substring_left_right(spark):
    rows = [(i, "".join(RNG.choice("abé😀") for _ in range(RNG.randrange(7))), RNG.randrange(-8, 9), RNG.randrange(0, 9)) for i in range(400)]
    columns = {"i": tarn.integer(), "s": tarn.text(), "a": tarn.integer(), "b": tarn.integer()}
    schema = "i int, s string, a int, b int"
    got = run(spark, schema, rows, columns, lambda eb: eb.fn.substring("t.s", eb.ref("t.a"), eb.ref("t.b")))
    assert got == {i: "".join(c for p, c in enumerate(s, 1) if a <= p < a + b) for i, s, a, b in rows}
    got = run(spark, schema, rows, columns, lambda eb: eb.fn.left("t.s", eb.ref("t.a")))
    assert got == {i: s[:a] if a >= 0 else s[: max(len(s) + a, 0)] for i, s, a, _ in rows}
    got = run(spark, schema, rows, columns, lambda eb: eb.fn.right("t.s", eb.ref("t.a")))
    assert got == {i: (s[-a:] if a > 0 else "" if a == 0 else s[-a:]) if a >= 0 else s[-a:] for i, s, a, _ in rows}


def test_array_tests_with_nulls(spark):
    arrays = lambda: [RNG.choice([None, 1, 2, 3]) for _ in range(RNG.randrange(4))]
    rows = [(i, arrays(), arrays()) for i in range(300)] + [(900, None, [1]), (901, [1], None)]
    columns = {"i": tarn.integer(), "a": tarn.array(tarn.integer()).nullable(), "b": tarn.array(tarn.integer()).nullable()}
    schema = "i int, a array<int>, b array<int>"

    def both(fn):
        return {i: None if a is None or b is None else fn(a, b) for i, a, b in rows}

    holds = lambda a, b: all(y is not None and y in a for y in b)
    assert run(spark, schema, rows, columns, lambda eb: eb.ref("t.a").contains(eb.ref("t.b"))) == both(holds)
    assert run(spark, schema, rows, columns, lambda eb: eb.ref("t.a").contained_by(eb.ref("t.b"))) == both(lambda a, b: holds(b, a))
    assert run(spark, schema, rows, columns, lambda eb: eb.ref("t.a").overlaps(eb.ref("t.b"))) == both(lambda a, b: bool({x for x in a if x is not None} & set(b)))


def test_date_ranges(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(n) for n in range(6)]

    def text(r):
        lo, hi, bounds = r
        return f"{bounds[0]}{lo or ''},{hi or ''}{bounds[1]}"

    def members(r):
        lo, hi, bounds = r
        return {d for d in days if (lo is None or d > lo or d == lo and bounds[0] == "[") and (hi is None or d < hi or d == hi and bounds[1] == "]")}

    for _ in range(12):
        made = []
        for _ in range(2):
            lo, hi = sorted(RNG.sample(days, 2))
            made.append((RNG.choice([lo, None]), RNG.choice([hi, None]), RNG.choice("[(") + RNG.choice("])")))
        a, b = made
        kind = tarn.daterange().kind
        got = run(spark, "i int", [(1,)], {"i": tarn.integer()}, lambda eb, a=a, b=b: eb.val(text(a), kind).overlaps(text(b)))[1]
        assert got == bool(members(a) & members(b)) or not (a[0] and a[1] and b[0] and b[1])


def test_whole_division_and_mod(spark):
    rows = [(i, RNG.randrange(-50, 50), RNG.choice([-7, -2, -1, 1, 3, 8])) for i in range(200)]
    columns = {"i": tarn.integer(), "a": tarn.integer(), "b": tarn.integer()}
    trunc = lambda a, b: abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
    assert run(spark, "i int, a int, b int", rows, columns, lambda eb: eb.ref("t.a").divided_by(eb.ref("t.b"))) == {i: trunc(a, b) for i, a, b in rows}
    assert run(spark, "i int, a int, b int", rows, columns, lambda eb: eb.ref("t.a").mod(eb.ref("t.b"))) == {i: a - b * trunc(a, b) for i, a, b in rows}


@given(st.lists(st.text(min_size=1, max_size=8), min_size=1, max_size=3), st.sampled_from(["asc", "desc"]))
@settings(max_examples=60, deadline=None)
def test_cursors_round_trip(after, direction):
    by = [f"t.c{i}" for i in range(len(after))]
    assert decode_cursor(encode_cursor(by, direction, after), by, direction) == after


@given(st.integers(-40, 40), st.integers(-40, 40), st.integers(0, 23), st.integers(0, 59))
@settings(max_examples=60, deadline=None)
def test_interval_texts(months, days, hours, minutes):
    assert interval_parts(f"{months} months {days} days {hours:02}:{minutes:02}:00") == (months, days, (hours * 60 + minutes) * 60_000_000)


def test_tsquery_trees():
    word = lambda w, prefix=False: ("word", w, prefix)
    assert parse("a & b | !c") == ("or", ("and", word("a"), word("b")), ("not", word("c")))
    assert parse("a <2> b") == ("phrase", word("a"), word("b"), 2)
    assert parse("'it''s':* & (x | y)") == ("and", word("it's", True), ("or", word("x"), word("y")))


def test_texts_of_floats(spark):
    shown = {0.0: "0", 1.0: "1", 2.5: "2.5", 1e-4: "0.0001", 1.5e-5: "1.5e-05", 12345678.25: "12345678.25", 1e14: "100000000000000", 1e15: "1e+15", -1.25e20: "-1.25e+20", 1e-300: "1e-300", float("inf"): "Infinity"}
    rows = list(enumerate(shown))
    got = run(spark, "i int, x double", rows, {"i": tarn.integer(), "x": tarn.double_precision()}, lambda eb: eb.fn.cast("t.x", "text"))
    assert got == {i: shown[x] for i, x in rows}
    reals = [(0, 999999.0, "999999"), (1, 1234567.0, "1.234567e+06"), (2, 1e6, "1e+06"), (3, 1.5, "1.5"), (4, 0.5e-3, "0.0005")]
    got = run(spark, "i int, x float", [r[:2] for r in reals], {"i": tarn.integer(), "x": tarn.real()}, lambda eb: eb.fn.cast("t.x", "text"))
    assert got == {i: t for i, _, t in reals}
