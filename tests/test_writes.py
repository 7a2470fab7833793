"""Inserts, upserts, updates, deletes, transactions, import and export, verification."""

import pytest

import tarn
from tarn import Database, define_table, errors
from tarn.sources.store import View

items = define_table("items", id=tarn.integer().identity(), key=tarn.text().unique(), n=tarn.integer().nullable(), twice=tarn.integer().nullable().generated(lambda eb: eb.ref("items.n").times(2)))
plain = define_table("plain", k=tarn.integer().unique(), v=tarn.text().nullable())


@pytest.fixture
def db(spark, tmp_path):
    db = Database(spark, store=str(tmp_path / "store"))
    db.create(items, plain)
    db.insert_into(items).values([{"key": "a", "n": 1}, {"key": "b", "n": 2}, {"key": "c"}]).execute()
    return db


def rows(db):
    return [tuple(r.values()) for r in db.select_from(items).select("items.id", "items.key", "items.n", "items.twice").order_by("items.id").execute()]


def test_insert(db):
    assert rows(db) == [(1, "a", 1, 2), (2, "b", 2, 4), (3, "c", None, None)]
    made = db.insert_into(items).values({"key": "d", "n": 7}).returning("items.id", "items.twice").expect_one().execute()
    assert made == {"id": 4, "twice": 14}
    assert db.insert_into(items).values({"key": "e"}).execute().row_count == 1
    with pytest.raises(errors.UniqueViolation) as taken:
        db.insert_into(items).values({"key": "a"}).execute()
    assert errors.violated_columns(taken.value, items) == ("key",) and errors.violated_columns(taken.value, plain) is None
    with pytest.raises(errors.NotNullViolation):
        db.insert_into(items).values({"n": 1}).execute()
    with pytest.raises(errors.KindError):
        db.insert_into(items).values({"id": 9, "key": "x"})
    assert len(rows(db)) == 5


def test_upserts(db):
    assert db.insert_into(items).values([{"key": "a", "n": 9}, {"key": "z", "n": 9}]).on_conflict("key").do_nothing().execute().row_count == 1
    assert db.insert_into(items).values({"key": "a", "n": 5}).on_conflict("key").merge().returning("items.key", "items.n", "items.twice").execute() == [{"key": "a", "n": 5, "twice": 10}]
    db.insert_into(items).values({"key": "b", "n": 10}).on_conflict("key").do_update(lambda excluded, eb: {"n": eb.ref("items.n").plus(excluded.n)}).execute()
    assert {r[1]: r[2] for r in rows(db)} == {"a": 5, "b": 12, "c": None, "z": 9}
    kept = db.insert_into(items).values({"key": "b", "n": 99}).on_conflict("key").merge(where=lambda eb: eb.ref("items.n").lt(10)).execute()
    assert kept.row_count == 0
    with pytest.raises(errors.QueryError):
        db.insert_into(items).values([{"key": "q", "n": 1}, {"key": "q", "n": 2}]).on_conflict("key").merge().execute()


def test_partial_conflict(db):
    made = db.insert_into(plain).values([{"k": 1, "v": "live"}]).execute()
    assert made.row_count == 1
    again = db.insert_into(plain).values({"k": 1, "v": "new"}).on_conflict("k").where(lambda eb: eb.ref("plain.v").eq("gone")).do_nothing().execute()
    assert again.row_count == 1


def test_update_and_delete(db):
    assert db.update(items).set(lambda eb: {"n": eb.ref("items.n").plus(1)}).where("items.key", "a").expect_rows(1).execute().row_count == 1
    assert db.update(items).set({"n": None}).set({"n": 4}).where(lambda eb: eb.ref("items.n").is_null()).returning("items.key").execute() == [{"key": "c"}]
    assert rows(db) == [(1, "a", 2, 4), (2, "b", 2, 4), (3, "c", 4, 8)]
    with pytest.raises(errors.RowCountError):
        db.update(items).set({"n": 0}).all_rows().expect_rows(1).execute()
    assert rows(db)[0][2] == 2
    with pytest.raises(errors.ScopeError):
        db.update(items).set({"n": 0}).execute()
    with pytest.raises(errors.ScopeError):
        db.delete_from(items).execute()
    with pytest.raises(errors.UniqueViolation):
        db.update(items).set({"key": "same"}).all_rows().execute()
    assert db.delete_from(items).where(lambda eb: eb.ref("items.n").gt(3)).returning_all().execute()[0]["key"] == "c"
    assert db.delete_from(items).all_rows().execute().row_count == 2 and rows(db) == []


def test_only_files_with_a_hit_are_written(db):
    def paths():
        return View(db.store).state.paths["plain"]

    for start in (0, 10, 20):
        db.insert_into(plain).values([{"k": start + i, "v": "x"} for i in range(3)]).execute()
    first = paths()
    assert len(first) == 3
    assert db.update(plain).set({"v": "y"}).where("plain.k", 11).execute().row_count == 1
    after = paths()
    assert first[0] in after and first[2] in after and first[1] not in after
    assert db.update(plain).set({"v": "z"}).where("plain.k", 99).execute().row_count == 0 and paths() == after
    assert db.delete_from(plain).where("plain.k", 99).execute().row_count == 0 and paths() == after
    assert db.delete_from(plain).where("plain.k", 2).execute().row_count == 1
    assert first[2] in paths() and first[0] not in paths()
    with pytest.raises(errors.UniqueViolation):
        db.update(plain).set({"k": 20}).where("plain.k", 0).execute()
    with pytest.raises(errors.UniqueViolation):
        db.update(plain).set({"k": 12}).where("plain.k", 11).execute()
    assert db.insert_into(plain).values([{"k": 20, "v": "m"}, {"k": 30, "v": "n"}]).on_conflict("k").merge().execute().row_count == 2
    assert db.update(plain).set_each([{"k": 30, "v": "o"}, {"k": 77, "v": "p"}], key="k").execute().row_count == 1
    have = {r["k"]: r["v"] for r in db.select_from(plain).select("plain.k", "plain.v").execute()}
    assert have == {0: "x", 1: "x", 10: "x", 11: "y", 12: "x", 20: "m", 21: "x", 22: "x", 30: "o"}


def test_set_each(db):
    done = db.update(items).set_each([{"key": "a", "n": 10}, {"key": "b", "n": None}, {"key": "nobody", "n": 1}], key="key").returning("items.key", lambda eb: eb.ref("row.n").as_("given")).execute()
    assert sorted((r["key"], r["given"]) for r in done) == [("a", 10), ("b", None)]
    db.update(items).set_each([{"id": 1, "key": "A"}, {"id": 3, "n": 8}], key="id").where(lambda eb: eb.ref("items.id").lt(9)).execute()
    assert rows(db) == [(1, "A", 10, 20), (2, "b", None, None), (3, "c", 8, 16)]
    for bad in ([{"n": 1}], [{"key": "a", "n": 1}, {"key": "a", "n": 2}]):
        with pytest.raises(errors.ScopeError):
            db.update(items).set_each(bad, key="key")


def test_transactions(db, spark):
    calls = []

    def work(tx):
        tx.after_commit(lambda: calls.append("committed"))
        tx.insert_into(plain).values({"k": 1, "v": "x"}).execute()
        with pytest.raises(ZeroDivisionError):
            tx.transaction(lambda inner: (inner.delete_from(plain).all_rows().execute(), inner.after_rollback(lambda: calls.append("undone")), 1 / 0))
        assert len(tx.select_from(plain).select("plain.k").execute()) == 1
        assert len(db.select_from(plain).select("plain.k").execute()) == 0
        return "done"

    assert db.transaction(work) == "done" and calls == ["undone", "committed"]
    assert len(db.select_from(plain).select("plain.k").execute()) == 1
    with pytest.raises(ZeroDivisionError):
        db.transaction(lambda tx: (tx.delete_from(plain).all_rows().execute(), 1 / 0))
    assert len(db.select_from(plain).select("plain.k").execute()) == 1
    with pytest.raises(errors.ReadOnlyTransaction):
        db.transaction(lambda tx: tx.delete_from(plain).all_rows().execute(), read_only=True)
    seen = []
    db.transaction(lambda tx: (tx.set_local("spark.sql.shuffle.partitions", "3"), seen.append(spark.conf.get("spark.sql.shuffle.partitions"))), settings={"spark.sql.files.maxRecordsPerFile": "7"})
    assert seen == ["3"] and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert db.transaction(lambda tx: tx.execute_and_commit(tx.insert_into(plain).values({"k": 2, "v": "y"}))).row_count == 1

    def swallowed(tx):
        try:
            tx.insert_into(plain).values({"k": 2, "v": "again"}).execute()
        except errors.UniqueViolation:
            pass

    with pytest.raises(errors.UniqueViolation):
        db.transaction(swallowed)


def test_conflicting_writers(db):
    def work(tx):
        tx.update(items).set({"n": 1}).all_rows().execute()
        if not done:
            done.append(1)
            db.update(items).set({"n": 2}).all_rows().execute()

    done = []
    with pytest.raises(errors.SerializationFailure):
        db.transaction(work)
    done = []
    db.transaction(work, retries=1)
    assert {r[2] for r in rows(db)} == {1}


def test_batches(db):
    got = db.batch([tarn.select_from(items).select("items.key").order_by("items.key").take_first(), tarn.update(items).set({"n": 3}).where("items.key", "a")])
    assert got[0] == {"key": "a"} and got[1].row_count == 1
    with pytest.raises(errors.BatchError) as failed:
        db.batch([tarn.insert_into(items).values({"key": "a"}), tarn.insert_into(items).values({"key": "new"})])
    assert isinstance(failed.value.outcomes[0], errors.UniqueViolation) and failed.value.outcomes[1].row_count == 1
    with pytest.raises(errors.UniqueViolation):
        db.batch([tarn.insert_into(items).values({"key": "other"}), tarn.insert_into(items).values({"key": "a"})], transaction=True)
    assert "other" not in {r[1] for r in rows(db)}


def test_copy(db, tmp_path):
    assert db.copy_rows(plain, [(1, "a\tb"), (2, None), (3, "back\\slash\nline")]) == 3
    lines = sorted(db.copy_lines(db.select_from(plain).select_all("plain")))
    assert lines == ["1\ta\\tb", "2\t\\N", "3\tback\\\\slash\\nline"]
    db.copy_to(db.select_from(plain).select_all("plain"), str(tmp_path / "out"))
    db.delete_from(plain).all_rows().execute()
    assert db.copy_from(plain, str(tmp_path / "out")) == 3
    got = db.select_from(plain).select_all("plain").order_by("plain.k").execute()
    assert got == [{"k": 1, "v": "a\tb"}, {"k": 2, "v": None}, {"k": 3, "v": "back\\slash\nline"}]
    with pytest.raises(errors.UniqueViolation):
        db.copy_rows(plain, [(1, "x")])
    from tarn.sources.copy import escape_line

    assert escape_line([1, None, "a\\b\n"]) == "1\t\\N\ta\\\\b\\n"


def test_notices(db, spark, tmp_path):
    got = []
    stop = db.listen("jobs", got.append)
    db.notify("jobs", "1")
    db.transaction(lambda tx: tx.notify("jobs", "2"))
    with pytest.raises(ZeroDivisionError):
        db.transaction(lambda tx: (tx.notify("jobs", "never"), 1 / 0))
    stop()
    db.notify("jobs", "3")
    assert got == ["1", "2"]
    from tarn.streaming import notices

    folder, seen = str(tmp_path / "notices"), []
    notices.send(spark, folder, "jobs", "x")
    notices.send(spark, folder, "other", "y")
    notices.follow(spark, folder, "jobs", seen.append, str(tmp_path / "at"), once=True).awaitTermination()
    notices.send(spark, folder, "jobs", "z")
    notices.follow(spark, folder, "jobs", seen.append, str(tmp_path / "at"), once=True).awaitTermination()
    assert seen == ["x", "z"]


def test_verify(spark, tmp_path):
    status = tarn.define_enum("status", ["active", "gone"])
    t = define_table("t", id=tarn.integer(), email=tarn.varchar(255), age=tarn.bigint(), s=status(), missing=tarn.text())
    rows = [(1, "a", 5, "active", "extra"), (None, "b", 6, "other", "extra")]
    spark.createDataFrame(rows, "id int, email string, age int, s string, more string").write.parquet(str(tmp_path / "t.parquet"))
    report = Database(spark, str(tmp_path)).verify([t, define_table("absent", id=tarn.integer())])
    found = {(d.code, d.column) for d in report.diagnostics}
    assert found == {("column-type-mismatch", "age"), ("column-missing", "missing"), ("column-extra", "more"), ("enum-label-mismatch", "s"), ("column-nullable-mismatch", "id"), ("table-missing", None)}
    assert report.exit_code == 1
    for form in ("pretty", "table", "github", "json"):
        assert "column-missing" in report.render(form)
    own = Database(spark, store=str(tmp_path / "store"))
    own.create(t)
    assert own.verify([t]).exit_code == 0


def test_modifiers_and_row_types():
    with pytest.raises(errors.KindError):
        tarn.text().identity()
    with pytest.raises(errors.KindError):
        tarn.integer().identity().default(1)
    with pytest.raises(errors.KindError):
        tarn.array(tarn.array(tarn.text()))
    assert items.insert_type.fieldNames() == ["key", "n"] and items.update_type.fieldNames() == ["key", "n"]
    assert items.select_type.fieldNames() == ["id", "key", "n", "twice"]


def test_copy_file_objects(db):
    with db.copy_writer(plain) as f:
        f.write("1\tx\n2\t")
        f.write("\\N\n3\tz")
    assert f.row_count == 3
    lines = db.copy_reader(db.select_from(plain).select_all("plain").order_by("plain.k"))
    assert lines.read(3) == "1\tx" and lines.readline() == "\n" and list(lines) == ["2\t\\N\n", "3\tz\n"]
    with pytest.raises(ZeroDivisionError), db.copy_writer(plain) as f:
        f.write("9\tlost\n")
        1 / 0
    assert len(db.select_from(plain).select("plain.k").execute()) == 3


def test_now_is_when_the_transaction_started(db):
    import time

    def work(tx):
        now = lambda: tx.select_from(items).select(lambda eb: eb.fn.now().as_("t")).take_value().execute()
        first = now()
        time.sleep(0.05)
        return first, now()

    first, second = db.transaction(work)
    assert first == second


def test_a_writer_that_dies_leaves_the_log_readable(spark, tmp_path, monkeypatch):
    from tarn.sources import store as module

    own = module.Store(spark, str(tmp_path / "log"))
    own.publish(0, module.State({"t": ["a"]}), {"t"})

    def dies(*_):
        raise OSError("died")

    monkeypatch.setattr(module.os, "link", dies)
    with pytest.raises(OSError):
        own.publish(1, module.State({"t": ["b"]}), {"t"})
    assert own.head()[1].paths == {"t": ["a"]}
    monkeypatch.undo()
    assert own.publish(1, module.State({"t": ["c"]}), {"t"}) == 2 and own.head()[1].paths == {"t": ["c"]}
    assert not own._put(2, "{}") and own.head()[1].paths == {"t": ["c"]}
