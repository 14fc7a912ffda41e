"""Sessions, mutations, transactions, files and the query catalogue."""

import sqlite3

import duckdb
import pytest

from lumenrow import Session
from lumenrow.errors import ConstraintFailure, EngineError, Full, Mismatch, Misuse, NotADatabase, OutOfRange, Unsupported
from lumenrow.plans import catalogue
from lumenrow.sources import dbfile


@pytest.fixture
def session(spark):
    s = Session(spark)
    s.execute("CREATE TABLE t(a INTEGER PRIMARY KEY, b TEXT NOT NULL DEFAULT 'q', c NUMERIC, d REAL, e)")
    return s


def test_affinity_on_store(session):
    for row in [(1, 12, "3.0", 2, "x"), (2, 1.5, "abc", "7", 2.0), (3, b"z", 2.5, "z", None)]:
        session.execute("INSERT INTO t VALUES (?, ?, ?, ?, ?)", *row)
    assert session.execute("SELECT b, c, d, e FROM t ORDER BY a") == [("12", 3, 2.0, "x"), ("1.5", "abc", 7.0, 2.0), (b"z", 2.5, "z", None)]
    assert session.execute("SELECT typeof(b), typeof(c), typeof(d), typeof(e) FROM t ORDER BY a")[1] == ("text", "text", "real", "real")


def test_rowids(session):
    session.execute("INSERT INTO t(b) VALUES ('x')")
    session.execute("INSERT INTO t(a, b) VALUES (41, 'x')")
    session.execute("INSERT INTO t DEFAULT VALUES")
    assert (session.last_insert_rowid, session.changes) == (42, 1)
    assert session.execute("SELECT rowid, oid, _rowid_, a FROM t ORDER BY a") == [(i,) * 4 for i in (1, 41, 42)]
    session.execute("INSERT INTO t(a, b) VALUES (9223372036854775807, 'x')")
    session.execute("INSERT INTO t(b) VALUES ('random')")
    assert session.execute("SELECT count(*) FROM t") == [(5,)]
    with pytest.raises(Mismatch):
        session.execute("INSERT INTO t(a) VALUES ('x')")
    assert issubclass(Full, EngineError) and Full.code == 13


def test_hidden_rowid(spark):
    s = Session(spark)
    s.execute("CREATE TABLE n(x TEXT)")
    s.execute("INSERT INTO n VALUES ('a'); INSERT INTO n VALUES ('b')")
    assert s.execute("SELECT * FROM n") == [("a",), ("b",)]
    assert s.execute("SELECT rowid, x FROM n WHERE rowid > 1") == [(2, "b")]


def test_constraints_abort_the_statement(session):
    session.execute("INSERT INTO t VALUES (1, 'x', 1, 1, 1)")
    session.execute("CREATE UNIQUE INDEX u ON t(b COLLATE NOCASE)")
    for sql in ("INSERT INTO t(a) VALUES (1)", "INSERT INTO t(b) VALUES (NULL)", "INSERT INTO t(b) VALUES ('X')", "UPDATE t SET b = NULL"):
        with pytest.raises(ConstraintFailure):
            session.execute(sql)
    assert session.execute("SELECT * FROM t") == [(1, "x", 1, 1.0, 1)]
    session.execute("INSERT INTO t(b) VALUES ('y')")
    with pytest.raises(ConstraintFailure):
        session.execute("UPDATE t SET b = 'same'")


def test_update_delete(session):
    for i in range(1, 6):
        session.execute("INSERT INTO t(a, b, c) VALUES (?, ?, ?)", i, f"n{i}", i * 10)
    session.execute("UPDATE t SET c = c + 1, b = b || '!' WHERE a > 3 AND c > (SELECT 45)")
    assert session.changes == 1 and session.execute("SELECT b, c FROM t WHERE a = 5") == [("n5!", 51)]
    session.execute("UPDATE t SET a = a + 100 WHERE c < 30")
    assert session.execute("SELECT a FROM t ORDER BY a") == [(3,), (4,), (5,), (101,), (102,)]
    session.execute("DELETE FROM t WHERE a > 100 OR c IS NULL")
    assert session.changes == 2 and session.execute("SELECT count(*) FROM t") == [(3,)]
    session.execute("DELETE FROM t")
    assert session.execute("SELECT count(*) FROM t") == [(0,)]


def test_many_changes_keep_short_lineage(session):
    for i in range(20):
        session.execute("INSERT INTO t(b) VALUES (?)", str(i))
    assert session.catalog.table("t").pending < 8
    assert session.execute("SELECT count(*), max(a) FROM t") == [(20, 20)]


def test_transactions(session):
    session.execute("INSERT INTO t(b) VALUES ('one')")
    session.execute("BEGIN; INSERT INTO t(b) VALUES ('two'); SAVEPOINT s; INSERT INTO t(b) VALUES ('three')")
    assert not session.autocommit
    session.execute("ROLLBACK TO s; INSERT INTO t(b) VALUES ('four'); RELEASE s; COMMIT")
    assert session.autocommit and session.execute("SELECT b FROM t ORDER BY a") == [("one",), ("two",), ("four",)]
    session.execute("BEGIN IMMEDIATE; DELETE FROM t; CREATE TABLE gone(x); ROLLBACK")
    assert session.execute("SELECT count(*) FROM t") == [(3,)]
    for sql in ("COMMIT", "ROLLBACK", "RELEASE nosuch", "SELECT * FROM gone"):
        with pytest.raises(EngineError):
            session.execute(sql)
    session.execute("SAVEPOINT a; DELETE FROM t; ROLLBACK TRANSACTION")
    assert session.execute("SELECT count(*) FROM t") == [(3,)]
    session.execute("BEGIN")
    with pytest.raises(EngineError):
        session.execute("BEGIN")


def test_definitions(session):
    session.execute("CREATE TABLE IF NOT EXISTS t(z)")
    for sql in ("CREATE TABLE t(z)", "CREATE TABLE d(x, X)", "CREATE INDEX i ON t(nosuch)", "CREATE INDEX i ON nosuch(a)", "CREATE TABLE sqlite_x(a)"):
        with pytest.raises(EngineError):
            session.execute(sql)
    session.execute("CREATE INDEX i ON t(b, c DESC); CREATE INDEX IF NOT EXISTS i ON t(b)")
    assert [r[1] for r in session.execute("SELECT type, name FROM sqlite_master ORDER BY 1, 2")] == ["i", "t"]


def test_analyze(session):
    for i in range(10):
        session.execute("INSERT INTO t(b, c) VALUES (?, ?)", "ab"[i % 2], i % 5)
    session.execute("CREATE INDEX i ON t(b, c); CREATE TABLE plain(x); INSERT INTO plain VALUES (1); ANALYZE")
    assert sorted(session.execute("SELECT * FROM sqlite_stat1")) == [("plain", None, "1"), ("t", "i", "10 5 1")]
    session.execute("DELETE FROM t WHERE b = 'a'; ANALYZE i")
    assert sorted(session.execute("SELECT * FROM sqlite_stat1")) == [("plain", None, "1"), ("t", "i", "5 5 1")]


def test_prepared_statements(session):
    session.execute("INSERT INTO t(b, c) VALUES ('x', 1); INSERT INTO t(b, c) VALUES ('y', 2)")
    text = "SELECT b AS name, c FROM t WHERE c >= ?1 AND b <> :b AND c < ?5; SELECT 2"
    s, tail = session.prepare(text)
    assert text[tail:] == " SELECT 2"
    assert (s.parameter_count, s.parameter_name(2), s.parameter_index(":b"), s.parameter_index("@z")) == (5, ":b", 2, 0)
    s.bind(1, 1).bind(":b", "y").bind(5, 9)
    assert list(s) == [("x", 1)] == list(s)
    s.bind(":b", "x")
    assert list(s) == [("y", 2)]
    assert [c.name for c in s.result_columns()] == ["name", "c"]
    assert s.step() and s.row == ("y", 2)
    with pytest.raises(Misuse):
        s.bind(1, 2)
    assert not s.reset().finalize()
    with pytest.raises(Misuse):
        s.step()
    with pytest.raises(OutOfRange):
        session.prepare("SELECT ?")[0].bind(2, 1)
    assert session.prepare(" ; -- nothing\n")[0] is None
    assert "Physical Plan" in session.prepare("SELECT b FROM t")[0].explain()


def test_compensated_sums(spark):
    rows = spark.createDataFrame([(1e16,), (1.0,), (-1e16,)], "r double").coalesce(1)
    assert Session(spark, {"x": rows}, exact_sums=True).execute("SELECT sum(r), total(r), avg(r) FROM x") == [(1.0, 1.0, 1.0 / 3)]


def test_integer_sum_overflow_raises(spark):
    s = Session(spark, {"x": spark.createDataFrame([(2**62,), (2**62,)], "i long")})
    with pytest.raises(Exception, match="(?i)overflow"):
        s.execute("SELECT sum(i) FROM x")


def test_bare_columns_follow_the_extreme(spark):
    s = Session(spark, {"x": spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, None, "c")], "g long, v long, w string")})
    assert sorted(s.execute("SELECT g, max(v), w FROM x GROUP BY g")) == [(1, 9, "b"), (2, None, "c")]
    assert s.execute("SELECT min(v), w FROM x") == [(5, "a")]


def test_limits_of_the_dialect(spark):
    s = Session(spark, {"x": spark.range(1)})
    with pytest.raises(EngineError):
        s.execute("SELECT " + ", ".join(["1"] * 2001))
    with pytest.raises(EngineError):
        s.execute("SELECT 1 FROM " + ", ".join(f"x a{i}" for i in range(65)))
    with pytest.raises(EngineError):
        s.execute("SELECT ?40000")


def test_filters_are_pushed_down(spark):
    s = catalogue.session_for(spark, "/root/testdata/sf0.001", "orders")
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = s.sql("SELECT o_totalprice FROM orders WHERE o_orderkey > 5.5 AND o_orderstatus = 'F'")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,5)" in plan and "EqualTo(o_orderstatus,F)" in plan
    assert "o_custkey" not in plan.split("ReadSchema")[1]


def test_database_file(spark, tmp_path):
    path = str(tmp_path / "x.db")
    db = sqlite3.connect(path)
    db.executescript("""
        CREATE TABLE items(id INTEGER PRIMARY KEY, name TEXT COLLATE NOCASE NOT NULL, score REAL, payload BLOB);
        CREATE TABLE mixed(value); CREATE TABLE keyed(a TEXT, b INTEGER, PRIMARY KEY(a, b)) WITHOUT ROWID;
        ALTER TABLE items ADD COLUMN later TEXT DEFAULT 'fallback';
    """)
    db.executemany("INSERT INTO items(id, name, score, payload) VALUES (?, ?, ?, ?)", [(i, f"N{i}", i / 2, bytes(i % 900)) for i in range(1, 2001)])
    db.executemany("INSERT INTO mixed VALUES (?)", [(None,), (1,), (2.5,), ("t",), (b"b",)])
    db.execute("INSERT INTO keyed VALUES ('k', 1)")
    db.commit()
    db.close()
    s = Session.open(spark, path)
    assert s.execute("SELECT count(*), sum(id), max(length(payload)), min(later) FROM items") == [(2000, 2001000, 899, "fallback")]
    assert s.execute("SELECT id FROM items WHERE name = 'n7'") == [(7,)]
    assert s.execute("SELECT value, typeof(value) FROM mixed ORDER BY value") == [(None, "null"), (1, "integer"), (2.5, "real"), ("t", "text"), (b"b", "blob")]
    assert s.execute("SELECT * FROM keyed") == [("k", 1)]
    assert spark.read.format("dbfile").option("table", "items").option("rows", 500).load(path).rdd.getNumPartitions() == 4
    pages = {r.kind: r.n for r in dbfile.inspect_pages(spark, path).groupBy("kind").agg({"cells": "sum"}).withColumnRenamed("sum(cells)", "n").collect()}
    assert pages["table leaf"] >= 2005 and not dbfile.inspect_pages(spark, path).filter("issue is not null").count()
    out = str(tmp_path / "y.db")
    dbfile.write_file({"items": s.sql("SELECT id, name FROM items WHERE id < 4"), "mixed": s.sql("SELECT value FROM mixed")}, out)
    assert sqlite3.connect(out).execute("SELECT * FROM items").fetchall() == [(1, "N1"), (2, "N2"), (3, "N3")]
    assert sqlite3.connect(out).execute("SELECT value FROM mixed ORDER BY value").fetchall() == [(None,), (1,), (2.5,), ("t",), (b"b",)]
    bad = tmp_path / "bad.db"
    bad.write_bytes(b"not a database at all, surely" * 99)
    with pytest.raises(NotADatabase):
        Session.open(spark, str(bad))


def test_folder(spark):
    s = Session.open(spark, "/root/testdata/sf0.001")
    assert s.execute("SELECT count(*) FROM nation") == [(25,)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_catalogue(spark, duck, name):
    got = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    want = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    near = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    a = sorted(([near(r[c]) for c in names] for r in got.collect()), key=repr)
    b = sorted(([near(v) for v in r] for r in want.fetchall()), key=repr)
    assert a == b


def test_entry():
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert Unsupported.code == 1


def test_commits_to_a_folder_last(spark, tmp_path):
    folder = str(tmp_path / "db")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string").write.parquet(f"{folder}/items.parquet")
    s = Session.open(spark, folder, write=True)
    s.execute("INSERT INTO items VALUES (3, 'c')")
    s.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, body TEXT NOT NULL DEFAULT 'x', raw DEFAULT x'00ff'); CREATE UNIQUE INDEX u ON t(body COLLATE NOCASE)")
    s.execute("INSERT INTO t DEFAULT VALUES; INSERT INTO t(body, raw) VALUES ('y', 2.5)")
    s.execute("BEGIN; UPDATE items SET name = 'z' WHERE id = 1; DELETE FROM t; ROLLBACK")
    s.execute("BEGIN; DELETE FROM items WHERE id = 2")
    again = Session.open(spark, folder)
    assert sorted(again.execute("SELECT * FROM items")) == [(1, "a"), (2, "b"), (3, "c")]  # not committed yet
    s.execute("UPDATE items SET name = name || '!'; COMMIT")
    s.execute("SAVEPOINT a; DELETE FROM items WHERE id = 3; SAVEPOINT b; DELETE FROM items; ROLLBACK TO b; RELEASE a")
    assert s.execute("SELECT * FROM items") == [(1, "a!")]
    again = Session.open(spark, folder, write=True)
    assert again.execute("SELECT * FROM items") == [(1, "a!")]
    assert again.execute("SELECT rowid, body, typeof(raw) FROM t ORDER BY id") == [(1, "x", "blob"), (2, "y", "real")]
    assert again.execute("SELECT name FROM sqlite_schema WHERE type = 'index'") == [("u",)]
    with pytest.raises(ConstraintFailure):
        again.execute("INSERT INTO t(body) VALUES ('Y')")
    again.execute("INSERT INTO t(body) VALUES ('w')")
    assert Session.open(spark, folder, write=True).execute("SELECT id, body FROM t ORDER BY 1") == [(1, "x"), (2, "y"), (3, "w")]


def test_an_interrupted_commit_is_finished_or_forgotten(spark, tmp_path, monkeypatch):
    from lumenrow.sources import folder as store

    folder = str(tmp_path / "db")
    spark.createDataFrame([(1,)], "id long").write.parquet(f"{folder}/a.parquet")
    spark.createDataFrame([(1,)], "id long").write.parquet(f"{folder}/b.parquet")

    def dies(self, note):
        raise OSError("power cut")

    s = Session.open(spark, folder, write=True)
    monkeypatch.setattr(store.Store, "finish", dies)
    with pytest.raises(OSError):
        s.execute("BEGIN; INSERT INTO a VALUES (2); DELETE FROM b; COMMIT")
    monkeypatch.undo()
    s = Session.open(spark, folder, write=True)  # the note was there: both tables change
    assert (sorted(s.execute("SELECT id FROM a")), s.execute("SELECT id FROM b")) == ([(1,), (2,)], [])
    monkeypatch.setattr(store.Files, "write", dies)
    with pytest.raises((OSError, TypeError)):
        s.execute("DELETE FROM a")
    assert len(s.execute("SELECT id FROM a")) == 2
    monkeypatch.undo()
    assert len(Session.open(spark, folder, write=True).execute("SELECT id FROM a")) == 2


def test_changed_columns_are_checked(session):
    session.execute("CREATE TABLE k(id INTEGER PRIMARY KEY, a TEXT NOT NULL, b); CREATE UNIQUE INDEX ab ON k(a, b)")
    session.execute("INSERT INTO k VALUES (1, 'x', 1); INSERT INTO k VALUES (2, 'x', 2); INSERT INTO k VALUES (3, 'x', NULL); INSERT INTO k VALUES (4, 'x', NULL)")
    for wrong in ("INSERT INTO k VALUES (1, 'q', 9)", "INSERT INTO k VALUES (9, 'x', 1.0)", "INSERT INTO k VALUES (9, NULL, 1)", "UPDATE k SET b = 1 WHERE id = 2", "UPDATE k SET a = NULL WHERE id = 1", "UPDATE k SET id = 7 WHERE id < 3"):
        with pytest.raises(ConstraintFailure):
            session.execute(wrong)
    session.execute("UPDATE k SET b = b + 1, id = id + 10")
    assert session.execute("SELECT id, b FROM k ORDER BY id") == [(11, 2), (12, 3), (13, None), (14, None)]
    session.execute("UPDATE k SET a = 'y' WHERE id > 99")
    assert session.changes == 0
