"""Columns with collations against the standard library's SQLite; representatives are compared folded."""

import sqlite3

import pytest

from lumenrow import Session

ROWS = [(1, "Ann", "x "), (2, "ANN", "x"), (3, "bob", "y"), (4, None, None), (5, "Bob ", "y  "), (6, "ä", "z"), (7, "Ä", "Z")]
QUERIES = """
SELECT id FROM c WHERE name = 'ann'
SELECT id FROM c WHERE 'BOB' = name
SELECT id FROM c WHERE name COLLATE BINARY = 'Ann'
SELECT id FROM c WHERE name IN ('aNN', 'zed')
SELECT id FROM c WHERE tail = 'y'
SELECT id FROM c WHERE tail IN ('x', 'z   ')
SELECT id FROM c WHERE name < 'B'
SELECT id FROM c WHERE name IS 'ANN'
SELECT id FROM c WHERE nullif(name, 'ANN') IS NULL
SELECT id, max(name, 'aaa') IS NOT NULL FROM c
SELECT a.id, b.id FROM c a JOIN c b ON a.name = b.name
SELECT a.id, b.id FROM c a JOIN c b USING (tail)
SELECT count(*), lower(name) FROM c GROUP BY name
SELECT count(*), lower(name) FROM c GROUP BY name COLLATE BINARY
SELECT count(*) AS n FROM c GROUP BY tail HAVING n > 1
SELECT count(DISTINCT name), count(DISTINCT tail), lower(min(name)), lower(max(name)) FROM c
SELECT DISTINCT lower(name) FROM c
SELECT name FROM c WHERE id < 3 UNION SELECT 'ANN'
SELECT name FROM c INTERSECT SELECT 'ann'
SELECT id FROM c ORDER BY name, id
SELECT id FROM c ORDER BY name COLLATE BINARY DESC, id
SELECT id FROM c ORDER BY tail, id
SELECT lower(name) FROM c EXCEPT SELECT 'bob'
""".strip().splitlines()


@pytest.fixture(scope="module")
def both(spark):
    lite = sqlite3.connect(":memory:")
    lite.execute("CREATE TABLE c(id INTEGER PRIMARY KEY, name TEXT COLLATE NOCASE, tail TEXT COLLATE RTRIM)")
    lite.executemany("INSERT INTO c VALUES (?, ?, ?)", ROWS)
    ours = Session(spark)
    ours.register("c", spark.createDataFrame(ROWS, "id long, name string, tail string"), collations={"name": "NOCASE", "tail": "RTRIM"}, rowid="id")
    return lite, ours


@pytest.mark.parametrize("sql", QUERIES)
def test_collations(both, sql):
    fold = lambda rows: [tuple(v.lower().rstrip() if isinstance(v, str) and v.isascii() else v for v in r) for r in rows]
    got, want = fold(both[1].execute(sql)), fold(both[0].execute(sql).fetchall())
    if "ORDER BY" not in sql:
        got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert got == want
