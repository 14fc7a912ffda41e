"""Seeded random expressions and queries against the standard library's SQLite."""

import random
import sqlite3

import pytest

from lumenrow import Session

ROWS = [
    (1, 0, 0.0, "", None),
    (2, 1, 1.0, "1", 1),
    (3, -7, 2.5, "abc", 1.0),
    (4, None, None, None, "1"),
    (5, 40, -0.5, "12x", "abc"),
    (6, 3, 1e15, " 3 ", b"abc"),
    (7, 100, 0.1, "2.50", 2.5),
    (8, -1, -3.0, "ABC", -4),
    (9, 1, 1.5, "a ", "ABC"),
]
COLUMNS = {"i": "n", "r": "n", "t": "s", "m": "d"}
CONSTANTS = ["0", "1", "-3", "2.5", "'1'", "'abc'", "' 2'", "'ABC'", "NULL", "x'616263'", "7", "'3.0'", "''", "1e3"]


class Model:
    def __init__(self, seed):
        self.rng = random.Random(seed)

    def leaf(self):
        return self.rng.choice(list(COLUMNS)) if self.rng.random() < 0.6 else self.rng.choice(CONSTANTS)

    def expr(self, depth):
        r = self.rng
        if depth == 0 or r.random() < 0.15:
            return self.leaf()
        a, b = (lambda: self.expr(depth - 1)), (lambda: self.expr(depth - 1))
        pick = r.randrange(14)
        if pick < 3:
            return f"({a()} {r.choice(['=', '<>', '<', '<=', '>', '>=', 'IS', 'IS NOT'])} {b()})"
        if pick < 5:
            return f"({a()} {r.choice(['+', '-', '*', '/', '%'])} {b()})"
        if pick == 5:
            return f"({a()} {r.choice(['AND', 'OR'])} {b()})"
        if pick == 6:
            return r.choice(["(NOT {})", "(- {})", "(+ {})"]).format(a())
        if pick == 7:
            return f"({a()} {r.choice(['', 'NOT '])}IN ({', '.join(r.choice(CONSTANTS) for _ in range(r.randrange(1, 4)))}))"
        if pick == 8:
            return f"coalesce({a()}, {b()})" if r.random() < 0.5 else f"nullif({a()}, {b()})"
        if pick == 9:
            return f"iif({a()}, {b()}, {self.leaf()})"
        if pick == 10:
            return f"{r.choice(['typeof', 'length', 'lower', 'upper'])}({a()})"
        if pick == 11:
            return f"{r.choice(['min', 'max'])}({a()}, {b()})"
        if pick == 12:
            return f"({self.leaf()} COLLATE {r.choice(['NOCASE', 'RTRIM', 'BINARY'])} {r.choice(['=', '<', '>='])} {self.leaf()})"
        return f"({self.leaf()} {r.choice(['&', '|', '<<', '>>'])} {r.choice(['1', '2', '-1', '70', 'i'])})"


@pytest.fixture(scope="module")
def both(spark):
    lite = sqlite3.connect(":memory:")
    lite.execute("CREATE TABLE x(id INTEGER PRIMARY KEY, i INTEGER, r REAL, t TEXT, m)")
    lite.executemany("INSERT INTO x VALUES (?, ?, ?, ?, ?)", ROWS)
    ours = Session(spark)
    from lumenrow.sources.dbfile import dynamic

    rows = [(*r[:4], dynamic(r[4])) for r in ROWS]
    ours.register("x", spark.createDataFrame(rows, "id long, i long, r double, t string, m struct<k:tinyint,r:double,o:boolean,i:bigint,t:string,b:binary,f:boolean>").coalesce(1), rowid="id")
    return lite, ours


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("seed", range(24))
def test_expressions(both, seed):
    lite, ours = both
    model = Model(seed)
    exprs = [model.expr(2) for _ in range(12)]
    sql = "SELECT id, " + ", ".join(exprs) + " FROM x ORDER BY id"
    want, got = lite.execute(sql).fetchall(), ours.execute(sql)
    for a, b in zip(got, want, strict=True):
        for e, v, w in zip(exprs, a[1:], b[1:], strict=True):
            assert (type(plain(v)), plain(v)) == (type(plain(w)), plain(w)), f"id {a[0]}: {e}"


@pytest.mark.parametrize("seed", range(16))
def test_queries(both, seed):
    lite, ours = both
    model = Model(1000 + seed)
    where, key, value = model.expr(2), model.expr(1), model.leaf()
    for sql in (
        f"SELECT id FROM x WHERE {where} ORDER BY id",
        f"SELECT count(*), count({value}), min({value}), max({value}), total({value}) FROM x WHERE {where}",
        f"SELECT id FROM x ORDER BY {key}, id",
        f"SELECT count(*) AS n FROM x GROUP BY {key if not key.lstrip('-').replace('.', '').isdigit() else 'i'} ORDER BY n",
        f"SELECT a.id, b.id FROM x a LEFT JOIN x b ON a.i = b.{model.rng.choice('irtm')} AND b.id <> {model.rng.randrange(9)} ORDER BY 1, 2",
    ):
        got, want = ours.execute(sql), lite.execute(sql).fetchall()
        assert [tuple(map(plain, r)) for r in got] == [tuple(map(plain, r)) for r in want], sql
