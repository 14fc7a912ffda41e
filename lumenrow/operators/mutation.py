"""INSERT, UPDATE, DELETE, CREATE and ANALYZE as new versions of immutable tables."""

from __future__ import annotations

import random
import tempfile
import uuid
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintFailure, EngineError, Full, IoFailure, Mismatch, NameFailure, Unsupported
from ..functions import values as V
from ..functions.values import Value
from ..plans import ast
from ..plans.binder import Binder, Bound, Column, Scope
from ..sources.catalog import Index, Table, affinity_of

#: Changes to a table between two writings of its rows: lineage stays this short.
KEPT = 8
_MAX = (1 << 63) - 1


class Mutations:
    def __init__(self, session: Any) -> None:
        self.session = session

    @property
    def catalog(self) -> Any:
        return self.session.catalog

    def run(self, tree: Any, params: dict[int, Any]) -> None:
        return getattr(self, type(tree).__name__.lower())(tree, Binder(self.catalog, params))

    # rows
    def stored(self, v: Value, c: Column) -> str:
        """A value as the column stores it, after its affinity."""
        if c.kind == "dyn":
            if c.affinity == "TEXT":
                v = V.text_if_number(v)
            elif V.numeric_affinity(c.affinity):
                v = V.number_if_whole(V.shown(v))
                if v.kind == "real" or v.kind == "dyn":
                    whole = lambda d: f"IF({d}.k = 1 AND {d}.f AND {d}.r = floor({d}.r) AND abs({d}.r) < 9.2233720368547748E18D, {V.dyn_int(f'CAST({d}.r AS BIGINT)')}, {d})"
                    v = Value(V.let([V.dyn(v)], whole), "dyn") if c.affinity != "REAL" else v
                if c.affinity == "REAL":
                    v = Value(V.let([V.dyn(v)], lambda d: f"IF({d}.k = 1, {V.dyn_real(f'{d}.r')}, {d})"), "dyn")
            return V.dyn(V.shown(v))
        if v.kind == "null":
            return V.as_kind(v, c.kind if c.kind != "bool" else "int")
        if v.is_const and isinstance(v.const, str) and c.kind in ("int", "real"):
            v = V.number_if_whole(v)
        if c.kind == "int" and v.kind == "real" and v.is_const and v.const == int(v.const):
            v = V.literal(int(v.const))
        if c.kind == "text" and v.numeric:
            return V.as_text(v)
        if c.kind == "real" and v.numeric:
            return V.real_of(v)
        if c.kind in ("int", "bool") and v.kind in ("int", "bool"):
            return V.as_int(v)
        if c.kind == v.kind:
            return v.sql
        raise Mismatch(f"column {c.name} holds {c.kind} values only; declare the table in this session to mix storage classes")

    def names(self, t: Table) -> list[str]:
        own = [c.name for c in t.columns]
        return [*own, t.rowid] if t.rowid and t.rowid not in own else own

    def put(self, t: Table, frame: DataFrame) -> None:
        """Make ``frame``, whose constraints hold, the table's rows."""
        pending = t.pending + 1
        if pending >= KEPT:
            frame, pending = self.written(frame), 0
        self.catalog.state.tables[t.name.lower()] = replace(self.catalog.swap(t, frame), pending=pending)

    def unique(self, t: Table) -> list[Index]:
        return [x for x in self.catalog.state.indexes.values() if x.unique and x.table.lower() == t.name.lower()]

    def keys(self, t: Table, x: Index) -> list[str]:
        return [V.key(Value(f"`{c}`", t.column(c).kind, collation=collation or t.column(c).collation)) for c, collation, _ in x.terms]

    def not_unique(self, t: Table, columns: list[str]) -> ConstraintFailure:
        return ConstraintFailure(f"UNIQUE constraint failed: {', '.join(f'{t.name}.{c}' for c in columns)}")

    def rowid_name(self, t: Table) -> str:
        return t.key_column.name if t.key_column else "rowid"

    def check_new(self, t: Table, new: DataFrame) -> None:
        """Constraints of one new row: its own nulls, and a look for its keys among the rows there are."""
        row = new.select(*[F.col(f"`{c.name}`").isNull().alias(f"n{i}") for i, c in enumerate(t.columns)], *([F.col(f"`{t.rowid}`").alias("rowid")] if t.rowid else [])).first()
        for i, c in enumerate(t.columns):
            if c.not_null and not c.primary and row[f"n{i}"]:
                raise ConstraintFailure(f"NOT NULL constraint failed: {t.name}.{c.name}")
        if t.rowid and not t.frame.filter(F.col(f"`{t.rowid}`") == row["rowid"]).isEmpty():
            raise self.not_unique(t, [self.rowid_name(t)])
        for x in self.unique(t):
            names = [f"k{i}" for i in range(len(x.terms))]
            keyed = lambda frame, x=x, names=names: frame.select(*[F.expr(k).alias(n) for k, n in zip(self.keys(t, x), names, strict=True)]).dropna()
            if not keyed(t.frame).join(F.broadcast(keyed(new)), names, "left_semi").isEmpty():  # one row
                raise self.not_unique(t, [c for c, _, _ in x.terms])

    def check_changed(self, t: Table, frame: DataFrame, changed: set[str]) -> None:
        """Constraints that changed columns can break, over all rows: nulls in one pass, and each key that holds such a column."""
        wanted = [c for c in t.columns if c.not_null and not c.primary and c.name in changed]
        if wanted:
            nulls = frame.agg(*[F.max(F.col(f"`{c.name}`").isNull()).alias(f"n{i}") for i, c in enumerate(wanted)]).first()
            for i, c in enumerate(wanted):
                if nulls[f"n{i}"]:
                    raise ConstraintFailure(f"NOT NULL constraint failed: {t.name}.{c.name}")
        if t.rowid in changed and not frame.groupBy(f"`{t.rowid}`").count().filter("count > 1").isEmpty():
            raise self.not_unique(t, [self.rowid_name(t)])
        for x in self.unique(t):
            if changed & {t.column(c).name for c, _, _ in x.terms}:
                self.check_unique(t, frame, x)

    def check_unique(self, t: Table, frame: DataFrame, x: Index) -> None:
        names = [f"k{i}" for i in range(len(x.terms))]
        twice = frame.select(*[F.expr(k).alias(n) for k, n in zip(self.keys(t, x), names, strict=True)]).dropna().groupBy(*names).count().filter("count > 1")
        if not twice.isEmpty():
            raise self.not_unique(t, [c for c, _, _ in x.terms])

    def written(self, frame: DataFrame) -> DataFrame:
        """Rows written to the cluster's checkpoint folder and read again: short lineage that survives lost executors."""
        spark = self.session.spark
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise IoFailure("spark.checkpoint.dir has to name a folder that all executors share")
        path = f"{(folder or tempfile.gettempdir()).rstrip('/')}/table-{uuid.uuid4().hex}"
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    def insert(self, tree: ast.Insert, binder: Binder) -> None:
        t = self.catalog.table(tree.table)
        columns = [t.column(c) for c in tree.columns] if tree.columns else list(t.columns)
        row = tree.row if tree.row is not None else ()
        if tree.row is not None and len(row) != len(columns):
            raise NameFailure(f"{len(row)} values for {len(columns)} columns" if tree.columns else f"table {t.name} has {len(columns)} columns but {len(row)} values were supplied")
        given = dict(zip([c.name for c in columns], row, strict=False)) if tree.row is not None else {}
        cells, rowid = [], None
        for c in t.columns:
            expr = given.get(c.name, c.default)
            v = binder.expr(expr, Scope()) if expr is not None else V.literal(None)
            if c.primary:
                rowid = self.rowid_value(v, t)
                cells.append(f"{rowid}L AS `{c.name}`")
            else:
                cells.append(f"{self.stored(v, c)} AS `{c.name}`")
        if t.rowid and t.key_column is None:
            rowid = self.next_rowid(t)
            cells.append(f"{rowid}L AS `{t.rowid}`")
        new = self.session.spark.sql(f"SELECT {', '.join(cells)}")
        new = new.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in t.frame.schema.fields if f.name in new.columns])
        self.check_new(t, new)
        self.put(t, t.frame.select(*[f"`{n}`" for n in self.names(t)]).unionByName(new))
        self.session.changes = 1
        if rowid is not None:
            self.session.last_insert_rowid = rowid

    def rowid_value(self, v: Value, t: Table) -> int:
        v = V.number_if_whole(V.shown(v))
        got = v.const if v.is_const else self.catalog.evaluate(v)
        if got is None:
            return self.next_rowid(t)
        if isinstance(got, float) and got == int(got):
            got = int(got)
        if not isinstance(got, int):
            raise Mismatch("datatype mismatch: a rowid is an integer")
        return got

    def next_rowid(self, t: Table) -> int:
        """One more than the largest; at the largest integer, up to a hundred random tries."""
        top = t.frame.agg(F.max(f"`{t.rowid}`").alias("m")).first().m
        if top is None:
            return 1
        if top < _MAX:
            return top + 1
        for _ in range(100):
            n = random.randrange(1, _MAX)
            if t.frame.filter(F.col(f"`{t.rowid}`") == n).isEmpty():
                return n
        raise Full("database or disk is full")

    def scope(self, t: Table) -> Scope:
        return Scope(sources=[Bound(t.name, "t", t.columns, t.rowid)])

    def update(self, tree: ast.Update, binder: Binder) -> None:
        t = self.catalog.table(tree.table)
        scope = self.scope(t)
        hit = f"coalesce({V.truth(binder.expr(tree.where, scope))}, false)" if tree.where is not None else "true"
        sets = {}
        for name, expr in tree.sets:
            c = t.column(name)
            v = binder.expr(expr, scope)
            sets[c.name] = V.as_int(V.shown(v)) if c.primary and v.kind in ("int", "bool") else self.stored(v, c)
        cells = [f"IF(t.hit, {sets[n]}, t.`{n}`) AS `{n}`" if n in sets else f"t.`{n}`" for n in self.names(t)]
        told = self.session.spark.sql(f"SELECT t.*, {hit} AS hit FROM {t.view} AS t")
        view = self.catalog.view_of(told, f"{t.name}_hit")
        changes = told.filter("hit").count()
        frame = self.session.spark.sql(f"SELECT {', '.join(cells)} FROM {view} AS t")
        if changes:
            self.check_changed(t, frame, set(sets))
        self.put(t, frame)
        self.session.changes = changes

    def delete(self, tree: ast.Delete, binder: Binder) -> None:
        t = self.catalog.table(tree.table)
        hit = f"coalesce({V.truth(binder.expr(tree.where, self.scope(t)))}, false)" if tree.where is not None else "true"
        n = self.session.spark.sql(f"SELECT count(1) AS n FROM {t.view} AS t WHERE {hit}").first().n
        frame = self.session.spark.sql(f"SELECT * FROM {t.view} AS t WHERE NOT {hit}")
        self.put(t, frame)
        self.session.changes = n

    # definitions
    def createtable(self, tree: ast.CreateTable, binder: Binder) -> None:
        low = tree.table.lower()
        if low in self.catalog.state.tables or low in self.catalog.state.indexes:
            if tree.if_not_exists and low in self.catalog.state.tables:
                return
            raise EngineError(f"table {tree.table} already exists")
        if low.startswith("sqlite_"):
            raise EngineError(f"object name reserved for internal use: {tree.table}")
        if len({c.name.lower() for c in tree.columns}) < len(tree.columns):
            raise EngineError("duplicate column name")
        if sum(c.primary for c in tree.columns) > 1:
            raise EngineError(f'table "{tree.table}" has more than one primary key')
        columns = []
        for c in tree.columns:
            if c.default is not None and not binder.expr(c.default, Scope()).is_const:
                raise Unsupported(f"default value of column [{c.name}] is not constant")
            kind = "int" if c.primary else "dyn"
            columns.append(Column(c.name, kind, affinity_of(c.type), None, c.type, c.not_null, c.primary, c.default))
        key = next((c.name for c in columns if c.primary), "_rowid_")
        ddl = [f"`{c.name}` {'bigint' if c.kind == 'int' else V.DYN_TYPE}" for c in columns]
        ddl += ["`_rowid_` bigint"] if key == "_rowid_" else []
        frame = self.session.spark.createDataFrame([], ", ".join(ddl))
        text = f"CREATE TABLE {tree.table}({', '.join(f'{c.name} {c.declared}'.strip() for c in columns)})"
        self.catalog.state.tables[low] = Table(tree.table, columns, self.catalog.view_of(frame, tree.table), frame, key, text)
        self.catalog.state.cookie += 1

    def createindex(self, tree: ast.CreateIndex, binder: Binder) -> None:
        low = tree.name.lower()
        if low in self.catalog.state.indexes or low in self.catalog.state.tables:
            if tree.if_not_exists and low in self.catalog.state.indexes:
                return
            raise EngineError(f"index {tree.name} already exists")
        t = self.catalog.table(tree.table)
        for column, collation, _ in tree.terms:
            t.column(column)
            if collation and collation.upper() not in V.COLLATIONS:
                raise NameFailure(f"no such collation sequence: {collation}")
        terms = tuple((c, (k or "").upper() or None, d) for c, k, d in tree.terms)
        text = f"CREATE {'UNIQUE ' * tree.unique}INDEX {tree.name} ON {t.name}({', '.join(c + (f' COLLATE {k}' if k else '') + ' DESC' * bool(d) for c, k, d in terms)})"
        index = Index(tree.name, t.name, terms, tree.unique, text)
        if tree.unique:
            self.check_unique(t, t.frame, index)
        self.catalog.state.indexes[low] = index
        self.catalog.state.cookie += 1

    def analyze(self, tree: ast.Analyze, binder: Binder) -> None:
        """sqlite_stat1(tbl, idx, stat): for each index the rows and, for each prefix of its terms, rows for each distinct key, rounded up."""
        state = self.catalog.state
        low = (tree.target or "").lower()
        if low in state.indexes:
            wanted, tables = [state.indexes[low]], []
        elif low and low != "main":
            t = self.catalog.table(tree.target)
            wanted = [x for x in state.indexes.values() if x.table.lower() == t.name.lower()]
            tables = [t]
        else:
            wanted, tables = list(state.indexes.values()), [t for n, t in state.tables.items() if not n.startswith("sqlite_")]
        rows = []
        for x in wanted:
            t = self.catalog.table(x.table)
            keys = [V.key(Value(f"`{c}`", t.column(c).kind, collation=k or t.column(c).collation)) for c, k, _ in x.terms]
            counts = [F.expr(f"count(DISTINCT struct({', '.join(keys[: i + 1])}))").alias(f"d{i}") for i in range(len(keys))]
            got = t.frame.agg(F.count("*").alias("n"), *counts).first()
            if got.n:
                rows.append((t.name, x.name, " ".join([str(got.n), *[str(-(-got.n // got[f"d{i}"])) for i in range(len(keys))]])))
        for t in tables:
            if not any(x.table.lower() == t.name.lower() for x in state.indexes.values()) and (n := t.frame.count()):
                rows.append((t.name, None, str(n)))
        done = {(r[0].lower(), (r[1] or "").lower()) for r in rows} | {(t.name.lower(), "") for t in tables} | {(x.table.lower(), x.name.lower()) for x in wanted}
        if "sqlite_stat1" in state.tables:
            rows += [tuple(r) for r in state.tables["sqlite_stat1"].frame.collect() if (r[0].lower(), (r[1] or "").lower()) not in done]
        frame = self.session.spark.createDataFrame(rows, "tbl string, idx string, stat string")
        self.catalog.register("sqlite_stat1", frame)
