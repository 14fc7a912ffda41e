"""Database files as Spark data sources, a file writer, and a page inspector.

A table is read in ranges of its rowid, one task for each range, through the
standard library's reader opened read-only; a keyed table without rowids is one
range.  A column whose stored values are all of one class becomes a primitive
column, any other the dynamic struct.  The file has to be on a path that driver
and executors can open.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import NameFailure, NotADatabase
from ..functions.values import DYN_TYPE
from .catalog import affinity_of

_TYPES = {"integer": "bigint", "real": "double", "text": "string", "blob": "binary"}
_STORED = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "float": "REAL", "double": "REAL", "string": "TEXT", "binary": "BLOB"}


def connect(path: str) -> sqlite3.Connection:
    db = sqlite3.connect(f"file:{path.removeprefix('file://').removeprefix('file:')}?mode=ro&immutable=1", uri=True)
    try:
        db.execute("SELECT count(*) FROM sqlite_master").fetchone()
    except sqlite3.DatabaseError as e:
        db.close()
        raise NotADatabase(str(e)) from e
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    return db


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def describe(path: str, table: str) -> dict[str, Any]:
    """columns [(name, declared type, Spark type, not null)], rowid column or None, key column or None; looked up once for each state of the file."""
    told = os.stat(path.removeprefix("file://").removeprefix("file:"))
    return _described(path, table, told.st_mtime_ns, told.st_size)


@lru_cache(256)
def _described(path: str, table: str, changed: int, size: int) -> dict[str, Any]:
    db = connect(path)
    try:
        info = db.execute(f"PRAGMA table_info({_q(table)})").fetchall()
        if not info:
            raise NameFailure(f"no such table: {table}")
        try:
            db.execute(f"SELECT rowid FROM {_q(table)} LIMIT 1").fetchone()
            keyed = False
        except sqlite3.OperationalError:
            keyed = True
        classes = db.execute(f"SELECT {', '.join(f'group_concat(DISTINCT typeof({_q(c[1])}))' for c in info)} FROM {_q(table)}").fetchone()
        columns = []
        for c, found in zip(info, classes, strict=True):
            kinds = set((found or "").split(",")) - {"null", ""}
            own = affinity_of(c[2])
            default = {"INTEGER": "integer", "REAL": "real", "TEXT": "text"}.get(own)
            spark_type = _TYPES[kinds.pop()] if len(kinds) == 1 else _TYPES[default] if not kinds and default else DYN_TYPE
            columns.append((c[1], c[2], spark_type, bool(c[3])))
        key = next((c[1] for c in info if c[5] == 1 and c[2].upper() == "INTEGER" and sum(x[5] > 0 for x in info) == 1), None) if not keyed else None
        return {"columns": columns, "rowid": None if keyed else key or "_rowid_", "key": key}
    finally:
        db.close()


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None) -> None:
        self.low, self.high = low, high


def dynamic(v: Any) -> tuple | None:
    """A stored value as the struct's fields."""
    if v is None:
        return None
    if isinstance(v, int):
        return (1, float(v), False, v, None, None, False)
    if isinstance(v, float):
        return (1, v + 0.0, v >= 2.0**63, int(v) if abs(v) < 2.0**63 else None, None, None, True)
    return (2, None, False, None, v, None, False) if isinstance(v, str) else (3, None, False, None, None, bytes(v), False)


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, rows: int) -> None:
        self.path, self.table, self.rows = path, table, rows
        self.known = describe(path, table)

    def partitions(self) -> list[InputPartition]:
        if self.known["rowid"] is None:
            return [_Range(None, None)]
        db = connect(self.path)
        try:  # every so many rows a range begins, whatever gaps rowids have
            starts = [r[0] for r in db.execute(f"SELECT id FROM (SELECT rowid AS id, row_number() OVER (ORDER BY rowid) AS k FROM {_q(self.table)}) WHERE (k - 1) % ? = 0", (self.rows,))]
        finally:
            db.close()
        return [_Range(a, b - 1) for a, b in zip(starts, [*starts[1:], 1 << 63], strict=True)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        db = connect(self.path)
        try:
            names = [_q(c[0]) for c in self.known["columns"]] + (["rowid"] if self.known["rowid"] == "_rowid_" else [])
            where, args = ("", ()) if partition.low is None else (" WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
            mixed = [c[2] == DYN_TYPE for c in self.known["columns"]] + [False]
            for row in db.execute(f"SELECT {', '.join(names)} FROM {_q(self.table)}{where}", args):
                yield tuple(dynamic(v) if m else v for v, m in zip(row, mixed, strict=False))
        finally:
            db.close()


class DatabaseFile(DataSource):
    """``spark.read.format("dbfile").option("table", name).load(path)``; option ``rows``: rows to a task."""

    @classmethod
    def name(cls) -> str:
        return "dbfile"

    def schema(self) -> str:
        known = describe(self.options["path"], self.options["table"])
        return ", ".join([*[f"`{c[0]}` {c[2]}" for c in known["columns"]], *(["`_rowid_` bigint"] if known["rowid"] == "_rowid_" else [])])

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], int(self.options.get("rows", 200_000)))


def register_file(session: Any, path: str) -> None:
    """All tables of a file, with their declared types, collations of indexed keys left aside."""
    spark: SparkSession = session.spark
    spark.dataSource.register(DatabaseFile)
    db = connect(path)
    try:
        tables = db.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'").fetchall()
    finally:
        db.close()
    for name, sql in tables:
        known = describe(path, name)
        frame = spark.read.format("dbfile").option("table", name).load(path)
        session.register(name, frame, rowid=known["rowid"], declared={c[0]: c[1] for c in known["columns"]}, collations=collations(sql))
        table = session.catalog.table(name)
        table.sql = sql
        for c, (_, _, _, not_null) in zip(table.columns, known["columns"], strict=False):
            c.not_null = not_null


def collations(sql: str) -> dict[str, str]:
    """Columns declared with COLLATE, from a CREATE TABLE text."""
    from ..plans.lexer import tokenize, unquote

    out, depth, first = {}, 0, None
    for t, u in zip(tokens := tokenize(sql), tokens[1:], strict=False):
        if t.text == "(":
            depth += 1
            first = unquote(u) if depth == 1 else first
        elif t.text == ")":
            depth -= 1
        elif t.text == "," and depth == 1:
            first = unquote(u) if u.kind in ("word", "quoted", "string") else None
        elif t.upper == "COLLATE" and first:
            out[first] = unquote(u).upper()
    return out


def write_file(frames: dict[str, DataFrame], path: str, batch: int = 10_000) -> None:
    """DataFrames as tables of one new file: one writer, rows streamed through the driver a partition at a time."""
    db = sqlite3.connect(path)
    try:
        for name, frame in frames.items():
            kinds = dict(frame.dtypes)
            columns = ", ".join(f"{_q(c)} {_STORED.get(kinds[c], '')}".strip() for c in frame.columns)
            db.execute(f"CREATE TABLE {_q(name)} ({columns})")
            insert, rows = f"INSERT INTO {_q(name)} VALUES ({', '.join('?' * len(frame.columns))})", []
            for row in frame.toLocalIterator():
                rows.append([stored(v) for v in row])
                if len(rows) >= batch:
                    db.executemany(insert, rows)
                    rows.clear()
            db.executemany(insert, rows)
        db.commit()
    finally:
        db.close()


def stored(v: Any) -> Any:
    from ..session import plain

    v = plain(v)
    return v if v is None or isinstance(v, (int, float, str, bytes)) else str(v)


def inspect_pages(spark: SparkSession, path: str) -> DataFrame:
    """A row for each page: number, kind, cells, free bytes between cell pointers and cells, first free block, fragments, issue.

    From the public file format: a 100-byte header on page 1, then B-tree pages by
    their type byte; pages of other uses (overflow, free list) have kind ``other``.
    """
    kinds = {2: "index interior", 5: "table interior", 10: "index leaf", 13: "table leaf"}
    local = path.removeprefix("file://").removeprefix("file:")

    def page_size() -> int:
        with open(local, "rb") as f:
            head = f.read(100)
        if head[:16] != b"SQLite format 3\0":
            raise NotADatabase("file is not a database")
        size = int.from_bytes(head[16:18], "big")
        return 65536 if size == 1 else size

    size = page_size()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        with open(local, "rb") as f:
            for ids in batches:
                out = []
                for n in ids["id"].tolist():
                    f.seek((n - 1) * size)
                    page = f.read(size)
                    at = 100 if n == 1 else 0
                    kind = kinds.get(page[at]) if len(page) == size else None
                    if kind is None:
                        out.append((n, "other", None, None, None, None, None if len(page) == size else "short page"))
                        continue
                    cells = int.from_bytes(page[at + 3 : at + 5], "big")
                    start = int.from_bytes(page[at + 5 : at + 7], "big") or 65536
                    end = at + (12 if page[at] in (2, 5) else 8) + 2 * cells
                    issue = "cells overlap pointers" if start < end else "cell pointer out of page" if any(not end <= int.from_bytes(page[i : i + 2], "big") < size for i in range(end - 2 * cells, end, 2)) else None
                    out.append((n, kind, cells, start - end, int.from_bytes(page[at + 1 : at + 3], "big"), page[at + 7], issue))
                yield pd.DataFrame(out, columns=["page", "kind", "cells", "free", "first_free", "fragments", "issue"]).astype({"cells": "Int64", "free": "Int64", "first_free": "Int64", "fragments": "Int64"})

    pages = os.path.getsize(local) // size
    return spark.range(1, pages + 1).mapInPandas(run, "page long, kind string, cells long, free long, first_free long, fragments long, issue string")
