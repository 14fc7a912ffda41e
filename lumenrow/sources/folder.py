"""Tables of a folder of Parquet files, and commits to it."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import IoFailure
from ..plans import ast
from ..plans.binder import Column
from .catalog import Index, Table

CATALOG, COMMIT = "_catalog.json", "_commit.json"


class Files:
    """The few file operations that commits need, by Spark's own file systems."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.jvm = spark, folder.rstrip("/"), spark.sparkContext._jvm
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at("")))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.at(old), self.at(new)):
            raise IoFailure(f"can't rename {old} to {new}")

    def read(self, name: str) -> Any:
        stream = self.fs.open(self.at(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, value: Any) -> None:
        """All of it or nothing: the name is there once the file is whole."""
        part = f".{name}-{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(part), True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        self.delete(name)
        self.rename(part, name)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def folder_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """name → DataFrame for each ``<name>.parquet`` below ``path``; the folder is listed by Spark's file system, so any store will do."""
    names = Files(spark, path).names()
    return {n.removesuffix(".parquet"): spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names if n.endswith(".parquet") and n[0] not in "._"}


class Store:
    """A folder that a session's commits are published to.

    A commit writes each changed table beside the old one, then a note of what is to be
    renamed: that note is the commit.  Renaming follows; if it's interrupted, opening the
    folder again finishes it.  Frames read before a commit have to be read anew after it.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.files = Files(spark, folder)
        if self.files.exists(COMMIT):
            self.finish(self.files.read(COMMIT))
        self.known: dict[str, DataFrame] = {}
        self.cookie = -1

    def load(self, session: Any) -> None:
        """Tables and indexes as they were declared, where the folder has been committed to."""
        spark, told = session.spark, self.files.read(CATALOG) if self.files.exists(CATALOG) else {"tables": {}, "indexes": []}
        for name, frame in folder_tables(spark, self.files.folder).items():
            t = told["tables"].get(name.lower())
            if t is None:
                session.register(name, frame)
            else:
                columns = [Column(**c | {"default": _expression(c["default"])}) for c in t["columns"]]
                session.catalog.state.tables[name.lower()] = Table(t["name"], columns, session.catalog.view_of(frame, name), frame, t["rowid"], t["sql"])
        for x in told["indexes"]:
            session.catalog.state.indexes[x["name"].lower()] = Index(x["name"], x["table"], tuple(map(tuple, x["terms"])), x["unique"], x["sql"])
        self.mark(session)

    def mark(self, session: Any) -> None:
        state = session.catalog.state
        self.known, self.cookie = {n: t.frame for n, t in state.tables.items()}, state.cookie

    def publish(self, session: Any) -> None:
        state = session.catalog.state
        changed = {n: t for n, t in state.tables.items() if self.known.get(n) is not t.frame}
        if not changed and state.cookie == self.cookie:
            return
        moves = {}
        for n, t in changed.items():
            staged = f".{n}-{uuid.uuid4().hex}.parquet"
            t.frame.write.parquet(f"{self.files.folder}/{staged}")
            moves[staged] = f"{t.name}.parquet"
        tables = {n: {"name": t.name, "rowid": t.rowid, "sql": t.sql, "columns": [_plain(c, session) for c in t.columns]} for n, t in state.tables.items()}
        indexes = [{"name": x.name, "table": x.table, "terms": x.terms, "unique": x.unique, "sql": x.sql} for x in state.indexes.values()]
        note = {"moves": moves, "catalog": {"tables": tables, "indexes": indexes}}
        self.files.write(COMMIT, note)
        self.finish(note)
        for n, t in changed.items():
            frame = session.spark.read.schema(t.frame.schema).parquet(f"{self.files.folder}/{t.name}.parquet")
            state.tables[n] = replace(t, frame=frame, view=session.catalog.view_of(frame, t.name), pending=0)
        self.mark(session)

    def finish(self, note: dict) -> None:
        for staged, name in note["moves"].items():
            if self.files.exists(staged):
                self.files.delete(name)
                self.files.rename(staged, name)
        self.files.write(CATALOG, note["catalog"])
        self.files.delete(COMMIT)


def _plain(c: Column, session: Any) -> dict:
    from ..plans.binder import Binder, Scope

    default = None
    if c.default is not None:
        value = Binder(session.catalog, {}).expr(c.default, Scope()).const
        default = {"hex": value.hex()} if isinstance(value, bytes) else {"value": value}
    return {**vars(c), "default": default}


def _expression(default: dict | None) -> Any:
    if default is None:
        return None
    return ast.Literal(bytes.fromhex(default["hex"]) if "hex" in default else default["value"])
