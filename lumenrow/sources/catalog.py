"""Tables by name: a Spark view for each version, and what the dialect knows of its columns."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import NameFailure
from ..functions.values import DYN_TYPE, Value
from ..plans.binder import Column

_KINDS = {T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int", T.BooleanType: "bool", T.FloatType: "real", T.DoubleType: "real", T.StringType: "text", T.BinaryType: "blob"}
_AFFINITY = {"int": "INTEGER", "bool": "INTEGER", "real": "REAL", "text": "TEXT", "blob": "BLOB", "dyn": "BLOB", "other": "BLOB"}
SCHEMA_TABLES = ("sqlite_schema", "sqlite_master")


def affinity_of(declared: str) -> str:
    """The affinity of a declared type; the first rule that fits holds."""
    up = declared.upper()
    if "INT" in up:
        return "INTEGER"
    if any(x in up for x in ("CHAR", "CLOB", "TEXT")):
        return "TEXT"
    if "BLOB" in up or not up:
        return "BLOB"
    if any(x in up for x in ("REAL", "FLOA", "DOUB")):
        return "REAL"
    return "NUMERIC"


def kind_of(type_: T.DataType) -> str:
    if isinstance(type_, T.StructType) and type_.simpleString() == DYN_TYPE:
        return "dyn"
    return _KINDS.get(type(type_), "other")


@dataclass
class Index:
    name: str
    table: str
    terms: tuple
    unique: bool
    sql: str = ""


@dataclass
class Table:
    name: str
    columns: list[Column]
    view: str
    frame: DataFrame
    rowid: str | None = None
    sql: str = ""
    version: int = 0
    pending: int = 0  # changes since the rows were last written out

    def column(self, name: str) -> Column:
        got = next((c for c in self.columns if c.name.lower() == name.lower()), None)
        if got is None:
            raise NameFailure(f"table {self.name} has no column named {name}")
        return got

    @property
    def key_column(self) -> Column | None:
        return next((c for c in self.columns if c.primary), None)


@dataclass
class State:
    """What a transaction saves: frames are immutable, so a copy of the dictionaries is a snapshot."""

    tables: dict[str, Table] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    cookie: int = 0

    def copy(self) -> State:
        return State(dict(self.tables), dict(self.indexes), self.cookie)


class Catalog:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.state = spark, State()

    def view_of(self, frame: DataFrame, name: str) -> str:
        view = f"lr_{''.join(c if c.isalnum() else '_' for c in name)}_{uuid.uuid4().hex[:12]}"
        frame.createOrReplaceTempView(view)
        return view

    def register(self, name: str, frame: DataFrame, collations: dict[str, str] | None = None, affinities: dict[str, str] | None = None, rowid: str | None = None, declared: dict[str, str] | None = None) -> Table:
        """Make a DataFrame a table.

        Narrow integers are read as they are and count as 64-bit ones.  ``rowid`` names a
        unique LONG column that the rowid pseudo-columns stand for; it's hidden from ``*``
        when it's called ``_rowid_``.
        """
        low = lambda d: {k.lower(): v for k, v in (d or {}).items()}
        collations, affinities, declared = low(collations), low(affinities), low(declared)
        columns = []
        for f in frame.schema.fields:
            kind = kind_of(f.dataType)
            own = f.name.lower()
            if rowid and own == rowid.lower() and own == "_rowid_":
                continue
            columns.append(Column(f.name, kind, affinities.get(own) or (affinity_of(declared[own]) if own in declared else _AFFINITY[kind]), collations.get(own), declared.get(own, f.dataType.simpleString()), primary=bool(rowid) and own == rowid.lower()))
        table = Table(name, columns, self.view_of(frame, name), frame, rowid, f"CREATE TABLE {name}({', '.join(f'{c.name} {c.declared}' for c in columns)})")
        self.state.tables[name.lower()] = table
        self.state.cookie += 1
        return table

    def table(self, name: str) -> Table:
        low = name.lower()
        if low in SCHEMA_TABLES:
            return self.schema_table()
        if low not in self.state.tables:
            raise NameFailure(f"no such table: {name}")
        return self.state.tables[low]

    def repeatable(self, name: str) -> bool:
        """Whether reading a table twice in one query gives the same rows, as far as Spark knows."""
        return self.table(name).frame._jdf.queryExecution().analyzed().deterministic()

    def schema_table(self) -> Table:
        rows = [("table", t.name, t.name, i + 2, t.sql) for i, t in enumerate(self.state.tables.values())]
        rows += [("index", x.name, self.state.tables[x.table.lower()].name, len(rows) + i + 2, x.sql) for i, x in enumerate(self.state.indexes.values())]
        frame = self.spark.createDataFrame(rows, "type string, name string, tbl_name string, rootpage bigint, sql string")
        columns = [Column(f.name, "int" if f.name == "rootpage" else "text", "INTEGER" if f.name == "rootpage" else "TEXT") for f in frame.schema.fields]
        return Table("sqlite_schema", columns, self.view_of(frame, "schema"), frame)

    def swap(self, table: Table, frame: DataFrame) -> Table:
        """A new version of a table."""
        new = replace(table, frame=frame, view=self.view_of(frame, table.name), version=table.version + 1)
        self.state.tables[table.name.lower()] = new
        return new

    def evaluate(self, v: Value) -> Any:
        return self.spark.sql(f"SELECT {v.sql} AS x").first().x
