"""Syntax trees: plain data, compared by structure."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any  # None, int, float, str, bytes


@dataclass(frozen=True)
class Name:
    column: str
    table: str | None = None
    quoted: bool = False  # a double-quoted name that may turn out to be a string


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Param:
    number: int
    name: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str
    operand: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class InList:
    operand: Any
    items: tuple
    negated: bool


@dataclass(frozen=True)
class Collate:
    operand: Any
    collation: str


@dataclass(frozen=True)
class OrderTerm:
    expr: Any
    descending: bool = False
    nulls: str | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    star: bool = False
    distinct: bool = False
    order: tuple = ()
    where: Any = None


@dataclass(frozen=True)
class Subquery:
    query: Any
    exists: bool = False


@dataclass(frozen=True)
class Result:
    expr: Any
    alias: str | None
    text: str


@dataclass(frozen=True)
class Source:
    table: str
    alias: str | None
    kind: str = ""  # "" first, comma, cross, inner, left, right, full
    natural: bool = False
    on: Any = None
    using: tuple = ()


@dataclass(frozen=True)
class Core:
    results: tuple = ()
    sources: tuple = ()
    where: Any = None
    group: tuple = ()
    having: Any = None
    distinct: bool = False
    values: tuple = ()  # rows, for VALUES


@dataclass(frozen=True)
class Select:
    cores: tuple
    operators: tuple = ()  # between the cores: UNION, UNION ALL, INTERSECT, EXCEPT
    order: tuple = ()
    limit: Any = None
    offset: Any = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple
    row: tuple | None  # None: DEFAULT VALUES


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple  # (column, expression)
    where: Any


@dataclass(frozen=True)
class Delete:
    table: str
    where: Any


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    primary: bool = False
    not_null: bool = False
    default: Any = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple
    if_not_exists: bool


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    terms: tuple  # (column, collation, descending)
    unique: bool
    if_not_exists: bool


@dataclass(frozen=True)
class Analyze:
    target: str | None


@dataclass(frozen=True)
class Transaction:
    verb: str  # begin commit rollback savepoint release rollback-to
    name: str | None = None


@dataclass
class Statement:
    tree: Any
    params: list[str | None] = field(default_factory=list)  # names by number, from 1
    tail: int = 0
