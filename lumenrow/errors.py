"""Typed errors; ``code`` is the dialect's primary result code."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors; code 1 (generic error)."""

    code = 1


class SyntaxFailure(EngineError):
    """Text that isn't a statement of the dialect."""


class Unsupported(EngineError):
    """A construct that the dialect knows and this engine refuses."""


class NameFailure(EngineError):
    """Unknown or ambiguous tables, columns and functions, and wrong numbers of arguments."""


class Internal(EngineError):
    code = 2


class Denied(EngineError):
    code = 3


class Aborted(EngineError):
    code = 4


class Busy(EngineError):
    code = 5


class Locked(EngineError):
    code = 6


class OutOfMemory(EngineError):
    code = 7


class ReadOnly(EngineError):
    code = 8


class Interrupted(EngineError):
    code = 9


class IoFailure(EngineError):
    code = 10


class Corrupt(EngineError):
    code = 11


class NotFound(EngineError):
    code = 12


class Full(EngineError):
    code = 13


class CannotOpen(EngineError):
    code = 14


class Protocol(EngineError):
    code = 15


class SchemaChanged(EngineError):
    code = 17


class TooBig(EngineError):
    code = 18


class ConstraintFailure(EngineError):
    """NOT NULL, UNIQUE and primary key violations."""

    code = 19


class Mismatch(EngineError):
    """A value of the wrong type where only an integer will do."""

    code = 20


class Misuse(EngineError):
    code = 21


class NoLargeFiles(EngineError):
    code = 22


class Unauthorized(EngineError):
    code = 23


class BadFormat(EngineError):
    code = 24


class OutOfRange(EngineError):
    """A parameter number outside the statement's."""

    code = 25


class NotADatabase(EngineError):
    code = 26
