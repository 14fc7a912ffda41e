"""Values of the dialect as Spark SQL expressions.

Every expression has a storage kind that is known when it's planned: ``int``
(LONG), ``real`` (DOUBLE), ``text`` (STRING), ``blob`` (BINARY), ``bool`` (a truth
value that counts as 1 or 0), ``null``, ``other`` (passed through only) or ``dyn``:
a struct for columns whose kind varies by row.

The struct's fields k, r, o, i, t, b compare field by field as the dialect orders
values: numbers before text before blobs; numbers by value, as doubles first
and then exactly.  f tells reals from integers and stays outside comparisons.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from typing import Any

from ..errors import NameFailure

DYN_TYPE = "struct<k:tinyint,r:double,o:boolean,i:bigint,t:string,b:binary,f:boolean>"
COLLATIONS = ("BINARY", "NOCASE", "RTRIM")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMBER = r"[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"
SPACE = r"[ \\t\\n\\x0b\\f\\r]*"


@dataclass(frozen=True)
class Value:
    sql: str
    kind: str
    affinity: str | None = None  # INTEGER REAL NUMERIC TEXT BLOB, for columns
    collation: str | None = None
    explicit: bool = False  # the collation was written with COLLATE
    const: Any = None  # a literal's value
    is_const: bool = False
    column: str | None = None  # the column's name, for result names

    @property
    def numeric(self) -> bool:
        return self.kind in ("int", "real", "bool")


def quote(text: str) -> str:
    """A Spark string literal."""
    out = []
    for c in text:
        if c in "\\'":
            out.append("\\" + c)
        elif c < " " or c == "\x7f":
            out.append(f"\\u{ord(c):04x}")
        else:
            out.append(c)
    return "'" + "".join(out) + "'"


def literal(value: Any) -> Value:
    if value is None or isinstance(value, float) and math.isnan(value):
        return Value("CAST(NULL AS BIGINT)", "null", const=None, is_const=True)
    if isinstance(value, bool):
        value = int(value)
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            return literal(float(value))
        sql = f"{value}L" if value > -(1 << 63) else "CAST('-9223372036854775808' AS BIGINT)"
        return Value(sql if value >= 0 or value == -(1 << 63) else f"({sql})", "int", const=value, is_const=True)
    if isinstance(value, float):
        return Value(f"CAST('{value!r}' AS DOUBLE)" if not math.isinf(value) else f"DOUBLE('{'-' if value < 0 else ''}Infinity')", "real", const=value, is_const=True)
    if isinstance(value, str):
        return Value(quote(value), "text", const=value, is_const=True)
    if isinstance(value, (bytes, bytearray, memoryview)):
        return Value(f"X'{bytes(value).hex()}'", "blob", const=bytes(value), is_const=True)
    raise NameFailure(f"can't bind a {type(value).__name__}")


# kinds as SQL


def as_int(v: Value) -> str:
    return f"CAST({v.sql} AS BIGINT)" if v.kind == "bool" else v.sql


def wide(v: Value) -> str:
    """As a 64-bit integer: what is computed never overflows a narrower column's type."""
    return v.sql if v.is_const else f"CAST({v.sql} AS BIGINT)"


def shown(v: Value) -> Value:
    """A truth value as the number that the dialect gives."""
    return replace(v, sql=as_int(v), kind="int") if v.kind == "bool" else v


def real_text(r: str) -> str:
    """A real as text, to 15 significant digits, always with a point or an exponent."""
    short = f"CAST(CAST(format_string('%.14e', {r}) AS DOUBLE) AS STRING)"
    plain = f"regexp_replace(regexp_replace(CAST(CAST({short} AS DECIMAL(38,20)) AS STRING), '0+$', ''), '\\\\.$', '.0')"
    exponent = f"regexp_replace(regexp_replace(regexp_replace({short}, 'E(-?)([0-9])$', 'E$10$2'), 'E([0-9])', 'E+$1'), 'E', 'e')"
    return f"CASE WHEN {r} IS NULL THEN NULL WHEN {r} = 0D THEN '0.0' WHEN abs({r}) = DOUBLE('Infinity') THEN IF({r} > 0D, 'Inf', '-Inf') WHEN abs({r}) >= 1e-4D AND abs({r}) < 1e15D THEN {plain} ELSE {exponent} END"


def as_text(v: Value) -> str:
    if v.kind == "text":
        return v.sql
    if v.kind in ("int", "bool"):
        return f"CAST({as_int(v)} AS STRING)"
    if v.kind == "real":
        return let([v.sql], lambda r: real_text(r))
    if v.kind == "blob":
        return f"CAST({v.sql} AS STRING)"
    if v.kind == "null":
        return "CAST(NULL AS STRING)"
    return let([dyn(v)], lambda d: f"CASE {d}.k WHEN 2 THEN {d}.t WHEN 3 THEN CAST({d}.b AS STRING) WHEN 1 THEN IF({d}.f, {real_text(d + '.r')}, CAST({d}.i AS STRING)) END")


_names = iter(range(1 << 62))


def let(parts: list[str], body: Any) -> str:
    """``body`` of names for ``parts``, each of which is computed once; subqueries, which Spark keeps out of lambdas and runs once anyway, stay as they are."""
    if any("(SELECT " in p for p in parts) or all(re.fullmatch(r"[\w.`]+|CAST\('?[^()']*'? AS \w+\)|-?[0-9]+L?", p) for p in parts):
        return body(*parts)
    name = f"v{next(_names)}"
    fields = ", ".join(f"{p} AS p{i}" for i, p in enumerate(parts))
    return f"element_at(transform(array(struct({fields})), {name} -> {body(*[f'{name}.p{i}' for i in range(len(parts))])}), 1)"


def _prefix(t: str) -> str:
    """The number that a text begins with, as text; empty if none."""
    return f"regexp_extract({t}, '^{SPACE}({NUMBER})', 1)"


def is_number_text(t: str) -> str:
    return f"({t} RLIKE '^{SPACE}{NUMBER}{SPACE}$')"


_WHOLE = r"'^[ \\t\\n\\x0b\\f\\r]*[+-]?[0-9]+[ \\t\\n\\x0b\\f\\r]*$'"


def real_of(v: Value) -> str:
    """As a double; text and blobs by the number they begin with, else 0."""
    if v.kind == "real":
        return v.sql
    if v.kind in ("int", "bool", "null"):
        return f"CAST({as_int(v)} AS DOUBLE)"
    if v.kind in ("text", "blob"):
        return let([as_text(v)], lambda t: f"IF({t} IS NULL, NULL, coalesce(try_cast({_prefix(t)} AS DOUBLE), 0D))")
    return let([dyn(v)], lambda d: f"CASE WHEN {d} IS NULL THEN NULL WHEN {d}.k = 1 THEN {d}.r ELSE coalesce(try_cast({_prefix(f'coalesce({d}.t, CAST({d}.b AS STRING))')} AS DOUBLE), 0D) END")


def int_of(v: Value) -> str:
    """As an integer: reals are cut towards zero and kept within 64 bits."""
    if v.kind in ("int", "bool", "null"):
        return wide(v)
    if v.kind == "dyn":
        return let([dyn(v)], lambda d: f"CASE WHEN {d} IS NULL THEN NULL WHEN {d}.k = 1 AND NOT {d}.f THEN {d}.i ELSE {_cut(real_of(replace(v, sql=d)))} END")
    return _cut(real_of(v)) if v.kind == "real" else let([as_text(v)], lambda t: f"coalesce(try_cast(regexp_extract({t}, '^{SPACE}([+-]?[0-9]+)(?![0-9.eE])', 1) AS BIGINT), {_cut(real_of(Value(t, 'text')))})")


def _cut(r: str) -> str:
    return let([r], lambda x: f"CASE WHEN {x} >= 9.223372036854775807E18D THEN 9223372036854775807L WHEN {x} <= -9.223372036854775808E18D THEN CAST('-9223372036854775808' AS BIGINT) ELSE CAST({x} AS BIGINT) END")


# the struct


def _struct(k: str, r: str = "CAST(NULL AS DOUBLE)", o: str = "false", i: str = "CAST(NULL AS BIGINT)", t: str = "CAST(NULL AS STRING)", b: str = "CAST(NULL AS BINARY)", f: str = "false") -> str:
    return f"named_struct('k', CAST({k} AS TINYINT), 'r', {r}, 'o', {o}, 'i', {i}, 't', {t}, 'b', {b}, 'f', {f})"


def dyn_real(r: str) -> str:
    return f"IF({r} IS NULL OR isnan({r}), NULL, {_struct('1', f'({r} + 0D)', f'({r} >= 9.223372036854775807E18D)', f'try_cast({r} AS BIGINT)', f='true')})"


def dyn_int(i: str) -> str:
    return f"IF({i} IS NULL, NULL, {_struct('1', f'CAST({i} AS DOUBLE)', 'false', i)})"


def dyn(v: Value) -> str:
    """As the struct."""
    if v.kind == "dyn":
        return v.sql
    if v.kind == "null":
        return f"CAST(NULL AS {DYN_TYPE})"
    if v.kind in ("int", "bool"):
        return let([wide(v)], dyn_int)
    if v.kind == "real":
        return let([v.sql], dyn_real)
    if v.kind == "text":
        return let([v.sql], lambda t: f"IF({t} IS NULL, NULL, {_struct('2', t=t)})")
    if v.kind == "blob":
        return let([v.sql], lambda b: f"IF({b} IS NULL, NULL, {_struct('3', b=b)})")
    raise NameFailure("a column of this type can only be passed through")


def fold(text: str, collation: str | None) -> str:
    if collation == "NOCASE":
        return f"translate({text}, '{_UPPER}', '{_LOWER}')"
    if collation == "RTRIM":
        return f"regexp_replace({text}, ' +$', '')"
    return text


def dyn_key(d: str, collation: str | None) -> str:
    return f"IF({d} IS NULL, NULL, named_struct('k', {d}.k, 'r', {d}.r, 'o', {d}.o, 'i', IF({d}.f AND {d}.r <> floor({d}.r), 0L, {d}.i), 't', {fold(d + '.t', collation)}, 'b', {d}.b))"


def key(v: Value, collation: str | None = None) -> str:
    """What grouping, ordering and equality go by."""
    collation = collation or v.collation
    if v.kind == "text":
        return fold(v.sql, collation)
    if v.kind == "dyn":
        return let([v.sql], lambda d: dyn_key(d, collation))
    if v.kind == "real":
        return f"({v.sql} + 0D)" if v.is_const else v.sql
    return as_int(v)


# coercion, comparison


def number_if_whole(v: Value) -> Value:
    """Text that is a number throughout becomes that number; other values stay."""
    if v.kind == "text" and v.is_const:
        got = whole_number(v.const)
        return v if got is None else literal(got)
    if v.kind == "text":
        sql = let([v.sql], lambda t: f"CASE WHEN {t} IS NULL THEN NULL WHEN {t} RLIKE {_WHOLE} AND try_cast(trim({t}) AS BIGINT) IS NOT NULL THEN {dyn_int(f'try_cast(trim({t}) AS BIGINT)')} WHEN {is_number_text(t)} THEN {dyn_real(f'try_cast(trim({t}) AS DOUBLE)')} ELSE {_struct('2', t=t)} END")
        return replace(v, sql=sql, kind="dyn", affinity=None)
    if v.kind == "dyn":
        inner = number_if_whole(Value("d__.t", "text")).sql
        return replace(v, sql=let([v.sql], lambda d: f"IF({d}.k = 2, {inner.replace('d__.t', d + '.t')}, {d})"))
    return v


def whole_number(text: str) -> int | float | None:
    t = text.strip(" \t\n\v\f\r")
    if re.fullmatch(r"[+-]?[0-9]+", t) and -(1 << 63) <= int(t) < 1 << 63:
        return int(t)
    if re.fullmatch(NUMBER.replace("\\\\", "\\"), t):
        return float(t)
    return None


def text_if_number(v: Value) -> Value:
    if v.numeric:
        return replace(v, sql=as_text(v), kind="text", is_const=False, affinity=None)
    if v.kind == "dyn":
        return replace(v, sql=let([v.sql], lambda d: f"IF({d}.k = 1, {_struct('2', t=as_text(Value(d, 'dyn')))}, {d})"))
    return v


def numeric_affinity(affinity: str | None) -> bool:
    return affinity in ("INTEGER", "REAL", "NUMERIC")


def coerced(a: Value, b: Value) -> tuple[Value, Value]:
    """Both sides of a comparison after their affinities have acted."""
    x, y = a.affinity, b.affinity
    if x and y:
        use = "NUMERIC" if numeric_affinity(x) or numeric_affinity(y) else None
    else:
        use = x or y
    if numeric_affinity(use):
        return number_if_whole(a), number_if_whole(b)
    if use == "TEXT":
        return text_if_number(a), text_if_number(b)
    return a, b


def collation_of(a: Value, b: Value) -> str | None:
    """The written collation, left first; else a column's, left first."""
    for v in (a, b):
        if v.explicit:
            return v.collation
    for v in (a, b):
        if v.collation or v.column:
            return v.collation
    return None


_RANK = {"int": 1, "real": 1, "bool": 1, "text": 2, "blob": 3}
_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "=", "<>": "<>"}


def compare(op: str, a: Value, b: Value) -> Value:
    """= <> < <= > >= IS, IS NOT as a truth value."""
    collation = collation_of(a, b)
    a, b = coerced(a, b)
    if op in ("IS", "IS NOT"):
        if b.kind == "null" and b.is_const:
            return Value(f"({a.sql} IS {'NOT ' * (op == 'IS NOT')}NULL)", "bool")
        same = _same_kind(a, b, collation)
        sql = f"({same[0]} <=> {same[1]})" if same else f"({a.sql} IS NULL AND {b.sql} IS NULL)"
        return Value(sql if op == "IS" else f"(NOT {sql})", "bool")
    if a.kind == "null" or b.kind == "null":
        return Value("CAST(NULL AS BOOLEAN)", "bool")
    exact = _exact(op, a, b) or (_exact(_FLIP[op], b, a))
    if exact:
        return Value(exact, "bool")
    same = _same_kind(a, b, collation)
    if same:
        return Value(f"({same[0]} {op} {same[1]})", "bool")
    truth = {"=": False, "<>": True, "<": _RANK[a.kind] < _RANK[b.kind], "<=": _RANK[a.kind] < _RANK[b.kind]}
    truth |= {">": not truth["<"], ">=": not truth["<"]}
    return Value(f"IF({a.sql} IS NULL OR {b.sql} IS NULL, NULL, {str(truth[op]).lower()})", "bool")


def is_key(op: str, a: Value, b: Value) -> bool:
    """Whether ``compare`` gives an equality of one expression a side, by which Spark joins."""
    a, b = coerced(a, b)
    if op not in ("=", "IS") or "null" in (a.kind, b.kind) or op == "=" and (_exact(op, a, b) or _exact(op, b, a)):
        return False
    return _same_kind(a, b, None) is not None


def _exact(op: str, a: Value, b: Value) -> str | None:
    """An integer expression against a real constant, as integers, so that the filter can be pushed down; integers against reals by value."""
    if a.kind not in ("int", "bool") or b.kind != "real":
        return None
    x = as_int(a)
    if b.is_const and math.isfinite(b.const) and abs(b.const) < 2**62:
        low = math.floor(b.const)
        if low == b.const:
            return f"({x} {op} {low}L)"
        fixed = {"=": "false", "<>": "true"}.get(op)
        if fixed:
            return f"IF({x} IS NULL, NULL, {fixed})"
        return f"({x} {'<=' if op in ('<', '<=') else '>'} {low}L)"

    def body(x: str, r: str) -> str:
        d, whole = f"CAST({x} AS DOUBLE)", f"try_cast({r} AS BIGINT)"
        beyond = {"=": "false", "<>": "true", "<": "true", "<=": "true", ">": "false", ">=": "false"}[op]  # above every integer
        if op in ("=", "<>"):
            test = f"({d} = {r} AND {x} = {whole})"
            test = test if op == "=" else f"(NOT {test})"
        else:
            test = f"({d} {op[0]} {r} OR ({d} = {r} AND {x} {op} {whole}))"
        return f"CASE WHEN {x} IS NULL OR {r} IS NULL THEN NULL WHEN {r} >= 9.223372036854775807E18D THEN {beyond} ELSE {test} END"

    return let([x, b.sql], body)


def _same_kind(a: Value, b: Value, collation: str | None) -> tuple[str, str] | None:
    if a.kind == "null" and b.kind != "null":
        return key(replace(a, sql=f"CAST(NULL AS {_type(b)})", kind=b.kind), collation), key(b, collation)
    if b.kind == "null" and a.kind != "null":
        return key(a, collation), key(replace(b, sql=f"CAST(NULL AS {_type(a)})", kind=a.kind), collation)
    if "dyn" in (a.kind, b.kind):
        return (key(Value(dyn(a), "dyn"), collation), key(Value(dyn(b), "dyn"), collation))
    if a.numeric and b.numeric:
        if "real" in (a.kind, b.kind):
            return real_of(a), real_of(b)
        return as_int(a), as_int(b)
    if a.kind == b.kind:
        return key(a, collation or "BINARY"), key(b, collation or "BINARY")
    return None


def _type(v: Value) -> str:
    return {"int": "BIGINT", "bool": "BIGINT", "null": "BIGINT", "real": "DOUBLE", "text": "STRING", "blob": "BINARY", "dyn": DYN_TYPE}[v.kind]


def truth(v: Value) -> str:
    """As a Spark boolean."""
    if v.kind == "bool":
        return v.sql
    if v.kind == "null":
        return "CAST(NULL AS BOOLEAN)"
    if v.kind == "int":
        return f"({v.sql} <> 0L)"
    return f"({real_of(v)} <> 0D)"


# arithmetic


def number_of(v: Value) -> Value:
    """Text and blobs by the number they begin with."""
    if v.kind in ("text", "blob"):
        if v.is_const:
            m = re.match(r"[ \t\n\v\f\r]*(" + NUMBER.replace("\\\\", "\\") + ")", v.const if isinstance(v.const, str) else v.const.decode("utf-8", "replace"))
            return literal(whole_number(m[1]) if m else 0)
        t = as_text(v)
        return Value(let([t], lambda t: f"IF({t} IS NULL, NULL, {let([_prefix(t)], lambda p: f'IF(try_cast({p} AS BIGINT) IS NOT NULL OR {p} = \'\', {dyn_int(f"coalesce(try_cast({p} AS BIGINT), 0L)")}, {dyn_real(f"try_cast({p} AS DOUBLE)")})')})"), "dyn")
    if v.kind == "dyn":
        inner = number_of(Value("d__", "text")).sql
        return Value(let([v.sql], lambda d: f"CASE WHEN {d}.k = 1 THEN {d} WHEN {d} IS NOT NULL THEN {let([f'coalesce({d}.t, CAST({d}.b AS STRING))'], lambda t: inner.replace('d__', t))} END"), "dyn")
    return v


def arithmetic(op: str, a: Value, b: Value) -> Value:
    a, b = number_of(a), number_of(b)
    if a.kind == "null" or b.kind == "null":
        return literal(None)
    if "dyn" in (a.kind, b.kind):
        return _dyn_arithmetic(op, a, b)
    if a.is_const and b.is_const:
        return literal(fold_numbers(op, a.const, b.const))
    if op == "%":
        x, y = int_of(a), int_of(b)
        sql = let([x, y], lambda p, q: f"IF({q} = 0L, NULL, {p} % {q})")
        return Value(f"CAST({sql} AS DOUBLE)", "real") if "real" in (a.kind, b.kind) else Value(sql, "int")
    if "real" in (a.kind, b.kind):
        x, y = real_of(a), real_of(b)
        if op == "/":
            return Value(let([x, y], lambda p, q: f"IF({q} = 0D, NULL, {p} / {q})"), "real")
        return Value(f"({x} {op} {y})", "real")
    x, y = wide(a), wide(b)
    if op == "/":
        if b.is_const and b.const not in (0, -1):
            return Value(f"({x} DIV {y})", "int")
        return Value(let([x, y], lambda p, q: f"IF({q} = 0L, NULL, {p} DIV {q})"), "int")
    return Value(f"({x} {op} {y})", "int")


def fold_numbers(op: str, a: Any, b: Any) -> Any:
    if op == "%":
        x, y = (max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in (a, b))
        out = None if y == 0 else int(math.fmod(x, y)) if abs(x) < 1 << 53 else abs(x) % abs(y) * (1 if x >= 0 else -1)
        return float(out) if out is not None and isinstance(a + b, float) else out
    if op == "/":
        if b == 0:
            return None
        if isinstance(a, int) and isinstance(b, int):
            return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return a / b
    return {"+": a + b, "-": a - b, "*": a * b}[op] if isinstance(a, int) and isinstance(b, int) else {"+": float(a) + b, "-": float(a) - b, "*": float(a) * b}[op]


def _dyn_arithmetic(op: str, a: Value, b: Value) -> Value:
    tried = {"+": "try_add", "-": "try_subtract", "*": "try_multiply"}

    def body(x: str, y: str) -> str:
        ints = f"(NOT {x}.f AND NOT {y}.f)"
        if op == "%":
            p, q = int_of(Value(x, "dyn")), int_of(Value(y, "dyn"))
            m = let([p, q], lambda p, q: f"IF({q} = 0L, NULL, {p} % {q})")
            return let([m], lambda m: f"IF({ints}, {dyn_int(m)}, {dyn_real(f'CAST({m} AS DOUBLE)')})")
        if op == "/":
            return f"CASE WHEN {y}.r = 0D THEN NULL WHEN {ints} AND NOT ({y}.i = -1L AND {x}.i = CAST('-9223372036854775808' AS BIGINT)) THEN {dyn_int(f'({x}.i DIV {y}.i)')} ELSE {dyn_real(f'({x}.r / {y}.r)')} END"
        exact = f"{tried[op]}({x}.i, {y}.i)"
        return f"CASE WHEN {ints} AND {exact} IS NOT NULL THEN {dyn_int(exact)} ELSE {dyn_real(f'({x}.r {op} {y}.r)')} END"

    return Value(let([dyn(a), dyn(b)], lambda x, y: f"IF({x} IS NULL OR {y} IS NULL, NULL, {body(x, y)})"), "dyn")


def negate(v: Value) -> Value:
    v = number_of(v)
    if v.kind == "null":
        return v
    if v.is_const:
        return literal(-v.const)
    if v.kind == "dyn":
        return _dyn_arithmetic("-", literal(0), v)
    return Value(f"(- {v.sql})", "real") if v.kind == "real" else Value(f"(- {wide(v)})", "int")


def bits(op: str, a: Value, b: Value) -> Value:
    x, y = int_of(a), int_of(b)
    if a.kind == "null" or b.kind == "null":
        return literal(None)
    if op in "&|":
        return Value(f"({x} {op} {y})", "int")

    def shift(p: str, q: str) -> str:
        left = "(" + q + " >= 0L)" if op == "<<" else "(" + q + " < 0L)"
        n = f"CAST(least(abs(greatest({q}, -64L)), 64L) AS INT)"
        return f"CASE WHEN {p} IS NULL OR {q} IS NULL THEN NULL WHEN {left} THEN IF({n} >= 64, 0L, shiftleft({p}, {n})) ELSE IF({n} >= 64, IF({p} < 0L, -1L, 0L), shiftright({p}, {n})) END"

    return Value(let([x, y], shift), "int")


def invert(v: Value) -> Value:
    return literal(None) if v.kind == "null" else Value(f"(~ {int_of(v)})", "int")


def join_text(a: Value, b: Value) -> Value:
    if a.kind == "null" or b.kind == "null":
        return Value("CAST(NULL AS STRING)", "text")
    return Value(f"concat({as_text(a)}, {as_text(b)})", "text")


def common_kind(kinds: set[str]) -> str:
    """The kind that holds values of several: reals hold integers only where that loses no meaning, so mixtures are dynamic."""
    kinds = {"int" if k == "bool" else k for k in kinds if k != "null"}
    if not kinds:
        return "null"
    return kinds.pop() if len(kinds) == 1 else "dyn"


def as_kind(v: Value, kind: str) -> str:
    if kind == "dyn":
        return dyn(v)
    if v.kind == "null":
        return f"CAST(NULL AS {_type(Value('', kind))})"
    if kind == "real" and v.kind in ("int", "bool"):
        return f"CAST({as_int(v)} AS DOUBLE)"
    return as_int(v)
