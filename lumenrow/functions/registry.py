"""The dialect's functions as builders of Spark SQL expressions; there are no UDFs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from ..errors import NameFailure
from . import values as V
from .values import Value

_DYN = "dyn"
AGGREGATES = {"count": (0, 1), "sum": (1, 1), "total": (1, 1), "avg": (1, 1), "min": (1, 1), "max": (1, 1), "group_concat": (1, 2), "string_agg": (2, 2)}


def _arity(name: str, args: list[Value], low: int, high: int | None) -> None:
    if len(args) < low or high is not None and len(args) > high:
        raise NameFailure(f"wrong number of arguments to function {name}()")


def typeof(args: list[Value]) -> Value:
    (v,) = args
    if v.kind == "dyn":
        return Value(V.let([v.sql], lambda d: f"CASE WHEN {d} IS NULL THEN 'null' WHEN {d}.k = 2 THEN 'text' WHEN {d}.k = 3 THEN 'blob' WHEN {d}.f THEN 'real' ELSE 'integer' END"), "text")
    name = {"int": "integer", "bool": "integer", "null": "null"}.get(v.kind, v.kind)
    return Value(f"IF({v.sql} IS NULL, 'null', '{name}')", "text")


def length(args: list[Value]) -> Value:
    (v,) = args
    text = lambda t: f"CAST(length(substring_index({t}, '\\u0000', 1)) AS BIGINT)"
    if v.kind == "blob":
        return Value(f"CAST(octet_length({v.sql}) AS BIGINT)", "int")
    if v.kind == "dyn":
        return Value(V.let([v.sql], lambda d: f"IF({d}.k = 3, CAST(octet_length({d}.b) AS BIGINT), {text(V.as_text(Value(d, 'dyn')))})"), "int")
    return Value(text(V.as_text(v)), "int")


def absolute(args: list[Value]) -> Value:
    (v,) = args
    if v.kind == "null":
        return v
    if v.kind in ("text", "blob"):
        return Value(f"abs({V.real_of(v)})", "real")
    if v.kind == "dyn":
        return Value(V.let([v.sql], lambda d: f"CASE WHEN {d} IS NULL THEN NULL WHEN {d}.k = 1 AND NOT {d}.f THEN {V.dyn_int(f'abs({d}.i)')} ELSE {V.let([f'abs({V.real_of(Value(d, _DYN))})'], V.dyn_real)} END"), "dyn")
    return Value(f"abs({v.sql if v.kind == 'real' else V.wide(v)})", "real" if v.kind == "real" else "int")


def sign(args: list[Value]) -> Value:
    (v,) = args
    if v.numeric:
        return Value(f"CAST(sign({V.as_int(v)}) AS BIGINT)", "int")
    n = V.number_if_whole(v)
    if n.kind in ("null", "blob") or n.kind == "text":
        return V.literal(None)
    if n.kind != "dyn":
        return sign([n])
    return Value(V.let([n.sql], lambda d: f"IF({d}.k = 1, CAST(sign({d}.r) AS BIGINT), NULL)"), "int")


def _case(source: str, to: str) -> Callable[[list[Value]], Value]:
    return lambda args: V.literal(None) if args[0].kind == "null" else Value(f"translate({V.as_text(args[0])}, '{source}', '{to}')", "text")


def nullif(args: list[Value]) -> Value:
    a, b = args
    plain = [replace(x, affinity=None) for x in args]
    return Value(f"IF(coalesce({V.compare('=', *plain).sql}, false), NULL, {V.shown(a).sql})", V.shown(a).kind)


def pick(args: list[Value], build: Callable[[list[str]], str]) -> Value:
    """One of several values: of their common kind."""
    kind = V.common_kind({a.kind for a in args})
    return Value(build([V.as_kind(a, kind) for a in args]), kind)


def coalesce(args: list[Value]) -> Value:
    return pick(args, lambda xs: f"coalesce({', '.join(xs)})")


def iif(args: list[Value]) -> Value:
    whens, rest = list(zip(args[::2], args[1::2], strict=False)), args[-1] if len(args) % 2 else V.literal(None)
    kind = V.common_kind({x.kind for _, x in whens} | {rest.kind})
    body = " ".join(f"WHEN {V.truth(c)} THEN {V.as_kind(x, kind)}" for c, x in whens)
    return Value(f"CASE {body} ELSE {V.as_kind(rest, kind)} END", kind)


def extreme(args: list[Value], greatest: bool) -> Value:
    """NULL if any is NULL; of equals the last for min and the first for max."""
    collation = next((a.collation for a in args if a.collation), None)
    kind = V.common_kind({a.kind for a in args})
    if kind == "null" or any(a.kind == "null" for a in args):
        return V.literal(None)
    name = "greatest" if greatest else "least"
    xs = [V.as_kind(a, kind) for a in args]
    none = " OR ".join(f"{x} IS NULL" for x in xs)
    if kind != "dyn" and not collation:
        return Value(f"IF({none}, NULL, {name}({', '.join(xs)}))", kind)
    turn = [str(-i) for i in range(len(xs))]
    rows = ", ".join(f"struct({V.key(Value(x, kind), collation)} AS y, {t} AS n, {x} AS v)" for x, t in zip(xs, turn, strict=True))
    best = "array_max" if greatest else "array_min"
    return Value(f"IF({none}, NULL, {best}(array({rows})).v)", kind)


_SCALARS = {"typeof", "length", "abs", "lower", "upper", "sign", "nullif", "coalesce", "ifnull", "iif", "if", "likely", "unlikely", "likelihood"}


def scalar_exists(name: str) -> bool:
    return name in _SCALARS


def scalar(name: str, args: list[Value]) -> Value | None:
    """The function's value, or None if there is no scalar function of this name."""
    if name in ("min", "max") and len(args) >= 2:
        return extreme(args, name == "max")
    simple: dict[str, tuple[int, int | None, Callable]] = {
        "typeof": (1, 1, typeof),
        "length": (1, 1, length),
        "abs": (1, 1, absolute),
        "lower": (1, 1, _case(V._UPPER, V._LOWER)),
        "upper": (1, 1, _case(V._LOWER, V._UPPER)),
        "sign": (1, 1, sign),
        "nullif": (2, 2, nullif),
        "coalesce": (2, None, coalesce),
        "ifnull": (2, 2, coalesce),
        "iif": (2, None, iif),
        "if": (2, None, iif),
        "likely": (1, 1, lambda a: replace(a[0], affinity=None)),
        "unlikely": (1, 1, lambda a: replace(a[0], affinity=None)),
        "likelihood": (2, 2, lambda a: replace(a[0], affinity=None)),
    }
    if name not in simple:
        return None
    low, high, build = simple[name]
    _arity(name, args, low, high)
    if name == "likelihood" and not (args[1].is_const and isinstance(args[1].const, float) and 0 <= args[1].const <= 1):
        raise NameFailure("second argument to likelihood() must be a constant between 0.0 and 1.0")
    return build(args)


def is_aggregate(name: str, count: int) -> bool:
    return name in AGGREGATES and not (name in ("min", "max") and count != 1)


def neumaier(collected: str) -> str:
    """A compensated sum of an array of doubles."""
    start = "named_struct('s', 0D, 'c', 0D)"
    step = "(a, x) -> named_struct('s', a.s + x, 'c', a.c + IF(abs(a.s) >= abs(x), (a.s - (a.s + x)) + x, (x - (a.s + x)) + a.s))"
    return f"aggregate({collected}, {start}, {step}, a -> IF(isnan(a.c) OR abs(a.s) = DOUBLE('Infinity'), a.s, a.s + a.c))"


def aggregate(name: str, args: list[Value], star: bool, distinct: bool, order: list[tuple[str, str]], where: str | None, exact: bool = False) -> Value:
    """An aggregate call; ``order``: (key expression, direction) of its own ORDER BY."""
    low, high = AGGREGATES[name]
    if not star:
        _arity(name, args, low, high)
    if distinct and len(args) != 1:
        raise NameFailure("DISTINCT aggregates must have exactly one argument")
    filtered = f" FILTER (WHERE {where})" if where else ""
    if name == "count" and not args:
        return Value(f"count(1){filtered}", "int")
    v = args[0]
    once = "DISTINCT " if distinct else ""
    folded = distinct and (v.kind == "dyn" or v.collation not in (None, "BINARY"))
    if folded and name not in ("min", "max"):
        return _over_distinct(name, v, args, order, filtered)
    if name == "count":
        return Value(f"count({once}{V.shown(v).sql}){filtered}", "int")
    if name in ("sum", "total", "avg"):
        if v.kind in ("text", "blob") and not v.is_const:
            v = V.number_of(v)
        if name == "sum" and v.kind == "null":
            return V.literal(None)
        if v.kind == "dyn" and name == "sum":
            whole = f"bool_and(NOT {v.sql}.f)" if re_simple(v.sql) else f"bool_and(NOT ({V.number_of(v).sql}).f)"
            n = V.number_of(v).sql
            return Value(f"IF({whole}{filtered}, {V.dyn_int(_in_range(f'sum(CAST(({n}).i AS DECIMAL(20,0))){filtered}'))}, {V.dyn_real(f'sum(({n}).r){filtered}')})", "dyn")
        if exact and v.kind == "real" and not distinct:
            total = f"IF(count({v.sql}){filtered} = 0, NULL, {neumaier(f'collect_list({v.sql}){filtered}')})"
            return Value({"sum": total, "total": f"coalesce({total}, 0D)", "avg": f"{total} / nullif(count({v.sql}){filtered}, 0)"}[name], "real")
        x = V.real_of(v) if name != "sum" or v.kind == "real" else V.as_int(v)
        if name == "sum":
            return Value(f"sum({once}{x}){filtered}", "real" if v.kind == "real" else "int")
        return Value(f"coalesce(sum({once}{x}){filtered}, 0D)" if name == "total" else f"avg({once}{x}){filtered}", "real")
    if name in ("min", "max"):
        if v.kind == "null":
            return V.literal(None)
        if v.kind == "dyn" or v.collation not in (None, "BINARY"):
            return Value(f"{name}_by({v.sql}, {V.key(v)}){filtered}", v.kind, collation=v.collation)
        return Value(f"{name}({V.shown(v).sql}){filtered}", V.shown(v).kind, collation=v.collation)
    return _concat(v, args[1] if len(args) > 1 else V.literal(","), distinct, order, filtered)


def re_simple(sql: str) -> bool:
    return all(c.isalnum() or c in "_.`" for c in sql)


def _in_range(total: str) -> str:
    """A decimal total as a 64-bit integer; beyond its range an error, as the dialect has it."""
    return V.let([f"({total})"], lambda t: f"IF({t} BETWEEN -9223372036854775808 AND 9223372036854775807, CAST({t} AS BIGINT), IF({t} IS NULL, NULL, CAST(raise_error('integer overflow') AS BIGINT)))")


def _over_distinct(name: str, v: Value, args: list[Value], order: list[tuple[str, str]], filtered: str) -> Value:
    """DISTINCT by a key that isn't the value itself."""
    if name == "count":
        return Value(f"count(DISTINCT {V.key(v)}){filtered}", "int")
    if v.kind == "dyn" and name in ("sum", "total", "avg"):
        keys = f"collect_set({V.key(v)}){filtered}"
        total = f"aggregate({keys}, 0D, (a, x) -> a + coalesce({V.real_of(Value('x', 'dyn'))}, 0D))"
        if name == "sum":
            whole = f"bool_and(NOT ({V.number_of(v).sql}).f){filtered}"
            exact = _in_range(f"aggregate({keys}, CAST(0 AS DECIMAL(38,0)), (a, x) -> CAST(a + IF(x.k = 1, x.i, coalesce({V.int_of(Value('coalesce(x.t, CAST(x.b AS STRING))', 'text'))}, 0L)) AS DECIMAL(38,0)))")
            return Value(f"IF(size({keys}) = 0, NULL, IF({whole}, {V.dyn_int(exact)}, {V.dyn_real(total)}))", "dyn")
        return Value(total if name == "total" else f"{total} / nullif(size({keys}), 0)", "real")
    return _concat(v, args[1] if len(args) > 1 else V.literal(","), True, order, filtered)


def _concat(v: Value, separator: Value, distinct: bool, order: list[tuple[str, str]], filtered: str) -> Value:
    """Texts joined in the given order, each with its own row's separator before it, the first one's left out.

    One fold over the group's sorted values; with DISTINCT the first of equal values in that order stays.
    """
    keys = [f"{k} AS k{i}" for i, (k, _) in enumerate(order)]
    t = V.as_text(v)
    same = V.key(v) if v.kind == "dyn" or v.collation else t
    body = ", ".join([*keys, f"{t} AS t", f"{V.as_text(separator)} AS s", f"{same} AS y"])
    rows = f"filter(collect_list(IF({V.shown(v).sql} IS NULL, NULL, struct({body}))){filtered}, e -> e IS NOT NULL)"
    if order:
        tests = []
        for i, (_, way) in enumerate(order):
            down, last = way.startswith("DESC"), way.endswith("LAST")
            tests += [f"WHEN l.k{i} IS NULL AND r.k{i} IS NOT NULL THEN {1 if last else -1}", f"WHEN r.k{i} IS NULL AND l.k{i} IS NOT NULL THEN {-1 if last else 1}"]
            tests += [f"WHEN l.k{i} < r.k{i} THEN {1 if down else -1}", f"WHEN l.k{i} > r.k{i} THEN {-1 if down else 1}"]
        rows = f"array_sort({rows}, (l, r) -> CASE {' '.join(tests)} WHEN l.t < r.t THEN -1 WHEN l.t > r.t THEN 1 ELSE 0 END)"
    if distinct and same == t:  # the separator is the comma, for DISTINCT takes one argument only
        texts = f"array_distinct(transform({rows}, e -> e.t))"
        return Value(V.let([texts], lambda x: f"IF(size({x}) = 0, NULL, array_join({x}, ','))"), "text")
    if distinct:
        rows = f"aggregate({rows}, CAST(array() AS ARRAY<STRUCT<t: STRING, s: STRING, y: {'STRING' if v.kind != 'dyn' else 'STRUCT<k: TINYINT, r: DOUBLE, o: BOOLEAN, i: BIGINT, t: STRING, b: BINARY>'}>>), (a, e) -> IF(exists(a, x -> x.y = e.y), a, array_append(a, struct(e.t AS t, e.s AS s, e.y AS y))))"
    joined = f"aggregate({rows}, CAST(NULL AS STRING), (a, e) -> IF(a IS NULL, e.t, concat(a, coalesce(e.s, ''), e.t)))"
    return Value(joined, "text")
