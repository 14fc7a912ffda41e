"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from . import lm_scoring, mixing, quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = s.doc_id
"""


def mixture(rounds: int = 400) -> str:
    """Raking by one factor for each side in turn, for as many rounds as any table here needs to stand still."""
    key = ", ".join(mixing.SIDES)
    n = len(mixing.SHAPE) + 1
    shapes = [f"f{i}" for i in range(n)]
    counts = [f"length(text) - length(translate(text, {_quoted(x)}, ''))" for x in mixing.SHAPE]
    rates = ", ".join(f"CAST(floor(1000.0::DOUBLE * ({c}) / greatest(length(text), 1)) AS BIGINT) AS f{i}" for i, c in enumerate([*counts, "n_tokens"]))
    parts = [
        f"""w AS (SELECT doc_id, coalesce(source, '{mixing.NONE}') AS source, coalesce(lang, '{mixing.NONE}') AS lang, coalesce(text, '') AS text, CAST(len({_words("coalesce(text, '')")}) AS BIGINT) AS n_tokens FROM documents)""",
        f"d AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens, {rates} FROM w)",
        f"k0 AS MATERIALIZED (SELECT {', '.join(shapes)}, row_number() OVER (ORDER BY md5(concat_ws(',', {', '.join(shapes)}))) - 1 AS k FROM (SELECT DISTINCT {', '.join(shapes)} FROM d) QUALIFY k < {mixing.TOPICS})",
    ]
    away = " + ".join(f"(d.{f} - k.{f}) * (d.{f} - k.{f})" for f in shapes)
    near = lambda i: f"n{i} AS MATERIALIZED (SELECT d.*, arg_min(k.k, ({away}) * {mixing.TOPICS} + k.k) AS k FROM d, k{i} AS k GROUP BY ALL)"
    parts[1] = parts[1].replace("SELECT doc_id", "SELECT row_number() OVER () AS row, doc_id", 1)
    for i in range(mixing.STEPS):
        moved = ", ".join(f"coalesce(m.{f}, o.{f}) AS {f}" for f in shapes)
        parts += [near(i), f"k{i + 1} AS MATERIALIZED (SELECT o.k, {moved} FROM k{i} AS o LEFT JOIN (SELECT k, {', '.join(f'sum({f}) // count(*) AS {f}' for f in shapes)} FROM n{i} GROUP BY k) AS m ON m.k = o.k)"]
    parts.append(near(mixing.STEPS))
    parts.append(f"t AS MATERIALIZED (SELECT doc_id, source, lang, 't' || k AS topic, n_tokens FROM n{mixing.STEPS})")
    parts.append(f"c AS MATERIALIZED (SELECT {key}, CAST(sum(n_tokens) AS DOUBLE) AS x FROM t GROUP BY {key})")
    for side in mixing.SIDES:
        wanted = mixing.TARGETS[side]
        parts.append(f"h_{side} AS (SELECT {side}, sum(x) / (SELECT sum(x) FROM c) AS h FROM c GROUP BY {side})")
        if isinstance(wanted, dict):
            weights = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in wanted.items())
            parts.append(f"v_{side} AS (SELECT {side}, h, w.v FROM h_{side} LEFT JOIN (VALUES {weights}) AS w(name, v) ON name = {side})")
            parts.append(f"s_{side} AS (SELECT {side}, CASE WHEN v IS NULL THEN h ELSE v * (1 - coalesce((SELECT sum(h) FROM v_{side} WHERE v IS NULL), 0)) / (SELECT sum(v) FROM v_{side}) END AS share_{side} FROM v_{side})")
        else:
            own = f"CASE WHEN h > 0 THEN pow(h, {wanted!r}::DOUBLE) ELSE 0 END"
            parts.append(f"s_{side} AS (SELECT {side}, {own} / (SELECT sum({own}) FROM h_{side}) AS share_{side} FROM h_{side})")
    joins = " ".join(f"JOIN s_{side} USING ({side})" for side in mixing.SIDES)
    goal = ", ".join(f"share_{side} * {mixing.BUDGET} * (SELECT sum(x) FROM c) AS goal_{side}" for side in mixing.SIDES)
    parts.append(f"r0 AS MATERIALIZED (SELECT {key}, x, {goal} FROM c {joins})")
    goals = ", ".join(f"goal_{side}" for side in mixing.SIDES)
    step = "r"
    for side in mixing.SIDES:
        step = f"(SELECT n, {key}, x, {goals}, u * coalesce(goal_{side} / nullif(sum(least(x, u)) OVER (PARTITION BY {side}), 0), 1) AS u FROM {step})"
    parts.append(f"r AS (SELECT 0 AS n, {key}, x, {goals}, x AS u FROM r0 UNION ALL SELECT n + 1, {key}, x, {goals}, u FROM {step} WHERE n < {rounds})")
    parts.append(f"e AS MATERIALIZED (SELECT {key}, x, {goals}, least(x, u) AS e FROM r WHERE n = {rounds})")
    errors = [f"max(abs(got_{side} - goal_{side}) / nullif(goal_{side}, 0))" for side in mixing.SIDES]
    got = ", ".join(f"sum(e) OVER (PARTITION BY {side}) AS got_{side}" for side in mixing.SIDES)
    parts.append(f"z AS (SELECT round(greatest({', '.join(errors)}), 6) AS residual FROM (SELECT *, {got} FROM e))")
    parts.append(f"y AS (SELECT {key}, e / (SELECT sum(e) FROM e) AS fitted, CASE WHEN x > 0 THEN e / x ELSE 0 END AS inclusion FROM e)")
    draw = f"CAST(CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / {16**13}.0::DOUBLE"
    return "WITH RECURSIVE " + ",\n".join(parts) + f"\nSELECT doc_id, {key}, n_tokens, round(fitted, 6) AS fitted, round(inclusion, 4) AS inclusion, {draw} < inclusion AS sampled, (SELECT residual FROM z) AS residual FROM t JOIN y USING ({key})"


def _quoted(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" if c < " " else f"'{c}'" for c in text) if "\n" in text else f"'{text}'"


def cross_entropy() -> str:
    """Both models by counting words and pairs; losses to six places."""
    prior, pull = f"{lm_scoring.PRIOR!r}::DOUBLE", f"{lm_scoring.PULL!r}::DOUBLE"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws,
           doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AS chosen FROM documents),
t AS MATERIALIZED (SELECT row, chosen, w, i, lag(w) OVER (PARTITION BY row ORDER BY i) AS p FROM (SELECT row, chosen, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d)),
one AS MATERIALIZED (SELECT w, CAST(count(*) AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE chosen) AS DOUBLE) AS t FROM t GROUP BY w),
two AS MATERIALIZED (SELECT p, w, CAST(count(*) AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE chosen) AS DOUBLE) AS t FROM t WHERE p IS NOT NULL GROUP BY p, w),
a AS (SELECT w, b, t, b / sum(b) OVER () AS ab, (t + {pull} * (b / sum(b) OVER ())) / (sum(t) OVER () + {pull}) AS at FROM one),
l AS (SELECT t.row, -log2(CASE WHEN t.p IS NULL THEN a.ab ELSE (two.b + {prior} * a.ab) / (q.b + {prior}) END) AS bl, -log2(CASE WHEN t.p IS NULL THEN a.at ELSE (two.t + {prior} * a.at) / (q.t + {prior}) END) AS tl
      FROM t JOIN a ON a.w = t.w LEFT JOIN two ON two.p = t.p AND two.w = t.w LEFT JOIN one AS q ON q.w = t.p),
m AS (SELECT row, avg(bl) AS bl, avg(tl) AS tl FROM l GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, round(tl, 6) AS target_loss, round(bl, 6) AS background_loss, round(coalesce(bl - tl, 0), 6) AS score FROM d LEFT JOIN m USING (row)
"""


def quality_rules(cutoff: float = quality.CUTOFF, steps: int = quality.STEPS, least: int = quality.LEAST) -> str:
    g, p = quality.GRID, len(quality.NAMES)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    some = lambda c, sep=", ": sep.join(f"{c}{i}" for i in range(p))
    counts = ("n_symbols", "n_dup_lines", "n_repeat_words")
    per = lambda c: f"ln(1 + 100.0::DOUBLE * {c} / greatest(n_words, 1))"
    logs = ["ln(CAST(greatest(word_chars, 1) AS DOUBLE) / greatest(n_words, 1))", *[per(c) for c in counts]]
    gram = "list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])"
    roots = ", ".join(f"l{i}{j}" for i, j in pairs)

    def cholesky(name: str, source: str) -> list[str]:
        """CTEs for the lower root of s00.. + the floors, and log_det, from ``source``."""
        out, last = [], source
        for i, j in pairs:
            rest = f"s{i}{j}" + f" + f{i}" * (i == j) + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            value = f"sqrt(greatest({rest}, 1e-9))" if i == j else f"({rest}) / l{j}{j}"
            out.append(f"{name}_{i}{j} AS (SELECT *, {value} AS l{i}{j} FROM {last})")
            last = f"{name}_{i}{j}"
        det = " + ".join(f"ln(l{i}{i})" for i in range(p))
        return [*out, f"{name} AS MATERIALIZED (SELECT gid, start, {some('m')}, {roots}, {some('f')}, 2 * ({det}) AS log_det FROM {last})"]

    def distance(name: str, est: str, rows: str, kind: str = "") -> list[str]:
        out, last = [], f"{rows} {kind} JOIN {est} USING (gid)"
        for i in range(p):
            rest = f"x{i} / {g}.0::DOUBLE - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i))
            out.append(f"{name}_{i} AS (SELECT *, ({rest}) / l{i}{i} AS y{i} FROM {last})")
            last = f"{name}_{i}"
        return [*out, f"{name} AS MATERIALIZED (SELECT *, {' + '.join(f'y{i} * y{i}' for i in range(p))} AS d2 FROM {last})"]

    def sums(c: str, cast: str = "DOUBLE") -> str:
        return ", ".join([*[f"CAST(sum({c}{i}) AS {cast}) AS t{i}" for i in range(p)], *[f"CAST(sum({c}{i} * {c}{j}) AS {cast}) AS t{i}{j}" for i, j in pairs]])

    def moments(n: str, total: Callable[[str], str], factor: float) -> str:
        means = [f"{total(f't{i}')} / {n} / {g} AS m{i}" for i in range(p)]
        spread = [f"({total(f't{i}{j}')} / {n} - ({total(f't{i}')} / {n}) * ({total(f't{j}')} / {n})) * {factor / g**2!r}::DOUBLE AS s{i}{j}" for i, j in pairs]
        return ", ".join([*means, *spread])

    parts = [
        rf"""w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS ws FROM documents)""",
        rf"""st AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
             CASE WHEN len(ws) < 3 THEN CAST([] AS VARCHAR[]) ELSE {gram} END AS gs FROM w)""",
        "gr AS (SELECT doc_id, unnest(gs) AS gram, unnest(range(1, len(gs) + 1)) AS i FROM st)",
        "tw AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM gr)",
        "cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM tw, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id)",
        "base AS (SELECT st.doc_id, lang, source, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM st LEFT JOIN cov ON cov.doc_id = st.doc_id)",
        f"told AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {', '.join(f'CAST(floor({e} * {g} + 0.5) AS BIGINT) AS x{i}' for i, e in enumerate(logs))} FROM base)",
        "sizes AS (SELECT lang, source, count(*) AS n FROM told WHERE NOT base_failed GROUP BY ALL)",
        f"grouped AS MATERIALIZED (SELECT told.*, CASE WHEN sizes.n >= {least} THEN 'g' || coalesce('=' || told.lang, '-') || chr(1) || coalesce('=' || told.source, '-') ELSE 'rest' END AS gid FROM told LEFT JOIN sizes ON told.lang IS NOT DISTINCT FROM sizes.lang AND told.source IS NOT DISTINCT FROM sizes.source)",
        "points AS (SELECT * FROM grouped WHERE NOT base_failed)",
    ]
    rank = lambda c, q: f"list_sort(list({c}))[CAST(ceil(count(*) * {q}::DOUBLE) AS BIGINT)]"
    cells = [f"{rank(f'x{i}', '0.5')} AS c{i}, ({rank(f'x{i}', '0.75')} - {rank(f'x{i}', '0.25')}) / {g}.0::DOUBLE AS r{i}" for i in range(p)]
    parts.append(f"med AS (SELECT gid, {', '.join(cells)}, CAST({rank('n_words', '0.5')} AS DOUBLE) AS nm FROM points GROUP BY gid)")
    floors = ", ".join(["1 / nm AS f0", *[f"pow(ln(1 + {100 * e}.0::DOUBLE / nm), 2) AS f{i + 1}" for i, e in enumerate(quality.EVENT)]])
    parts.append(f"wide AS MATERIALIZED (SELECT *, {', '.join(f'c{i} / {g}.0::DOUBLE AS m{i}' for i in range(p))}, {floors} FROM med)")
    s_of = lambda f: ", ".join(f"{f(i, j)} AS s{i}{j}" for i, j in pairs)
    parts.append(f"first AS (SELECT gid, 0 AS start, {some('m')}, {s_of(lambda i, j: f'pow(r{i} / 1.349::DOUBLE, 2)' if i == j else '0.0::DOUBLE')}, {some('f')} FROM wide)")
    parts.append(f"mom AS (SELECT gid, CAST(count(*) AS DOUBLE) AS n, {sums('x')} FROM points GROUP BY gid)")
    parts.append(f"second AS (SELECT gid, 1 AS start, {moments('n', lambda c: c, 1.0)}, {some('f')} FROM mom JOIN (SELECT gid, {some('f')} FROM wide) USING (gid))")
    parts.append(f"away AS (SELECT gid, {', '.join(f'x{i} - c{i} AS a{i}' for i in range(p))} FROM points JOIN wide USING (gid))")
    parts.append(f"norms AS (SELECT *, sqrt(CAST({' + '.join(f'a{i} * a{i}' for i in range(p))} AS DOUBLE)) AS norm FROM away)")
    parts.append(f"signs AS (SELECT gid, {', '.join(f'CAST(floor(a{i} / norm * {quality.SIGN} + 0.5) AS BIGINT) AS z{i}' for i in range(p))} FROM norms WHERE norm > 0)")
    parts.append(f"sg AS (SELECT gid, CAST(count(*) AS DOUBLE) AS n, {sums('z')} FROM signs GROUP BY gid)")
    parts.append(f"third AS (SELECT gid, 2 AS start, {some('m')}, {s_of(lambda i, j: f'coalesce(t{i}{j} / n / {quality.SIGN**2}, 0.0::DOUBLE)')}, {some('f')} FROM wide LEFT JOIN sg USING (gid))")
    parts.append("begin0 AS (SELECT * FROM first UNION ALL BY NAME SELECT * FROM second UNION ALL BY NAME SELECT * FROM third)")
    parts += cholesky("b0", "begin0")
    parts.append("e0 AS MATERIALIZED (SELECT * REPLACE ('inf'::DOUBLE AS log_det) FROM b0)")
    tops = [*[f"t{i}" for i in range(p)], *[f"t{i}{j}" for i, j in pairs]]
    for n in range(steps):
        parts += distance(f"d{n}", f"(SELECT * EXCLUDE ({some('f')}, log_det) FROM e{n})", f"(SELECT gid, {some('x')} FROM points)")
        inside = "upto <= half"
        split = ", ".join(f"coalesce(sum(CASE WHEN {inside} THEN {c} END), 0) AS {c}, coalesce(sum(CASE WHEN NOT {inside} THEN {c} END), 0) AS edge_{c}" for c in tops)
        parts += [
            f"c{n} AS (SELECT gid, start, floor(log2(d2 + {2.0**-20!r}::DOUBLE) * {quality.CELLS}) AS cell, count(*) AS n, {sums('x', 'BIGINT')} FROM d{n} GROUP BY ALL)",
            f"u{n} AS (SELECT *, sum(n) OVER (PARTITION BY gid, start ORDER BY cell) AS upto, floor((sum(n) OVER (PARTITION BY gid, start) + {p} + 1) / 2) AS half FROM c{n})",
            f"t{n} AS (SELECT gid, start, max(half) AS half, coalesce(max(CASE WHEN NOT {inside} THEN (half - upto + n) / n END), 0) AS part, {split} FROM u{n} WHERE upto - n < half GROUP BY ALL)",
            f"q{n} AS (SELECT gid, start, {moments('half', lambda c: f'(CAST({c} AS DOUBLE) + part * CAST(edge_{c} AS DOUBLE))', quality.CONSISTENT)} FROM t{n})",
            f"p{n} AS (SELECT * FROM q{n} JOIN (SELECT gid, start, {some('f')} FROM e{n}) USING (gid, start))",
        ]
        parts += cholesky(f"w{n}", f"p{n}")
        names = [*[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i, j in pairs], "log_det"]
        pick = ", ".join(f"CASE WHEN w.log_det < e.log_det - {quality.FALL!r} THEN w.{c} ELSE e.{c} END AS {c}" for c in names)
        parts.append(f"e{n + 1} AS MATERIALIZED (SELECT e.gid, e.start, {pick}, {', '.join(f'e.f{i}' for i in range(p))} FROM e{n} AS e JOIN w{n} AS w ON e.gid = w.gid AND e.start = w.start)")
    parts.append(f"est AS MATERIALIZED (SELECT gid, {some('m')}, {roots} FROM e{steps} QUALIFY row_number() OVER (PARTITION BY gid ORDER BY round(log_det, 7), start) = 1)")
    parts += distance("far", "est", "grouped", "LEFT")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND d2 <= {cutoff} AS kept, CASE WHEN NOT base_failed THEN round(d2, 6) END AS distance FROM far"
