"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are counted in cells of (source, language, topic).  Raking finds a factor for
each category so that expected tokens, at most a cell's own, meet the targets of all
three sides; a document is drawn with its cell's expected over own tokens.  A draw is a
fixed number made from the document's id, so it doesn't depend on partitions or order.

Sources may be many, hosts say: each is one row that holds its cells, and its factor is
fitted inside the row, in each round.  Languages and topics are few: their factors are
the driver's.  Fitting them in turn, each as if the others stood still, takes many rounds
where cells are taken whole; so a round's aggregation tells how each marginal answers to
each factor, with the sources fitted again, and all are fitted at once (Newton's step for
raking; Deville and Sarndal, 1992).  Rounds go on until the largest relative error of a
marginal is below the tolerance; the error that is left is reported.

Topics are those of a column, or the nearest of a few centres of the texts' shape, found
by Lloyd's steps in whole numbers.
"""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard
from .quality import statistics

SIDES = ("source", "lang", "topic")
NONE = "(none)"
#: Shares by side: weights of named categories, or the power of the natural shares (0: equal shares).
#: Categories that aren't named keep their natural share; the named ones that are there share the rest by weight.
TARGETS: dict[str, dict[str, float] | float] = {"source": 0.0, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": 0.9}
BUDGET, SEED, TOLERANCE = 0.4, "mix", 1e-9
#: Raking stops after so many rounds without a better error, or so many in all: targets that can't be met keep an error.
PATIENCE, ROUNDS = 8, 60
TOPICS, STEPS = 4, 8
#: Characters that a text's shape is told by, each a rate in a thousand; beside them words in a thousand characters.
SHAPE = ("0123456789", ".,;:", "!?", "#*$%&|<>{}[]=", "\n")


def shape(text: Column, tokens: Column) -> list[Column]:
    """Whole numbers from 0 to 1000."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    counts = [F.regexp_count(text, F.lit(f"[{re.escape(letters)}]")) for letters in SHAPE]  # one call for each rate: chains of replacements make methods that take the compiler much memory
    return [F.floor(1000 * c / size).cast("long") for c in [*counts, tokens]]


def topics(rows: DataFrame, shapes: list[str]) -> Column:
    """The nearest centre's name; ``rows`` are read once for each step, and the driver gets the centres only.

    Centres begin at the distinct shapes with the least digests; one without rows stays; of equally near ones the first wins.
    """
    digest = F.md5(F.concat_ws(",", *shapes))
    centres = [tuple(r) for r in rows.select(*shapes).distinct().orderBy(digest).limit(TOPICS).collect()]

    def nearest() -> Column:
        away = [sum(((F.col(s) - x) * (F.col(s) - x) for s, x in zip(shapes, c, strict=True)), F.lit(0)) for c in centres]
        out = F.lit(len(away) - 1)
        for i in range(len(away) - 2, -1, -1):
            out = F.when(away[i] <= F.least(*away[i:], F.lit(1 << 62)), i).otherwise(out)
        return out

    for _ in range(STEPS):
        if not centres:
            break
        sums = rows.groupBy(nearest().alias("i")).agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in shapes]).collect()
        moved = list(centres)
        for r in sums:
            moved[r["i"]] = tuple(r[s] // r["n"] for s in shapes)
        if moved == centres:
            break
        centres = moved
    return F.concat(F.lit("t"), nearest().cast("string")) if centres else F.lit("t0")


def shares(natural: dict[str, float], wanted: dict[str, float] | float | None) -> dict[str, float]:
    """Target shares of the categories that are there, from their natural ones."""
    if isinstance(wanted, dict):
        named = {k: wanted[k] for k in natural if k in wanted}
        rest = 1 - sum(v for k, v in natural.items() if k not in named)
        whole = sum(named.values())
        return {k: rest * named[k] / whole if k in named and whole else v for k, v in natural.items()}
    own = {k: v ** (1.0 if wanted is None else wanted) if v else 0.0 for k, v in natural.items()}
    whole = sum(own.values())
    return {k: v / whole if whole else 0.0 for k, v in own.items()}


def _source_targets(sources: DataFrame, wanted: dict[str, float] | float | None, tokens: int) -> DataFrame:
    """``sources`` (source, tokens and others) with ``share``; the driver gets sums only, for sources may be many."""
    if isinstance(wanted, dict):
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]), F.col("source")), F.lit(0.0)) if wanted else F.lit(0.0)
        named = F.col("source").isin(list(wanted))
        r = sources.agg(F.sum(F.when(named, weight)).alias("whole"), F.sum(F.when(~named, F.col("tokens"))).alias("rest")).first()
        rest = 1 - (r["rest"] or 0) / tokens
        return sources.withColumn("share", F.when(named & F.lit(bool(r["whole"])), weight * (rest / (r["whole"] or 1.0))).otherwise(F.col("tokens") / tokens))
    own = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(1.0 if wanted is None else float(wanted)))).otherwise(0.0)
    return sources.withColumn("share", own / (sources.agg(F.sum(own).alias("w")).first()["w"] or 1.0))


def solve(rows: list[list[float]], right: list[float]) -> list[float]:
    """x with rows x = right, by elimination; 0 where nothing holds x."""
    n, rows = len(right), [[*row, x] for row, x in zip(rows, right, strict=True)]
    for i in range(n):
        top = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[top] = rows[top], rows[i]
        for k in range(i + 1, n):
            if rows[i][i] and rows[k][i]:
                f = rows[k][i] / rows[i][i]
                rows[k] = [a - f * b for a, b in zip(rows[k], rows[i], strict=True)]
    out = [0.0] * n
    for i in reversed(range(n)):
        rest = rows[i][n] - sum(rows[i][j] * out[j] for j in range(i + 1, n))
        out[i] = rest / rows[i][i] if rows[i][i] else 0.0
    return out


def rake(cells: DataFrame, targets: dict[str, Any], budget: float, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[DataFrame, float, int]:
    """(source, lang, topic, tokens, expected), the largest relative error of a marginal, and the rounds it took.

    ``cells``: source, lang, topic, tokens.  Expected tokens add up to ``budget`` of all
    as far as targets can be met with no more than a cell has.
    """
    sides = {side: {r[0]: r[1] for r in cells.groupBy(side).agg(F.sum("tokens")).orderBy(side).collect()} for side in SIDES[1:]}
    tokens = sum(sides["lang"].values())
    if not tokens:
        return cells.withColumn("expected", F.lit(0.0)), 0.0, 0
    names = {side: list(sums) for side, sums in sides.items()}
    wanted = {side: list(shares({k: v / tokens for k, v in sums.items()}, targets.get(side)).values()) for side, sums in sides.items()}
    wanted = {side: [x * budget * tokens for x in own] for side, own in wanted.items()}
    n_topics = len(names["topic"])
    place = lambda side: F.array_position(F.array(*[F.lit(x) for x in names[side]]), F.col(side)) - 1
    packed = cells.withColumn("at", (place("lang") * n_topics + place("topic")).cast("int"))
    sources = packed.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("cells"), F.sum("tokens").alias("tokens"))
    sources = cut(_source_targets(cut(sources, "sources"), targets.get("source"), tokens).withColumn("target", F.col("share") * (budget * tokens)).drop("share"), "targets")
    factors = {side: [1.0] * len(own) for side, own in names.items()}

    def solved() -> DataFrame:
        """``sources`` with ``e``: the expected tokens of each cell, when each source's factor meets its target."""
        weights = [b * c for b in factors["lang"] for c in factors["topic"]]
        told = sources.withColumn("__w", F.array(*[F.lit(w) for w in weights]))
        told = told.withColumn("__x", F.expr("array_sort(transform(cells, x -> named_struct('w', __w[x.at], 'x', x.tokens)))"))
        # from the cell with the least weight on: it and those before it in proportion, those after it whole
        step = "named_struct('some', s.some + x.w * x.x, 'left', s.left - x.x, 'a', IF(s.some + x.w * x.x > 0 AND target > s.left - x.x AND (target - s.left + x.x) / (s.some + x.w * x.x) * x.w <= 1, (target - s.left + x.x) / (s.some + x.w * x.x), s.a))"
        told = told.withColumn("__a", F.expr(f"IF(target <= 0, 0D, aggregate(__x, named_struct('some', 0D, 'left', tokens, 'a', 1E300D), (s, x) -> {step}).a)"))
        return told.withColumn("e", F.expr("transform(cells, x -> named_struct('at', x.at, 'tokens', x.tokens, 'e', least(double(x.tokens), __a * __w[x.at] * x.tokens)))")).drop("__w", "__x", "__a")

    n_langs, n = len(names["lang"]), len(names["lang"]) + n_topics
    want = [*wanted["lang"], *wanted["topic"]]

    def round_sums() -> tuple[list[float], list[list[float]], float]:
        """Expected tokens of each language and topic; how they answer to their factors' logarithms, when sources meet their targets again; the sources' largest error."""
        told = solved().withColumn("__p", F.expr(f"transform(e, x -> named_struct('l', x.at div {n_topics}, 't', {n_langs} + x.at % {n_topics}, 'e', x.e, 'f', IF(x.e < x.tokens, x.e, 0D)))"))
        told = told.withColumn("__y", F.expr(f"transform(sequence(0, {n - 1}), i -> aggregate(__p, 0D, (s, x) -> s + IF(x.l = i OR x.t = i, x.f, 0D)))"))
        told = told.withColumn("__r", F.expr("aggregate(__p, 0D, (s, x) -> s + x.f)")).withColumn("__i", F.expr(f"filter(sequence(0, {n - 1}), i -> __y[i] > 0)"))
        row = lambda i, j, v: f"transform(__p, x -> named_struct('i', int({i}), 'j', int({j}), 'v', {v}))"
        own = [row(i, j, "x.f") for i in ("x.l", "x.t") for j in ("x.l", "x.t")]
        back = "flatten(transform(__i, i -> transform(__i, j -> named_struct('i', i, 'j', j, 'v', -__y[i] * __y[j] / __r))))"
        told = told.select("target", F.expr("aggregate(__p, 0D, (s, x) -> s + x.e)").alias("got"), F.explode(F.expr(f"concat({', '.join([row('x.l', -1, 'x.e'), row('x.t', -1, 'x.e'), *own, back])})")).alias("x"))
        off = F.when(F.col("target") > 0, F.abs(F.col("got") - F.col("target")) / F.col("target"))
        got, slopes, error = [0.0] * n, [[0.0] * n for _ in range(n)], 0.0
        for r in told.groupBy("x.i", "x.j").agg(F.sum("x.v").alias("v"), F.max(off).alias("off")).collect():
            error = max(error, r["off"] or 0.0)
            if r["j"] < 0:
                got[r["i"]] = r["v"]
            else:
                slopes[r["i"]][r["j"]] = r["v"]
        return got, slopes, error

    turn, best, since = 0, float("inf"), 0
    most, last = [1.0] * n, [0.0] * n  # a factor whose error changes sign takes half the step at most: cells taken whole answer to nothing
    while True:
        got, slopes, error = round_sums()
        error = max([error, *(abs(g - t) / t for g, t in zip(got, want, strict=True) if t > 0)])
        turn, since = turn + 1, 0 if error < 0.99 * best else since + 1
        best = min(best, error)
        if error < tolerance or since == PATIENCE or turn == rounds:
            break
        ridge = 1e-9 * sum(slopes[i][i] for i in range(n)) / n  # one factor for all leaves everything as it is
        steps = solve([[v + ridge * (i == j) for j, v in enumerate(own)] for i, own in enumerate(slopes)], [t - g for g, t in zip(got, want, strict=True)])
        now = [t - g for g, t in zip(got, want, strict=True)]
        most = [m / 2 if a * b < 0 else min(1.0, 1.5 * m) for m, a, b in zip(most, now, last, strict=True)]
        last = now
        raised = [math.exp(min(m, max(-m, x))) if t > 0 else 0.0 for x, t, m in zip(steps, want, most, strict=True)]
        factors = {"lang": [f * r for f, r in zip(factors["lang"], raised[:n_langs], strict=True)], "topic": [f * r for f, r in zip(factors["topic"], raised[n_langs:], strict=True)]}
    done = cut(solved().select("source", F.explode("e").alias("x")).select("source", "x.at", "x.tokens", F.col("x.e").alias("expected")), "raked", sources)
    name = lambda side, at: F.element_at(F.array(*[F.lit(x) for x in names[side]]), (at + 1).cast("int"))
    return done.select("source", name("lang", F.floor(F.col("at") / n_topics)).alias("lang"), name("topic", F.col("at") % n_topics).alias("topic"), "tokens", "expected"), error, turn


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from an id: 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def mix_sources(docs: DataFrame, targets: dict[str, Any] | None = None, budget: float = BUDGET, seed: str = SEED, topic: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, fitted (the cell's share of the mix), inclusion, sampled, residual; a row for each row.

    ``targets``: by side, as ``TARGETS``, which holds where it's None; a side left out keeps
    its natural shares.  ``topic``: a column to take topics from.  ``residual``: the largest
    relative error of a marginal of the expected tokens that raking leaves, the same in all
    rows; above the tolerance only if the targets contradict each other or ask for more than
    there is.  Null sources, languages and topics are the category ``(none)``.  Null or empty
    texts have no tokens; a cell without any is drawn with probability 0.  Rows without an
    id, and repeated rows, share one draw.  Texts of any length count whole.  Columns other
    than those named aren't read; an empty table gives none.
    """
    return drawn(docs, targets, budget, seed, topic).drop("text_hash")


def drawn(docs: DataFrame, targets: dict[str, Any] | None = None, budget: float = BUDGET, seed: str = SEED, topic: str | None = None) -> DataFrame:
    text = docs["text"].cast("string")
    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit(NONE))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), name("source").alias("source"), name("lang").alias("lang"), F.size(statistics(text)["words"]).cast("long").alias("n_tokens"), text.alias("text"), *([name(topic).alias("topic")] if topic else []))
    shapes = [] if topic else [f"f{i}" for i in range(len(SHAPE) + 1)]
    rows = cut(rows.select(*[c for c in rows.columns if c != "text"], F.xxhash64("text").alias("text_hash"), *[c.alias(s) for c, s in zip(shape(F.col("text"), F.col("n_tokens")), shapes, strict=False)]), "rows")
    if not topic:
        rows = rows.withColumn("topic", topics(rows, shapes)).drop(*shapes)
    cells = cut(rows.groupBy(*SIDES).agg(F.sum("n_tokens").alias("tokens")), "cells")
    raked, error, _ = rake(cells, TARGETS if targets is None else targets, budget)
    whole = raked.agg(F.sum("expected").alias("e")).first()["e"] or 0.0
    told = cut(raked.select(*SIDES, (F.col("expected") / (whole or 1.0)).alias("fitted"), F.when(F.col("tokens") > 0, F.col("expected") / F.col("tokens")).otherwise(0.0).alias("inclusion")), "inclusion")
    discard(cells)
    return rows.join(told, list(SIDES)).select("doc_id", *SIDES, "n_tokens", "fitted", "inclusion", (draw(F.col("doc_id"), seed) < F.col("inclusion")).alias("sampled"), F.lit(round(error, 9)).alias("residual"), "text_hash")
