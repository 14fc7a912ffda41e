"""Quality rules: text statistics and robust multivariate outliers, in DataFrame operations only.

Each document's statistics are transformed and rounded to a fixed grid.  For each
(language, source) the minimum-covariance-determinant estimate of their centre
and scatter is found by concentration steps (Rousseeuw and Van Driessen, 1999)
from three deterministic starts: medians with interquartile ranges, means with
covariances, and medians with the scatter of spatial signs.  Steps go on while a
start's determinant falls; the start with the least one gives the estimate.
Documents beyond a chi-square quantile of Mahalanobis distance are rejected.

In clean corpora half of a group has no symbol, repeated line or repeated window at
all, and its scatter would be singular.  So each variance is regularised by that of
the measurement (cf. Boudt et al., 2020): the square of what one event, a symbol, a
line or a window of three words, makes in a document of the group's median length.

A step takes, in each group, the half of the documents nearest to the present
centre and computes mean and covariance of them.  "Nearest half" comes from a fine
histogram of distances, whose cells carry the sums that mean and covariance need; the
cell on the border counts by the share of it that makes the half exact.  That is one
aggregation over numbers for each step, partial before its shuffle, so a group of any
size is spread over all tasks.  Sums are of integers and so exact in any order.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Transformed statistics are counted in units of 1/GRID.
GRID = 256
NAMES = ("word_length", "symbols", "dup_lines", "repeats")
#: Squared distance beyond which a document is rejected: the 0.9999 quantile of chi-square with four degrees of freedom.
CUTOFF = 23.5127
#: Steps from each start at most; cells of distances to each doubling.
STEPS, CELLS = 12, 64
#: A start's step counts if it lowers the logarithm of the determinant by more.
FALL = 1e-9
#: What makes the scatter of the nearest half consistent at the normal law: (1/2) / P(chi2_6 <= median of chi2_4), for four statistics.
CONSISTENT = 2.109
#: Words that one event of each count touches.
EVENT = (1, 1, 3)
#: Groups of fewer documents, five for each statistic, are put together and estimated as one.
LEAST = 20
#: Signs are summed in units of 1/SIGN.
SIGN = 4096
#: Documents meet their group's estimate by (group, salt), so that a large group is dealt to as many tasks at least.
SALTS = 64
_WORD_SPACE = "\t\n\x0b\x0c\r"


def put(text: Column, letters: str, by: str = "") -> Column:
    """``text`` with ``by`` in place of each of ``letters``: a byte search for each, far faster than ``translate``."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(by)), letters, text)


def among(text: Column, letters: str) -> Column:
    """How many characters of ``text`` are among ``letters``, which are of one byte each."""
    return F.octet_length(text) - F.octet_length(put(text, letters))


def statistics(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return {
        "words": F.array_remove(F.split(put(text, _WORD_SPACE, " "), " "), ""),
        "word_chars": (F.length(text) - among(text, _WORD_SPACE + " ")).cast("long"),
        "n_symbols": among(text, "#*$%&|<>").cast("long"),
        "lines": F.filter(F.split(text, "\n"), lambda x: F.octet_length(put(x, _WORD_SPACE + " ")) > 0),
    }


def with_statistics(docs: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Three-word windows are sorted by a 40-bit hash with their place below it, and only
    neighbours of equal hash are compared as words; a text of 2^24 words or more
    compares all its windows as words.
    """
    told = docs.select(*keep, *[c.alias(f"__{k}") for k, c in statistics(text).items()])
    told = told.withColumn("n_words", F.size("__words").cast("long"))
    told = told.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    hashed = F.expr("transform(sequence(0, size(__words) - 3), i -> (xxhash64(__words[i], __words[i + 1], __words[i + 2]) & ~16777215L) | i)")
    told = told.withColumn("__packed", F.when((F.col("n_words") >= 3) & (F.col("n_words") < 1 << 24), F.sort_array(hashed)))
    # places whose window shares its hash with a neighbour in the sorted order
    told = told.withColumn("__alike", F.expr("filter(__packed, (x, j) -> (j > 0 AND (__packed[greatest(j - 1, 0)] >> 24) = (x >> 24)) OR (j + 1 < size(__packed) AND (__packed[least(j + 1, size(__packed) - 1)] >> 24) = (x >> 24)))"))
    places = F.when(F.col("n_words") >= 1 << 24, F.expr("sequence(0L, size(__words) - 3L)")).otherwise(F.expr("transform(__alike, x -> x & 16777215L)"))
    told = told.withColumn("__places", places)
    told = told.withColumn("__windows", F.expr("array_sort(transform(__places, i -> struct(concat_ws(' ', __words[int(i)], __words[int(i) + 1], __words[int(i) + 2]) AS g, int(i) AS i)))"))
    told = told.withColumn("__twice", F.expr("filter(__windows, (x, j) -> (j > 0 AND __windows[greatest(j - 1, 0)].g = x.g) OR (j + 1 < size(__windows) AND __windows[least(j + 1, size(__windows) - 1)].g = x.g))"))
    told = told.withColumn("n_repeat_words", F.coalesce(F.size(F.array_distinct(F.expr("flatten(transform(__twice, x -> array(x.i, x.i + 1, x.i + 2)))"))), F.lit(0)).cast("long"))
    told = told.withColumn("n_repeat_words", F.when(F.col("n_words") < 3, 0).otherwise(F.col("n_repeat_words")).cast("long"))
    return told.withColumnRenamed("__word_chars", "word_chars").withColumnRenamed("__n_symbols", "n_symbols").drop("__words", "__lines", "__packed", "__alike", "__places", "__windows", "__twice")


def transformed(n: Column, word_chars: Column, counts: list[Column]) -> list[Column]:
    """Logarithms of mean word length and of counts for each hundred words, in whole units of 1/GRID."""
    words = F.greatest(n, F.lit(1))
    logs = [F.log(F.greatest(word_chars, F.lit(1)) / words), *[F.log1p(100 * c / words) for c in counts]]
    return [F.floor(x * GRID + 0.5).cast("long") for x in logs]


_P = len(NAMES)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]


_X, _M, _F = ([f"{c}{i}" for i in range(_P)] for c in "xmf")
_L, _S = ([f"{c}{i}{j}" for i, j in _PAIRS] for c in "ls")


def _cholesky(est: DataFrame) -> DataFrame:
    """``est`` with the lower triangle l00.. of the root of s00.. + the floors, and log_det; s00.. are dropped."""
    for i, j in _PAIRS:
        cell = F.col(f"s{i}{j}") + F.col(f"f{i}") if i == j else F.col(f"s{i}{j}")
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), cell)  # noqa: B023
        est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return est.withColumn("log_det", 2 * reduce(lambda a, i: a + F.log(f"l{i}{i}"), range(1, _P), F.log("l00"))).drop(*_S)


def _distance(told: DataFrame) -> DataFrame:
    """``told`` (x0.., m0.., l00..) with the squared Mahalanobis distance d2: forward substitution."""
    for i in range(_P):
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(f"x{i}") / GRID - F.col(f"m{i}"))  # noqa: B023
        told = told.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    d2 = reduce(lambda a, i: a + F.col(f"y{i}") * F.col(f"y{i}"), range(1, _P), F.col("y0") * F.col("y0"))
    return told.withColumn("d2", d2).drop(*[f"y{i}" for i in range(_P)], *_M, *_L)


def _salted(groups: DataFrame) -> DataFrame:
    """One row for each group and salt, from one for each group."""
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _sums(rows: DataFrame, names: list[str]) -> list[Column]:
    return [F.sum(c).alias(f"t{i}") for i, c in enumerate(names)] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"t{i}{j}") for i, j in _PAIRS]


def _moments(n: Column, total: Any, factor: float) -> list[Column]:
    """m0.. and s00.. from ``total``, a function of the names of sums, over ``n`` documents."""
    mean = [total(f"t{i}") / n for i in range(_P)]
    return [*[(m / GRID).alias(f"m{i}") for i, m in enumerate(mean)], *[((total(f"t{i}{j}") / n - mean[i] * mean[j]) * (factor / GRID**2)).alias(f"s{i}{j}") for i, j in _PAIRS]]


def _starts(points: DataFrame) -> DataFrame:
    """gid, start, m0.., l00.., f0.. and log_det: three rows for each group."""
    names = [*_X, "n_words"]
    long = points.select("gid", F.posexplode(F.array(*names)).alias("f", "x"))
    counts = long.groupBy("gid", "f", "x").agg(F.count("*").alias("n"))
    w = Window.partitionBy("gid", "f")
    upto = counts.withColumn("upto", F.sum("n").over(w.orderBy("x"))).withColumn("all", F.sum("n").over(w))
    quantile = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("x")))
    each = upto.groupBy("gid", "f").agg(quantile(0.5).alias("m"), ((quantile(0.75) - quantile(0.25)) / GRID).alias("iqr"))
    pick = lambda i, c: F.max(F.when(F.col("f") == i, F.col(c)))
    words = pick(_P, "m").cast("double")
    floors = [1 / words, *[F.pow(F.log1p(100 * e / words), F.lit(2.0)) for e in EVENT]]
    wide = each.groupBy("gid").agg(*[pick(i, "m").alias(f"c{i}") for i in range(_P)], *[pick(i, "iqr").alias(f"r{i}") for i in range(_P)], *[f.alias(f"f{i}") for i, f in enumerate(floors)])
    wide = cut(wide, "medians")
    medians = [(F.col(f"c{i}") / GRID).alias(f"m{i}") for i in range(_P)]
    zero = F.lit(0.0)
    first = wide.select("gid", F.lit(0).alias("start"), *medians, *[(F.pow(F.col(f"r{i}") / 1.349, F.lit(2.0)) if i == j else zero).alias(f"s{i}{j}") for i, j in _PAIRS], *_F)
    means = points.groupBy("gid").agg(F.count("*").alias("n"), *_sums(points, _X))
    second = means.select("gid", F.lit(1).alias("start"), *_moments(F.col("n"), F.col, 1.0)).join(wide.select("gid", *_F), "gid")
    away = points.join(_salted(wide.select("gid", *[f"c{i}" for i in range(_P)])), ["gid", "salt"]).select("gid", *[(F.col(f"x{i}") - F.col(f"c{i}")).alias(f"a{i}") for i in range(_P)])
    norm = F.sqrt(reduce(lambda a, i: a + F.col(f"a{i}") * F.col(f"a{i}"), range(1, _P), F.col("a0") * F.col("a0")))
    signs = away.withColumn("norm", norm).filter("norm > 0").select("gid", *[F.floor(F.col(f"a{i}") / F.col("norm") * SIGN + 0.5).alias(f"z{i}") for i in range(_P)])
    scatter = signs.groupBy("gid").agg(F.count("*").alias("n"), *_sums(signs, [f"z{i}" for i in range(_P)]))
    third = wide.join(scatter, "gid", "left").select("gid", F.lit(2).alias("start"), *medians, *[F.coalesce(F.col(f"t{i}{j}") / F.col("n") / SIGN**2, zero).alias(f"s{i}{j}") for i, j in _PAIRS], *_F)
    return _cholesky(first.unionByName(second).unionByName(third)).withColumn("log_det", F.lit(float("inf")))


def _concentrate(points: DataFrame, est: DataFrame) -> DataFrame:
    """One step: centre and scatter of the half nearest to each estimate, where that lowers the determinant; ``fell`` tells where."""
    told = _distance(points.join(_salted(est.drop("log_det", "fell", *_F)), ["gid", "salt"]))
    cell = F.floor(F.log2(F.col("d2") + 2.0**-20) * CELLS).cast("int")
    cells = told.groupBy("gid", "start", cell.alias("cell")).agg(F.count("*").alias("n"), *_sums(told, _X))
    w = Window.partitionBy("gid", "start")
    cells = cells.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("half", F.floor((F.sum("n").over(w) + _P + 1) / 2))
    near = cells.filter(F.col("upto") - F.col("n") < F.col("half"))
    inside, tops = F.col("upto") <= F.col("half"), [c for c in near.columns if c.startswith("t")]
    total = near.groupBy("gid", "start").agg(
        F.max("half").alias("half"), F.max(F.when(~inside, (F.col("half") - F.col("upto") + F.col("n")) / F.col("n"))).alias("part"),
        *[F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)).alias(c) for c in tops], *[F.coalesce(F.sum(F.when(~inside, F.col(c))), F.lit(0)).alias(f"edge_{c}") for c in tops],
    )
    moments = _moments(F.col("half"), lambda c: F.col(c) + F.coalesce("part", F.lit(0.0)) * F.col(f"edge_{c}"), CONSISTENT)
    new = _cholesky(total.select("gid", "start", *moments).join(est.select("gid", "start", *_F), ["gid", "start"]))
    names = [*_M, *_L, "log_det"]
    both = est.drop("fell").join(new.select("gid", "start", *[F.col(c).alias(f"new_{c}") for c in names]), ["gid", "start"])
    fell = F.col("new_log_det") < F.col("log_det") - FALL
    return both.select("gid", "start", *[F.when(fell, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in names], *_F, fell.alias("fell"))


def estimates(points: DataFrame, steps: int = STEPS) -> DataFrame:
    """gid, m0.., l00..: of each group the start with the least determinant.  ``points``: gid, salt, x0.., n_words."""
    est = cut(_starts(points), "starts")
    for _ in range(steps):
        est = cut(_concentrate(points, est), "step", est)
        if est.filter("fell").isEmpty():
            break
    best = est.groupBy("gid").agg(F.min_by(F.struct(*_M, *_L), F.struct(F.round("log_det", 7), "start")).alias("e"))
    return cut(best.select("gid", "e.*"), "estimates", est)


def quality_verdicts(docs: DataFrame, cutoff: float = CUTOFF, steps: int = STEPS, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance; a row for each row of ``docs``.

    ``docs``: doc_id, text, lang, source.  Null text counts as no words and so fails
    the base rule.  Null languages and sources make groups of their own.  Estimates
    use the documents that pass the base rules; distance is null for the others.
    Groups of fewer than ``least`` such documents share one estimate.  Texts of any
    length count whole.  Repeated rows count each time and get equal verdicts; null
    ids stay null; other columns aren't read; an empty table gives none.
    """
    return judged(docs, cutoff, steps, least).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def judged(docs: DataFrame, cutoff: float = CUTOFF, steps: int = STEPS, least: int = LEAST) -> DataFrame:
    """The same with lang, source and text_hash, by which a verdict can be brought back to its row."""
    text = docs["text"].cast("string")
    keep = [docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), F.xxhash64(text).alias("text_hash")]
    told = with_statistics(docs, keep, text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    values = transformed(F.col("n_words"), F.col("word_chars"), [F.col("n_symbols"), F.col("n_dup_lines"), F.col("n_repeat_words")])
    told = cut(told.withColumn("base_failed", failed).select("*", *[v.alias(f"x{i}") for i, v in enumerate(values)]), "statistics")
    sizes = told.filter("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") >= least).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.to_json(F.struct(F.lit("group"), "lang", "source")).alias("g"))
    told = told.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int"))
    large = _salted(large).withColumnRenamed("salt", "g_salt")
    same = told["lang"].eqNullSafe(F.col("g_lang")) & told["source"].eqNullSafe(F.col("g_source")) & (F.col("salt") == F.col("g_salt"))
    found = told.join(large, same, "left").withColumn("gid", F.coalesce("g", F.lit("rest"))).drop("g", "g_lang", "g_source", "g_salt")
    found = cut(found, "grouped")
    points = found.filter("not base_failed").select("gid", "salt", *_X, "n_words")
    est = estimates(points, steps)
    far = _distance(found.join(_salted(est), ["gid", "salt"], "left"))
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    return far.select("doc_id", "lang", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance")).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cutoff))
