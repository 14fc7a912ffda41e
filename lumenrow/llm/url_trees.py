"""URL filters: rules first, then gradient-boosted trees on lexical features, in DataFrame operations only.

A rule fits its host and all subdomains if the path starts with the rule's; the
longest rule wins.  Other URLs are judged by boosted trees of depth two over
binned features of the URL's text.  Training is logistic boosting with
second-order leaf values: gradient and curvature sums for each (node, feature,
bin) are one aggregation, of at most nodes x features x bins rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

# Rules as (host and path prefix, verdict).
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
# Words in a host that label a URL as unwanted when no labels are given.
SEEDS = ("pills", "casino", "spam", "viagra", "porn", "lottery", "payday", "replica")
BINS, ROUNDS, RATE, SMOOTH = 12, 12, 0.4, 1.0
#: Trees are fitted on so many URLs of each label at most.
SAMPLE = 20_000
#: One of so many hosts is held out by ``held_out``.
FOLDS = 5


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: then up to ``? #`` or the end; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null; of equal lengths the first by name."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def entropy(text: Column, letters: str = "abcdefghijklmnopqrstuvwxyz0123456789-.") -> Column:
    """Bits a character of the text's letters, digits, hyphens and dots."""
    n, bits = F.lit(0.0), F.lit(0.0)
    for c in letters:
        k = (F.length(text) - F.length(F.translate(text, c, ""))).cast("double")
        n, bits = n + k, bits + F.when(k > 0, k * F.log2(F.greatest(k, F.lit(1.0)))).otherwise(0.0)
    return F.when(n > 0, F.log2(F.greatest(n, F.lit(1.0))) - bits / F.greatest(n, F.lit(1.0))).otherwise(0.0)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def features(url: Column, host: Column, path: Column, odds: Column) -> dict[str, Column]:
    """``odds``: log odds of label 1 of the host's suffix."""
    text = F.coalesce(url, F.lit(""))
    length = F.length(text)
    return {
        "length": length.cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": _count(path, "/").cast("double"),
        "labels": _count(host, r"\.").cast("double"),
        "digits": F.when(length > 0, _count(text, "[0-9]") / length).otherwise(0.0),
        "hyphens": _count(host, "-").cast("double"),
        "parameters": (_count(F.regexp_extract(text, r"(?s)\?([^#]*)", 1), "&") + text.contains("?").cast("int")).cast("double"),
        "fragment": text.contains("#").cast("double"),
        "secure": text.startswith("https://").cast("double"),
        "entropy": entropy(host),
        "suffix": odds,
    }


def _bin(value: Column, edges: list[float]) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + (value > e).cast("int")
    return out


class UrlTrees:
    """Bin edges of each feature, log odds of suffixes (a table: suffix, odds), and trees ((feature, bin), two (feature, bin), four leaves)."""

    def __init__(self) -> None:
        self.odds: DataFrame | None = None
        self.edges: dict[str, list[float]] = {}
        self.trees: list[tuple] = []
        self.base = 0.0

    def score(self, bins: dict[str, Column]) -> Column:
        out = F.lit(self.base)
        for (f, b), splits, leaves in self.trees:
            side = [F.when(bins[g] <= c, leaves[2 * i]).otherwise(leaves[2 * i + 1]) for i, (g, c) in enumerate(splits)]
            out = out + F.when(bins[f] <= b, side[0]).otherwise(side[1])
        return 1 / (1 + F.exp(-out))

    def with_odds(self, urls: DataFrame) -> DataFrame:
        """``urls`` (host and others) with __odds, 0 for a suffix that training didn't have."""
        if self.odds is None:
            return urls.withColumn("__odds", F.lit(0.0))
        odds = self.odds.select(F.col("suffix").alias("__suffix"), F.col("odds").alias("__known"))
        return urls.join(odds, suffix(urls["host"]) == F.col("__suffix"), "left").withColumn("__odds", F.coalesce("__known", F.lit(0.0))).drop("__suffix", "__known")

    def judged(self, urls: DataFrame) -> DataFrame:
        """``urls`` (url, host, path and others) with ``probability``; features, bins and score are columns one after another, so none is computed twice."""
        own = urls.columns
        known = self.with_odds(urls).select(*own, *[v.alias(f"__f_{k}") for k, v in features(F.col("url"), F.col("host"), F.col("path"), F.col("__odds")).items() if k in self.edges])
        binned = known.select(*own, *[_bin(F.col(f"__f_{k}"), e).alias(f"__b_{k}") for k, e in self.edges.items()])
        return binned.select(*own, self.score({k: F.col(f"__b_{k}") for k in self.edges}).alias("probability"))


def _gain(g: float, h: float) -> float:
    return g * g / (h + SMOOTH)


def _best(sums: dict[tuple[str, int], tuple[float, float]], names: list[str]) -> tuple[str, int]:
    """The split with most gain; of equal ones the first feature and lowest bin."""
    best, at = -1.0, (names[0], BINS)
    for f in names:
        cells = sorted((b, v) for (g, b), v in sums.items() if g == f)
        g_all, h_all = sum(v[0] for _, v in cells), sum(v[1] for _, v in cells)
        g = h = 0.0
        for b, (dg, dh) in cells[:-1]:
            g, h = g + dg, h + dh
            gain = _gain(g, h) + _gain(g_all - g, h_all - h) - _gain(g_all, h_all)
            if gain > best + 1e-9:
                best, at = gain, (f, b)
    return at


def train(urls: DataFrame, rounds: int = ROUNDS, sample: int = SAMPLE) -> UrlTrees:
    """``urls``: url, label (0 or 1).

    Trees are fitted on at most ``sample`` URLs of each label, chosen by hash.  Labels
    and suffixes are counted over all rows, and the chosen URLs of a label weigh as
    much as all rows of it, so the base rate is that of the rows at any size.
    """
    model = UrlTrees()
    urls = urls.filter("url is not null and label in (0, 1)").select("url", F.col("label").cast("int").alias("label"))
    host, path = host_path(F.col("url"))
    counts = cut(urls.groupBy(suffix(host).alias("suffix")).agg(F.sum("label").alias("pos"), F.count("*").alias("n")), "suffixes")
    model.odds = counts.select("suffix", F.round(F.log((F.col("pos") + 1) / (F.col("n") - F.col("pos") + 1)), 6).alias("odds"))
    rows = counts.agg(F.sum("pos").alias("pos"), F.sum("n").alias("all")).first()
    pos, n = rows["pos"] or 0, rows["all"] or 0
    picked = None
    for label in (0, 1):
        some = urls.filter(F.col("label") == label).groupBy("url", "label").agg(F.count("*").alias("n")).orderBy(F.xxhash64("url"), "url").limit(sample)
        picked = some if picked is None else picked.union(some)
    picked = cut(picked.coalesce(1), "urls").coalesce(1)
    share = F.when(F.col("label") == 1, F.lit(float(pos))).otherwise(F.lit(float(n - pos))) / F.sum("n").over(Window.partitionBy("label"))
    picked = model.with_odds(picked.withColumn("weight", F.col("n") * share).withColumns({"host": host, "path": path}))
    values = cut(picked.select("label", "weight", *[v.alias(k) for k, v in features(F.col("url"), F.col("host"), F.col("path"), F.col("__odds")).items()]).coalesce(1), "features").coalesce(1)
    names = values.columns[2:]
    quantiles = values.agg(*[F.percentile_approx(k, [i / BINS for i in range(1, BINS)], 10_000).alias(k) for k in names]).first()
    model.edges = {k: sorted(set(quantiles[k] or [])) for k in names}
    if not pos or pos == n:
        model.base = -20.0 if not pos else 20.0
        return model
    model.base = math.log(pos / (n - pos))
    cells = cut(values.select("label", "weight", *[_bin(F.col(k), model.edges[k]).alias(k) for k in names]).groupBy("label", *names).agg(F.sum("weight").alias("n")).coalesce(1), "cells").coalesce(1)
    bins = {k: F.col(k) for k in names}
    for _ in range(rounds):
        p = model.score(bins)
        told = cells.withColumn("p", p).withColumn("g", F.col("n") * (F.col("label") - F.col("p"))).withColumn("h", F.col("n") * F.col("p") * (1 - F.col("p")))
        stacked = told.select("g", "h", *names, F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(k).alias("b")) for k in names])).alias("x"))

        def sums(side: Column, stacked: DataFrame = stacked) -> list[dict]:
            out: list[dict] = [{}, {}]
            for r in stacked.groupBy(side.cast("int").alias("s"), "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                out[r.s][r.f, r.b] = (r.g, r.h)
            return out

        top = _best(sums(F.lit(0))[0], names)
        halves = sums(F.col(top[0]) > top[1])
        splits = tuple(_best(half, names) for half in halves)
        leaves = []
        for half, (f, b) in zip(halves, splits, strict=True):
            for high in (False, True):
                inside = [v for (g, c), v in half.items() if g == f and (c > b) == high]
                leaves.append(RATE * sum(v[0] for v in inside) / (sum(v[1] for v in inside) + SMOOTH))
        model.trees.append((top, splits, tuple(leaves)))
    return model


def seeded(urls: DataFrame, words: tuple[str, ...] = SEEDS) -> DataFrame:
    """url, label: 1 for URLs whose host holds one of ``words``."""
    host, _ = host_path(F.col("url"))
    return urls.select("url", F.when(host.rlike("|".join(words)), 1).otherwise(0).alias("label"))


def held_out(labels: DataFrame, rounds: int = ROUNDS, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """label, blocked, n: how URLs of held-out hosts are judged by trees trained on the other hosts' ``labels`` (url, label)."""
    host, path = host_path(F.col("url"))
    told = labels.select("url", "label").withColumns({"host": host, "path": path})
    out = F.crc32(F.col("host").cast("binary")) % FOLDS == 0
    model = train(told.filter(~out), rounds, sample)
    blocked = (F.col("probability") > threshold).alias("blocked")
    return model.judged(told.filter(out)).groupBy("label", blocked).agg(F.count("*").alias("n"))


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: dict[str, str] | None = None, threshold: float = 0.5, rounds: int = ROUNDS, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, probability: a row for each row of ``pages`` (page_id, url).

    ``labels``: url, label (1 for unwanted), the URLs to learn from; without it, those of
    ``pages`` are labelled by ``seeded``.  The trees see neither the words nor the rules,
    only lexical features, and so judge hosts that no word names.  ``sample``: the bound
    on URLs of each label that trees are fitted on.  A null url, or one without ``://``,
    has an empty host and path, no rule, and the trees' verdict on an empty text.  URLs
    of any length are read whole.  Null ids stay null; repeated rows give equal rows;
    other columns aren't read; an empty table gives none.
    """
    rules = RULES if rules is None else rules
    plain = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"))
    host, path = host_path(F.col("url"))
    model = train(seeded(plain) if labels is None else labels, rounds, sample)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.lit(None).cast("string")
    for r, v in rules.items():
        verdict = F.when(F.col("rule") == r, F.lit(v)).otherwise(verdict)
    told = model.judged(plain.withColumns({"host": host, "path": path})).withColumn("rule", rule)
    return told.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.when(F.col("probability") > threshold, "block").otherwise("allow")).alias("verdict"), "probability")
