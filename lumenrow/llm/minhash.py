"""Near-duplicate documents by one-permutation MinHash.

Each distinct shingle set gets 128 bins by one hash; empty bins borrow from
others by optimal densification (Shrivastava, 2017).  32 bands of 4 bins deal the
sets into buckets, and in each bucket only star-shaped edges, from one centre to
the other members, are candidates: their number is bounded by the members.
Candidates are confirmed on full shingle sets.

Members of buckets that are in several components even then meet once more: of
two similar sets, ordered by one order of all shingles, the beginnings have a
shingle in common (prefix filter; Bayardo et al., 2007).  Rare shingles come
first, so texts of one template, but below the threshold, don't meet in what the
template gave them.  Every pair of components in a bucket is so tested or excluded
exactly.

Equal sets are one class before any pair is made, so copies cost one row each.
Links, components and fingerprints stay distributed throughout.  Members of a bucket
and holders of a shingle are dealt with a salt, so that a hot one goes to several tasks; a star's
centre meets its members in joins that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard
from .textwords import mix, slices, stream, strings, tidy, word_hashes

WORDS, BINS, ROWS = 5, 128, 4
#: A bucket's members, and a shingle's holders, are dealt to so many tasks.
SALTS = 8
BANDS = BINS // ROWS
_U = np.uint64
_SHIFT = _U(64 - 7)  # the top 7 bits name the bin
_PLACE = stream(11, WORDS) | _U(1)
_ROW = stream(13, ROWS) | _U(1)
_BORROW = (stream(17, BINS * 64) % _U(BINS)).astype(np.int64).reshape(64, BINS)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Of each row the sorted distinct 64-bit hashes of its 5-word shingles; with fewer words, of the whole sequence."""
    words, bounds = word_hashes(*strings(column))
    with np.errstate(over="ignore"):
        n = max(0, len(words) - WORDS + 1)
        all5 = words[:n] * _PLACE[0]
        for k in range(1, WORDS):
            all5 = all5 + words[k : n + k] * _PLACE[k]
        all5 = mix(all5)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= WORDS:
                out.append(np.unique(all5[a : b - WORDS + 1]))
            elif b > a:
                out.append(mix(np.array([(words[a:b] * _PLACE[: b - a]).sum() + _U(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """128 bins of one permutation, densified: an empty bin takes the value of the first filled one on its own fixed walk."""
    bins = (hashes >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))  # sorted: a bin's first value is its least
    out = np.zeros(BINS, np.uint64)
    filled = np.zeros(BINS, bool)
    out[bins[first]], filled[bins[first]] = hashes[first], True
    if not filled.all():
        base = out.copy()
        left = np.flatnonzero(~filled)
        for step in range(64):
            donor = _BORROW[step, left]
            ok = filled[donor]
            out[left[ok]] = base[donor[ok]]
            left = left[~ok]
            if not len(left):
                break
        if len(left):  # after 64 steps: the next filled bin
            have = bins[first]
            out[left] = base[have[np.searchsorted(have, left) % len(have)]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sig.reshape(BANDS, ROWS) * _ROW).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


_SIG = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("bands", pa.list_(pa.int64()))])


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, fp (128 bits that name the shingle set; null for the empty one), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(start, stop - start))
                with np.errstate(over="ignore"):
                    fps = [np.array([len(s), 0], np.uint64) + np.array([mix(s).sum(), mix(s + _U(0x5851F42D4C957F2D)).sum()], np.uint64) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, stop - start),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([None if f is None else f.tobytes() for f in fps], pa.binary()),
                    pa.array([band_keys(signature(s)) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ], schema=_SIG)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_shingles long, fp binary, bands array<long>")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets are similar enough; ``texts``: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, kept = None, np.zeros(0, np.uint64)
        for batch in batches:
            ids, others, good = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for start, stop in slices(batch.column(3)):
                for i, s in zip(range(start, stop), shingle_sets(batch.column(3).slice(start, stop - start)), strict=True):
                    if ids[i] != name:
                        name, kept = ids[i], shingle_sets(batch.column(2).slice(i, 1))[0]
                    good += [i] * similar(kept, s, percent)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in good], pa.int64()), pa.array([others[i] for i in good], pa.int64())], names=["a", "b"])

    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text").mapInArrow(tidy(run), "a long, b long").distinct()


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` (node and others) with a salt, so that a key's rows can go to as many tasks as there are salts."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))


def salted(few: DataFrame) -> DataFrame:
    """``few`` (a row for each key) for each salt."""
    return few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b); nodes without a link have no row.

    Large-star and small-star steps in turn (Kiveris et al., 2014): a logarithmic
    number of joins in practice, each result written to the shared folder.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        edges = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large", edges)
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u")
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small", edges)
        # done if all are stars: each node has one edge down, and none has edges both up and down
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down = 1 and up = 1").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after ``links`` (a, b) between any nodes: only the parts that they touch are joined anew."""
    part = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_part"))
    of_parts = links.join(part("a"), "a", "left").join(part("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    moved = cut(components(of_parts), "moved")
    old = labels.join(moved.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return cut(old.union(moved.join(labels, "node", "left_anti").select("node", "component")), "components", moved, labels)


def shingle_rows(texts: DataFrame) -> DataFrame:
    """node, text_set (a hash of the whole set), shingle: a row for each shingle of each row of ``texts`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start, stop in slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(start, stop - start))
                for at in range(0, len(sets), 256):
                    some = sets[at : at + 256]
                    sizes = [len(x) for x in some]
                    with np.errstate(over="ignore"):
                        names = np.array([mix(x).sum() for x in some], np.uint64)
                    columns = np.repeat(ids[start + at : start + at + len(some)], sizes), np.repeat(names, sizes).view(np.int64), np.concatenate(some).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "text_set", "shingle"])

    return texts.select("node", "text").mapInArrow(tidy(run), "node long, text_set long, shingle long")


def prefixes(texts: DataFrame, percent: int) -> DataFrame:
    """node, shingle, size, at (from 0), short: the beginnings of the sets of ``texts``, shingles held by several rows only, rare ones first.

    x and y, x no longer than y, can only be similar if a shingle among x's ``short`` rows is among y's rows.
    """
    rows = cut(shingle_rows(texts).distinct(), "shingles")
    common = rows.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    ordered = spread(rows).join(salted(common), ["shingle", "salt"], "left").groupBy("node", "text_set").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "shingle"))).alias("all")).withColumn("size", F.size("all").cast("long"))
    long = F.expr(f"cast(size - (size * {percent} + 99) div 100 + 1 as int)")
    short = F.expr(f"size - (2 * size * {percent} + {99 + percent}) div {100 + percent} + 1")
    told = ordered.select("node", "size", short.alias("upto"), F.posexplode(F.slice("all", F.lit(1), long)).alias("at", "x"))
    return told.filter("x.n > 1").select("node", "x.shingle", "size", "at", (F.col("at") < F.col("upto")).alias("short"))


def across(parts: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different parts that can be similar; ``parts``: node, part.

    Of each shingle, the nodes of the part that holds most of its rows meet the
    others' only, so that a large component isn't paired with itself.
    """
    rows = cut(prefixes(texts, percent).join(parts, "node"), "prefixes")
    held = rows.groupBy("shingle", "part").agg(F.count("*").alias("n"), F.max("short").alias("short"))
    top = held.groupBy("shingle").agg(F.max(F.struct("n", "part")).alias("top"), F.count("*").alias("parts"), F.max("short").alias("any")).filter("parts > 1 and any")
    rows = cut(spread(rows).join(salted(top.select("shingle", F.col("top.part").alias("top"))), ["shingle", "salt"]).withColumn("main", F.col("part") == F.col("top")).drop("top", "salt"), "shared")
    names = ("node", "size", "at", "part")
    one = lambda side, which: rows.filter(which).select("shingle", *[F.col(c).alias(f"{side}_{c}") for c in names])
    # the shared shingle that comes first leaves room for the overlap that similarity needs
    fits = f"a_part <> b_part and a_size <= b_size and least(a_size - a_at, b_size - b_at) * {100 + percent} >= {percent} * (a_size + b_size)"
    pairs = one("a", "short and not main").join(one("b", "true"), "shingle").filter(fits)
    pairs = pairs.union(one("a", "short and main").join(one("b", "not main"), "shingle").filter(fits))
    return pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id); one row for each row of ``docs``.

    A null or blank text has no shingles and is linked with nothing.  A row whose
    id is null can't be named: component_id is null and it's kept.  Rows that
    share an id are one document: whatever is linked with one of their sets is linked
    with all.  Equal sets are linked whatever their number.  Texts and words of any
    length are taken whole.  Columns other than the two named aren't read; an empty
    table gives none.
    """
    sig = cut(signatures(docs, id_col, text_col), "signatures")
    classes = cut(sig.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")).filter("node is not null"), "classes")
    dealt = classes.select("node", F.explode("bands").alias("key"))
    centres = dealt.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("key", "a")
    buckets = cut(spread(dealt).join(salted(centres), ["key", "salt"]).select("key", "a", "node"), "buckets")
    wanted = buckets.select("node").distinct()
    named = docs.select(docs[id_col].cast("long").alias("node"), docs[text_col].cast("string").alias("text")).filter("node is not null and text is not null")
    texts = cut(named.join(wanted, "node", "left_semi").withColumn("copy", F.xxhash64("text")).dropDuplicates(["node", "copy"]).drop("copy"), "texts")

    # an id that stands for several sets links their classes
    several = sig.filter("fp is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("fp")).alias("lo"), F.max(F.xxhash64("fp")).alias("hi")).filter("lo <> hi").select("doc_id")
    of_ids = sig.join(several, "doc_id", "left_semi").join(classes.select("fp", "node"), "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()

    tested = cut(buckets.filter("a <> node").select("a", F.col("node").alias("b")).distinct(), "pairs")
    labels = cut(components(confirm(tested, texts, percent).union(of_ids)), "components")
    now = cut(buckets.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part")), "members", buckets)
    several = now.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("key")
    # members of buckets in several components meet by shared rare shingles
    parts = cut(spread(now).join(salted(several), ["key", "salt"], "left_semi").select("node", "part").distinct(), "parts", now)
    if not parts.isEmpty():
        left = cut(texts.join(parts, "node", "left_semi"), "texts", texts)
        fresh = cut(across(parts, left, percent).join(tested, ["a", "b"], "left_anti"), "pairs", tested)
        found = cut(confirm(fresh, left, percent), "links", left, fresh)
        if not found.isEmpty():
            labels = joined(labels, found)
        discard(found)
    discard(texts, tested, parts)
    by_set = classes.select("fp", "node").join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("part"))
    whole = sig.join(by_set, "fp", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id")).alias("component_id"))
    return whole.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
