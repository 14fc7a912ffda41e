"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes holds, for contexts of up to
``order`` bytes, how often each byte followed.  A byte is coded in the longest
context that the language has seen; if the byte is new there, an escape is paid
(method C: distinct followers against all) and the next shorter context is
tried, down to all 256 bytes alike.  Statistics are frozen: a text's code length
is the same wherever and whenever it is scored.  The language with the shortest
code wins.

All languages' costs of an n-gram lie in one row of a table, already summed over
escapes, so that scoring is a few table reads for each byte, made on whole
batches at once.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard
from .textwords import strings, tidy

#: Bytes scored at once: their table reads for all languages take some 150 bytes each.
CHUNK = 1 << 18
_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Slots:
    """Row numbers of 64-bit keys: open addressing at a quarter full."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.rows[slot] < 0
            got, which = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[which]
            self.keys[got], self.rows[got] = keys[left[placed]], left[placed]
            stay = np.ones(len(left), bool)
            stay[placed] = False
            left, slot = left[stay], slot[stay] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        rows = self.rows[slot]
        wrong = np.flatnonzero((rows >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = slot[wrong] + 1 & self.mask
            rows[wrong] = self.rows[slot[wrong]]
            wrong = wrong[(rows[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return rows


class ContextTrees:
    """Code lengths in bits of bytes after contexts, for several languages."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = 3) -> None:
        self.order, self.languages = order, sorted(texts)
        width = len(self.languages)
        self.rows: list[np.ndarray] = []  # [k]: the n-grams of k + 1 bytes that some language has seen, sorted
        self.cost: list[np.ndarray] = []  # [k]: their code lengths
        self.escape: list[np.ndarray] = []  # [k]: what leaving them as a context of k + 1 bytes costs; the last row is for unseen ones
        grams = [self._grams(texts[x]) for x in self.languages]
        for k in range(order + 1):
            seen = [np.unique(g[k], return_counts=True) for g in grams]
            contexts = [g[k + 1] >> _U(8) for g in grams] if k < order else []  # those at a text's start aren't n-grams themselves
            rows = np.unique(np.concatenate([*[s for s, _ in seen], *contexts])) if seen else np.zeros(0, np.uint64)
            shorter = self._below(rows, k, width)
            for j, (keys, counts) in enumerate(seen):
                at = np.searchsorted(rows, keys)
                context, first = np.unique(keys >> _U(8), return_index=True)
                sums, kinds = np.add.reduceat(counts, first) if len(counts) else counts, np.diff(np.append(first, len(keys)))
                if k:
                    up = np.searchsorted(self.rows[k - 1], context)
                    have = (up < len(self.rows[k - 1])) & (self.rows[k - 1][np.minimum(up, len(self.rows[k - 1]) - 1)] == context)
                    self.escape[k - 1][up[have], j] = np.log2((sums + kinds)[have] / kinds[have])
                own = np.searchsorted(context, keys >> _U(8))
                shorter[0][at, j] = np.log2((sums + kinds)[own] / counts)
                shorter[1][at, j] = True
            cost, seen_here = shorter
            if k:
                esc = self.escape[k - 1][self._row(k - 1, rows >> _U(8))]
                cost = np.where(seen_here, cost, cost + esc)
            elif len(grams):
                total, kinds = np.array([s[1].sum() for s in seen]), np.array([len(s[0]) for s in seen])
                self.never = np.log2((total + kinds) / np.maximum(kinds, 1)) + 8
                cost = np.where(seen_here, cost, self.never)
            self.rows.append(rows)
            self.cost.append(cost.astype(np.float32))
            self.escape.append(np.zeros((len(rows) + 1, width)))
        self.escape = [e.astype(np.float32) for e in self.escape]
        self.slots: list[Slots] | None = None

    def _grams(self, texts: list[bytes]) -> list[np.ndarray]:
        """[k]: every byte with the k bytes before it, as one number; before a text stand zero bytes."""
        pad = b"\0" * self.order
        data = _FOLD[np.frombuffer(pad + pad.join(texts), np.uint8)]
        own = np.ones(len(data), bool)
        ends = np.cumsum([len(t) + self.order for t in texts])
        for e in [0, *ends.tolist()]:
            own[e : e + self.order] = False
        return [key[own] for key in self._keys(data)]

    def _keys(self, data: np.ndarray) -> list[np.ndarray]:
        keys = [data.astype(np.uint64)]
        for k in range(1, self.order + 1):
            key = keys[-1].copy()
            key[k:] |= data[:-k].astype(np.uint64) << _U(8 * k)
            keys.append(key)
        return keys

    def _row(self, k: int, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.rows[k], keys)
        return np.where((at < len(self.rows[k])) & (self.rows[k][np.minimum(at, max(0, len(self.rows[k]) - 1))] == keys), at, len(self.rows[k])) if len(self.rows[k]) else np.zeros(len(keys), int)

    def _below(self, rows: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Costs in the context one byte shorter; every suffix of a seen n-gram was seen too."""
        cost = np.zeros((len(rows), width))
        if k:
            cost[:] = self.cost[k - 1][self._row(k - 1, rows & _U((1 << 8 * k) - 1))]
        return cost, np.zeros((len(rows), width), bool)

    def ready(self) -> ContextTrees:
        """Dense tables for the two lowest orders and slots for the others."""
        if self.slots is None:
            width = len(self.languages)
            zero = np.tile(self.never.astype(np.float32), (256, 1))
            zero[self.rows[0].astype(np.int64)] = self.cost[0]
            esc = np.zeros((256, width), np.float32)
            esc[self.rows[0].astype(np.int64)] = self.escape[0][:-1]
            one = (esc[:, None, :] + zero[None, :, :]).reshape(65536, width)
            if self.order:
                one[self.rows[1].astype(np.int64)] = self.cost[1]
                two = np.zeros((65536, width), np.float32)
                two[self.rows[1].astype(np.int64)] = self.escape[1][:-1]
                self.two = two
            else:
                one = np.tile(zero, (256, 1))
            self.one = one
            self.slots = [Slots(self.rows[k]) for k in range(2, self.order + 1)]
        return self

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row in each language; long inputs are taken by pieces that share their contexts."""
        self.ready()
        width, n = len(self.languages), len(offsets) - 1
        out = np.zeros((n, width))
        for at in range(0, len(data), CHUNK):
            end = min(len(data), at + CHUNK)
            first, last = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, end)
            rows = np.arange(first, last)
            cuts = np.clip(offsets[rows], at, end)
            # each row's bytes, with the bytes before it or zeros in front
            room = self.order
            sizes = np.diff(np.append(cuts, end))
            begin = np.cumsum(sizes + room) - sizes
            buf = np.zeros(int(sizes.sum()) + room * len(rows), np.uint8)
            own = np.ones(len(buf), bool)
            for k in range(room):
                own[begin - 1 - k] = False
            buf[own] = _FOLD[data[at:end]]
            if room and offsets[first] < at:
                back = _FOLD[data[max(offsets[first], at - room) : at]]
                buf[room - len(back) : room] = back
            keys = self._keys(buf)
            cost = self.one[(keys[1] if self.order else keys[0]).astype(np.int64)]
            before = None
            for k in range(2, self.order + 1):
                found = self.slots[k - 2].find(keys[k])
                if k == 2:
                    esc = np.zeros_like(cost)
                    esc[1:] = self.two[keys[1][:-1].astype(np.int64)]
                else:
                    esc = np.zeros_like(cost)
                    esc[1:] = self.escape[k - 1][before[:-1]]
                hit = found >= 0
                cost += esc
                cost[hit] = self.cost[k][found[hit]]
                before = found
            cost[~own] = 0
            full = np.zeros((len(buf) + 1, width))
            np.cumsum(cost, axis=0, dtype=np.float64, out=full[1:])
            out[rows] += full[begin + sizes] - full[begin]
        return out


def sample(docs: DataFrame, per_language: int, max_bytes: int) -> DataFrame:
    """lang, text of at most ``per_language`` labelled documents a language, those whose ids have the least hashes.

    Documents whose crc32(id as text) mod 5 is 0 are held out, and so are texts of over ``max_bytes``;
    of rows that share an id the least text stands for them.  Languages are counted first, and only
    hashes below a bound that leaves about twice as many as wanted are gathered with their texts.
    """
    fit = F.col("lang").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0) & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= max_bytes)
    own = docs.filter(fit).withColumn("place", F.xxhash64("doc_id") / 2.0**64 + 0.5)
    spark, counts = docs.sparkSession, {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    slack = 2.0
    while True:  # again, with a higher bound, should a language have fewer than it could
        bounds = {lang: min(1.0, slack * max(per_language, 50) / n) for lang, n in counts.items()}
        table = F.broadcast(spark.createDataFrame(list(bounds.items()), "lang string, bound double"))
        near = own.join(table, "lang").filter((F.col("place") < F.col("bound")) | (F.col("bound") >= 1)).groupBy("lang", "doc_id", "place").agg(F.min("text").alias("text"))
        rank = Window.partitionBy("lang").orderBy("place", "doc_id")
        picked = cut(near.withColumn("turn", F.row_number().over(rank)).filter(F.col("turn") <= per_language).select("lang", "text"), "sample")
        got = {r["lang"]: r["n"] for r in picked.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        if all(got.get(lang, 0) >= per_language or bounds[lang] >= 1 for lang in counts):
            return picked
        discard(picked)
        slack *= 16


_TREES: dict[str, ContextTrees] = {}


def identify(docs: DataFrame, per_language: int = 150, max_bytes: int = 65536, order: int = 3, keep: list[str] | None = None, names: tuple[str, str, str] = ("held_out", "lang_pred", "score")) -> DataFrame:
    """held_out, lang_pred and score for each row of ``docs`` (doc_id, text, lang), with the columns ``keep`` before them.

    ``names``: other names for the three, where ``keep`` has theirs.

    The classifier is fitted on at most ``per_language`` documents of at most
    ``max_bytes`` for each language, so its size is bounded by these and by the
    number of languages; it is broadcast.  Predictions use the whole text and
    nothing else.  ``und``: text null or without a letter, or nothing to learn
    from.  score: the winner's posterior under equal priors, 0 for ``und``; of
    equal codes the first language by name wins.  A row without an id counts as
    not held out and isn't learnt from.  Texts of any length are scored whole, by
    pieces; repeated rows get equal results; columns of any names may stand in
    ``keep`` but for those in ``names``; an empty table gives none.
    """
    spark = docs.sparkSession
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    texts: dict[str, list[bytes]] = {}
    picked = sample(plain, per_language, max_bytes)
    for row in picked.collect():
        texts.setdefault(row.lang, []).append(row.text.encode())
    discard(picked)
    for lang in texts:
        texts[lang].sort()
    shipped = spark.sparkContext.broadcast(pickle.dumps(ContextTrees(texts, order) if texts else None))
    keep = keep or ["doc_id"]
    columns = [docs[c] for c in keep]
    extra = [F.coalesce(F.pmod(F.crc32(docs["doc_id"].cast("long").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False)).alias(names[0]), F.coalesce(docs["text"].cast("string").rlike(r"\p{L}"), F.lit(False)).alias("__letter")]
    n = len(columns)
    scored = keep.index("text") if "text" in keep and docs.schema["text"].dataType.simpleString() == "string" else n + 2  # texts go to Python once
    source = docs.select(*columns, *extra, *([docs["text"].cast("string").alias("__scored")] if scored > n else []))
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _TREES:
            _TREES.clear()
            _TREES[token] = pickle.loads(shipped.value)
        trees = _TREES[token]
        for batch in batches:
            letter = np.array(batch.column(n + 1).to_pylist(), bool)
            found, score = np.full(len(letter), "und", object), np.zeros(len(letter))
            if trees is not None and letter.any():
                bits = trees.bits(*strings(batch.column(scored)))
                best = bits.argmin(axis=1)
                with np.errstate(under="ignore"):
                    share = 1 / np.exp2(-(bits - bits.min(axis=1, keepdims=True))).sum(axis=1)
                found[letter], score[letter] = np.array(trees.languages, object)[best[letter]], share[letter]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(found.tolist(), pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[: n + 1], *names[1:]])

    shape = source.select(*source.columns[: n + 1]).schema.add(names[1], "string").add(names[2], "double")
    return source.mapInArrow(tidy(run), shape)
