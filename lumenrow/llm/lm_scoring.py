"""Language-model scoring by cross-entropy difference (Moore and Lewis, 2010).

Two bigram models, one of target documents and one of the whole corpus, share one
vocabulary, every word of the corpus, and one way of smoothing: a pair is pulled to
its second word, and the target's words to the background's.  A document's score is the
mean over its words of background loss minus target loss, in bits: high for text like
the target's.

All words and all pairs of the corpus are counted, each for itself: no table has a
fixed size.  Documents are packed into blocks.  A block sends its distinct keys (words
and pairs) with their counts, in order and compressed, to shards of the key space; a
shard adds up what its blocks sent and answers each with the corpus's counts alone, in
the order of the keys it sent.  So keys travel once, a key that occurs often in a block
travels once for the block, and no key is hot.  The number of shards follows the bytes
of text, so that a shard's keys stay bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textwords import give_back, mix, slices, stream, strings, tidy, word_hashes

#: What a pair's model is pulled to its second word by, and the target's words to the background's, in counts.
PRIOR, PULL = 64.0, 32_768.0
#: Bytes of text that are counted together; a longer text has a block of its own.
BLOCK = 1 << 22
#: Bytes of text for each shard of the key space.
SHARD = 1 << 22
_U = np.uint64
_PAIR = stream(19, 2) | _U(1)


def _squeezed(values: np.ndarray) -> bytes:
    """Whole numbers by planes of their bytes, compressed: the planes of small numbers are empty."""
    return pa.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _opened(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def blocks(plain: DataFrame) -> DataFrame:
    """block, ids, sizes (words of each row), bytes, payload (doc_id and text, packed): the rows of ``plain`` (doc_id, text)."""
    names = ["block", "ids", "sizes", "bytes", "payload"]

    def packed(block: int, held: list[pa.RecordBatch], sizes: list[np.ndarray], size: int) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
            for batch in held:
                out.write_batch(batch)
        ids = [i for batch in held for i in batch.column(0).to_pylist()]
        each = np.concatenate(sizes)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([each], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, sizes, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                text, offsets = strings(batch.column(1).slice(start, stop - start))
                if held and size + len(text) > BLOCK:
                    yield packed(block, held, sizes, size)
                    block, held, sizes, size = block + 1, [], [], 0
                held.append(batch.slice(start, stop - start))
                sizes.append(np.diff(word_hashes(text, offsets)[1]))
                size += len(text)
        if held:
            yield packed(block, held, sizes, size)

    return plain.mapInArrow(tidy(run), "block long, ids array<long>, sizes array<long>, bytes long, payload binary")


class Block:
    """The words and pairs of a block's rows as distinct keys, in order, and where each row's are among them."""

    def __init__(self, payload: bytes) -> None:
        table = pa.ipc.open_stream(payload).read_all()
        self.ids = table.column("doc_id")
        found = [word_hashes(*strings(chunk)) for chunk in table.column("text").chunks]
        self.sizes = np.concatenate([np.diff(x[1]) for x in found])
        n = int(self.sizes.sum())
        first = np.zeros(n, bool)
        first[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = True
        self.later = np.flatnonzero(~first)  # words that end a pair
        every = np.concatenate([*[x[0] for x in found], np.empty(len(self.later), np.uint64)])  # words, then pairs
        del found, table
        with np.errstate(over="ignore"):
            every[n:] = mix(every[self.later - 1] * _PAIR[0] + every[self.later] * _PAIR[1])
        self.keys, places = np.unique(every, return_inverse=True)
        places = places.astype(np.int32 if len(every) < 1 << 31 else np.int64)
        self.words, self.pairs = places[:n], places[n:]

    def counts(self, targets: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """How often each key occurs in all rows, and in those at ``targets``."""
        chosen = np.zeros(len(self.sizes), bool)
        chosen[targets] = True
        of_target = np.repeat(chosen, self.sizes)
        n = len(self.keys)
        every = np.bincount(self.words, minlength=n) + np.bincount(self.pairs, minlength=n)
        return every, np.bincount(self.words[of_target], minlength=n) + np.bincount(self.pairs[of_target[self.later]], minlength=n)

    def losses(self, counts: tuple[np.ndarray, np.ndarray], totals: tuple[int, int]) -> list[np.ndarray]:
        """Mean bits a word of each row by the background and by the target, from the corpus's counts of the keys."""
        row, out, alone = np.repeat(np.arange(len(self.sizes)), self.sizes), [], None
        for count, total in zip(counts, totals, strict=True):
            own = count[self.words].astype(np.float64)
            alone = own / total if alone is None else (own + PULL * alone) / (total + PULL)
            p = alone.copy()
            p[self.later] = (count[self.pairs] + PRIOR * alone[self.later]) / (own[self.later - 1] + PRIOR)
            out.append(np.bincount(row, -np.log2(p), len(self.sizes)) / np.maximum(self.sizes, 1))  # adds up in the order of the words: equal texts, equal sums
        return out


def _edges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the keys of each shard begin and end: shards are equal ranges of the key space."""
    starts = np.array([-(-(k << 64) // shards) for k in range(shards)], np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


def told(marked: DataFrame, shards: int) -> DataFrame:
    """block, shard, n, keys, background, target: what each block of ``marked`` (block, payload, targets) tells each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, payload, targets in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                block = Block(payload.as_py())
                every, target = block.counts(targets or [])
                edges = _edges(block.keys, shards)
                rows = []
                for shard in np.flatnonzero(np.diff(edges)).tolist():
                    own = slice(edges[shard], edges[shard + 1])
                    rows.append((name, shard, len(block.keys[own]), _squeezed(np.diff(block.keys[own], prepend=_U(0))), _squeezed(every[own]), _squeezed(target[own])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _TOLD, strict=True)], names=["block", "shard", "n", "keys", "background", "target"])

    return marked.select("block", "payload", "targets").mapInArrow(tidy(run), "block long, shard long, n long, keys binary, background binary, target binary")


_TOLD = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())


def _added(table: pa.Table) -> pa.Table:
    """For a shard: block, shard, n, background, target, with the sums over all blocks of what each told."""
    sizes = table.column("n").to_pylist()
    keys = [np.cumsum(_opened(k.as_py(), n), dtype=np.uint64) for k, n in zip(table.column("keys"), sizes, strict=True)]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    ends, out = np.cumsum(sizes), []
    for column in ("background", "target"):
        sent = np.concatenate([_opened(c.as_py(), n) for c, n in zip(table.column(column), sizes, strict=True)])
        sums = np.zeros(len(distinct), np.uint64)
        np.add.at(sums, place, sent)
        out.append(pa.array([_squeezed(sums[place[e - n : e]]) for e, n in zip(ends, sizes, strict=True)], pa.binary()))
    answer = pa.table([table.column("block"), table.column("shard"), table.column("n"), *out], names=["block", "shard", "n", "background", "target"])
    del keys, distinct, place
    give_back()
    return answer


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (bits a word), score (background - target); a row for each row of ``docs``.

    ``target_ids``: doc_id of the target documents.  A null or blank text has no
    words: null losses and score 0.  A text of any length is one row of one block.
    Without targets the target's words are the background's.  Null ids are never
    targets; repeated rows count each time and get equal scores; other columns aren't
    read; an empty table gives none.
    """
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    packs = cut(blocks(plain), "blocks")
    chosen = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    # always by merge: target ids grow with the corpus, so they're broadcast at no size, and the plan is the same at every size
    rows = packs.select("block", F.posexplode(F.arrays_zip("ids", "sizes")).alias("at", "x")).select("block", "at", F.col("x.ids").alias("doc_id"), F.col("x.sizes").alias("size"))
    found = rows.filter("doc_id is not null").join(chosen.hint("merge"), "doc_id").groupBy("block")
    places = cut(found.agg(F.collect_list("at").alias("targets"), F.sum("size").alias("words")), "places")
    whole = packs.agg(F.sum("bytes").alias("bytes"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words")).first()
    totals = whole["words"] or 0, places.agg(F.sum("words")).first()[0] or 0
    marked = packs.select("block", "payload").join(places.select("block", "targets").hint("merge"), "block", "left")
    answers = told(marked, -(-(whole["bytes"] or 1) // SHARD)).groupBy("shard").applyInArrow(_added, "block long, shard long, n long, background binary, target binary")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block, right = Block(left.column("payload")[0].as_py()), right.sort_by("shard")
        sizes = right.column("n").to_pylist()
        counts = tuple(np.concatenate([np.zeros(0, np.uint64), *[_opened(c.as_py(), n) for c, n in zip(right.column(m), sizes, strict=True)]]) for m in ("background", "target"))
        each, none, ids, sizes = block.losses(counts, totals), block.sizes == 0, block.ids, block.sizes
        del block, counts
        give_back()
        return pa.table({"doc_id": ids, "n_tokens": pa.array(sizes), "target_loss": pa.array(each[1], mask=none), "background_loss": pa.array(each[0], mask=none), "score": pa.array(np.where(none, 0.0, each[0] - each[1]))})

    return marked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
