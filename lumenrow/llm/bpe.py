"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece there is exactly one token that can end its encoding.
``PrefixEncoder`` stores that token for each prefix: bytes appended later only
extend the table (``append``), and an edit re-encodes from the edited byte until
the new table agrees with the old one (``replace``).  Two tokens may stand side
by side when no merge would have crossed the seam before both were complete;
that is read off the right spine of the first and the left spine of the second.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textwords import tidy

NEVER = 1 << 62


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Vocabulary:
    """Ranks, the two parts each token is merged from, and which pairs may be neighbours."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks), default=0)
        self.right: dict[int, tuple[list[int], list[int]]] = {}
        self.left: dict[int, tuple[list[int], list[int]]] = {}
        self.pairs: dict[int, bool] = {}  #: (first << 32 | second): whether they may be neighbours
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.whole: dict[int, bool] = {}
        #: Every prefix of a token; its own rank if it may stand inside a piece, else -1.
        self.prefixes: dict[bytes, int] = {}
        for token, rank in ranks.items():
            for end in range(1, len(token)):
                self.prefixes.setdefault(token[:end], -1)
            if self.reachable(rank):
                self.prefixes[token] = rank

    def merge(self, piece: bytes) -> list[int]:
        """Plain merging, lowest rank first and leftmost among equals; used on single tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if best == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte."""
        if token not in self.parts:
            piece = self.tokens[token]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 2:
                best, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if best == NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.parts[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
            self.whole[token] = len(parts) <= 2
        return self.parts[token]

    def reachable(self, token: int) -> bool:
        """Whether merging its own bytes gives this token; a token that fails this can't stand inside a piece."""
        self.split(token)
        return self.whole[token]

    def spine(self, token: int, side: int, memo: dict[int, list[int]]) -> list[int]:
        """From the outermost byte up to the token itself; side 1: right, 0: left."""
        if token not in memo:
            chain, x = [token], token
            while (parts := self.split(x)) is not None:
                x = parts[side]
                chain.append(x)
            memo[token] = chain[::-1]
        return memo[token]

    def neighbours(self, a: int, b: int) -> bool:
        got = self.pairs.get(a << 32 | b)
        if got is None:
            xs, ys, tokens, ranks = self.spine(a, 1, self.right), self.spine(b, 0, self.left), self.tokens, self.ranks
            i = j = 0
            while True:
                grow_x = xs[i + 1] if i + 1 < len(xs) else NEVER
                grow_y = ys[j + 1] if j + 1 < len(ys) else NEVER
                cross = ranks.get(tokens[xs[i]] + tokens[ys[j]], NEVER)
                if cross < grow_x and cross <= grow_y and cross != NEVER:  # of equal merges the left one goes first
                    got = False
                    break
                if grow_x == NEVER and grow_y == NEVER:
                    got = True
                    break
                if grow_x <= grow_y:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= 1_500_000:
                self.pairs.clear()
            self.pairs[a << 32 | b] = got
        return got


class PrefixEncoder:
    """The encoding of one piece, kept as the last token of each of its prefixes."""

    def __init__(self, vocab: Vocabulary, piece: bytes = b"") -> None:
        self.vocab, self.piece, self.last = vocab, b"", []
        self.append(piece)

    def _extend(self, upto: int) -> None:
        """Fill the table to ``upto``: from each start in turn, all tokens that begin there and may follow what ends there."""
        vocab, piece, last, done = self.vocab, self.piece, self.last, len(self.last)
        find, pairs, may_follow = vocab.prefixes.get, vocab.pairs.get, vocab.neighbours
        last.extend([-1] * (upto - done))
        for start in range(max(0, done - vocab.longest + 1), upto):
            before, end = last[start - 1] << 32 if start else -1, start + 1
            while end <= upto and (token := find(piece[start:end])) is not None:
                if end > done and token >= 0 and last[end - 1] < 0:
                    if not start or (ok := pairs(before | token)) or ok is None and may_follow(before >> 32, token):
                        last[end - 1] = token
                end += 1
            if start >= done and last[start] < 0:
                raise ValueError("the vocabulary lacks a byte")

    def append(self, data: bytes) -> PrefixEncoder:
        self.piece += data
        self._extend(len(self.piece))
        return self

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put ``data`` in place of bytes [start, end); returns how many prefixes were computed again.

        The table is right again once, past the edit, as many entries in a row as the
        longest token has bytes equal the old ones: what follows depends on those alone.
        """
        old, tail = self.last, self.piece[end:]
        self.piece = self.piece[:start] + data + tail
        shift, edited = len(data) - (end - start), start + len(data)
        self.last = old[:start]
        n, at = len(self.piece), start
        while at < n:
            upto = min(n, max(at, edited) + self.vocab.longest)
            self._extend(upto)
            at = upto
            if upto - edited >= self.vocab.longest and self.last[upto - self.vocab.longest :] == old[upto - shift - self.vocab.longest : upto - shift]:
                self.last += old[upto - shift :]
                break
        return at - start

    def ids(self) -> list[int]:
        out, at = [], len(self.last)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocab.tokens[out[-1]])
        return out[::-1]


class Codec:
    """Encodes and decodes whole texts; pieces seen before come from a bounded memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = 700_000) -> None:
        self.vocab, self.find, self.memory = Vocabulary(ranks), regex.compile(pattern).findall, memory
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            data = piece.encode()
            whole = self.vocab.ranks.get(data)
            ids = [whole] if whole is not None else PrefixEncoder(self.vocab, data).ids()
            got = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(data := piece) <= 64:
            if len(self.seen) >= self.memory // 2:
                self.older, self.seen = self.seen, {}
            self.seen[data] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, get, make = [], self.seen.get, self.piece
        seen = self.seen
        for piece in self.find(text):
            got = get(piece)
            if got is None:
                got = make(piece)
                if self.seen is not seen:
                    seen = self.seen
                    get = seen.get
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.tokens.__getitem__, memoryview(ids).cast("I")))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(raw: bytes, pattern: str) -> Codec:
    """One codec for each Python worker: its memory of pieces serves all tasks that the worker runs."""
    key = hashlib.sha256(raw).hexdigest(), pattern
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(raw), pattern)
    return _CODECS[key]


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode the ids again; one row for each row of ``docs``.

    ``ranks_path`` is read on the driver and broadcast (its size is the vocabulary's,
    whatever the input).  Null text counts as empty: no tokens.  Texts of any length
    are encoded whole.  A null id stays null; repeated rows give equal rows; other
    columns aren't read; an empty table gives none.  ``with_ids``
    adds ``token_ids`` binary, the ids as little-endian unsigned 32-bit integers.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(Path(ranks_path).read_bytes())
    arrow = _ARROW.append(pa.field("token_ids", pa.binary())) if with_ids else _ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped.value, pattern)
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = codec.encode(t.as_py() or "")
                back = codec.decode(ids)
                rows.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), *([ids] * with_ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)] if rows else [pa.array([], f.type) for f in arrow], schema=arrow)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), SCHEMA + (", token_ids binary" if with_ids else ""))
