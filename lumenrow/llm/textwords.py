"""Words of many texts at once: spans and 64-bit hashes, by whole-array operations on UTF-8 bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
BASE = 0xD6E8FEB86659FD93
_U = np.uint64


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` (a function over batches) that gives freed memory back when its task ends; Python workers live on between tasks."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed << 20)) * _U(0x9E3779B97F4A7C15))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256)
    lower[65:91] += 32
    values = stream(7, 256)[lower] | _U(1)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(CHUNK, BASE, np.uint64))
        inverse = np.cumprod(np.full(CHUNK, pow(BASE, -1, 1 << 64), np.uint64))
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return values, power, inverse, space


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = isinstance(column, pa.LargeStringArray)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[off[0] : off[-1]], off - off[0]


def _long_word(data: np.ndarray, at: int, row_end: int) -> tuple[int, np.ndarray]:
    """End and hash of the word from ``at``, whatever its length: by pieces, each moved to its place in the word."""
    values, power, inverse, space = _tables()
    total, start = 0, at
    while at < row_end:
        piece = data[at : min(row_end, at + CHUNK)]
        gaps = np.flatnonzero(space[piece])
        if len(gaps):
            piece = piece[: gaps[0]]
        own = int((values[piece] * power[: len(piece)]).sum()) * int(inverse[0])
        total = (total + own * pow(BASE, at - start, 1 << 64)) % (1 << 64)
        at += len(piece)
        if len(gaps):
            break
    return at, mix(np.array([(total + at - start) % (1 << 64)], np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of each row, A-Z lower-cased, in order; where each row's words begin and end."""
    values, power, inverse, space = _tables()
    n = len(data)
    counts = np.zeros(len(offsets) - 1, np.int64)
    parts: list[np.ndarray] = []
    at = 0
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:  # cut at a row's end or after a separator; a word that fills the chunk is taken whole
            row_end = offsets[np.searchsorted(offsets, end, "right") - 1]
            if row_end > at:
                end = int(row_end)
            else:
                gaps = np.flatnonzero(space[data[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:
                    row = int(np.searchsorted(offsets, at, "right")) - 1
                    at, word_hash = _long_word(data, at, int(offsets[row + 1]))
                    parts.append(word_hash)
                    counts[row] += 1
                    continue
        chunk = data[at:end]
        apart = space[chunk]
        edge = np.zeros(len(chunk) + 1, bool)
        edge[0] = edge[-1] = True
        first, last = np.searchsorted(offsets, [at, end])
        edge[offsets[first:last] - at] = True
        edge[1:-1] |= apart[1:] | apart[:-1]
        marks = np.flatnonzero(edge)
        starts, ends = marks[:-1], marks[1:]
        word = ~apart[starts]
        starts, ends = starts[word], ends[word]
        if len(starts):
            total = np.empty(len(chunk) + 1, np.uint64)
            total[0] = 0
            np.cumsum(values[chunk] * power[: len(chunk)], out=total[1:])
            parts.append(mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
            counts += np.bincount(np.searchsorted(offsets, starts + at, "right") - 1, minlength=len(counts))
        at = end
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), bounds


def slices(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text; a longer text makes a range of its own."""
    _, off = strings(column)
    start, n = 0, len(column)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + most, "right")) - 1)
        yield start, min(n, stop)
        start = min(n, stop)
