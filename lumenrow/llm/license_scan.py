"""License scans: short notices found with a bounded number of edits.

A notice with k edits allowed is split into k + 1 pieces; whatever matches it
within k edits holds one of them unchanged (pigeonhole).  One Aho-Corasick pass
over a text's words finds the pieces; the ``regex`` library's bounded-error
matching then verifies the edits around each and gives the span.  Base phrases are
matched word by word without edits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textwords import tidy

# Phrases of words and their labels, matched exactly.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Short notices of public licenses as lower-case words, and their labels, matched with edits.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the apache license version 2 0": "apache",
    "this program is free software you can redistribute it and or modify": "gpl-notice",
    "under the mit license": "mit-mention",
    "released under the creative commons attribution": "cc-notice",
    "this work is licensed under a creative commons": "cc-notice",
    "mozilla public license version 2 0": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "the software is provided as is without warranty of any kind": "as-is",
}
#: One edit is allowed for so many characters of a notice.
PER_EDIT = 12
#: Characters of the grams that a window is tried by before it's matched.
GRAM = 3

_APART = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ in UTF-8."""
    return [w for w in (text or "").encode().translate(_APART).split(b" ") if w]


@dataclass
class Span:
    """A verified notice: places in the words joined by single spaces, edits as substitutions, insertions, deletions."""

    label: str
    start: int
    end: int
    edits: int


def grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str], per_edit: int) -> None:
        self.base = [(f" {phrase} ", label) for phrase, label in base.items()]
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for phrase, label in notices.items():
            k = max(1, len(phrase) // per_edit)
            cuts = [len(phrase) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                found.setdefault(phrase[a:b], []).append((len(self.notices), a))
            own = grams(phrase)
            self.notices.append((phrase, label, k, regex.compile(f"(?b)(?:{regex.escape(phrase, literal_spaces=True)}){{e<={k}}}"), own, len(own) - GRAM * k))
        for piece, uses in found.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def fuzzy(self, joined: str) -> list[Span]:
        """Spans of notices in words joined by single spaces, none overlapping for one notice; of overlapping matches the one with fewer edits stays.

        Each seed has a window that holds whatever match it's part of; the time is
        proportional to the number of seeds.  An edit spoils at most ``GRAM`` of a
        notice's grams, so a window that lacks more of them needs no matching.
        """
        windows, found = set(), []
        for last, (size, uses) in self.seeds.iter(joined):
            for n, offset in uses:
                phrase, _, k, *_ = self.notices[n]
                start = last + 1 - size - offset - k
                windows.add((n, max(0, start), min(len(joined), start + len(phrase) + 2 * k)))

        def match(n: int, start: int, end: int) -> None:
            phrase, _, k, pattern, own, least = self.notices[n]
            if end - start >= len(phrase) - k and len(own & grams(joined[start:end])) >= least and (m := pattern.search(joined, start, end)):
                heappush(found, (sum(m.fuzzy_counts), m.start(), m.end(), n, start, end))

        for window in windows:
            match(*window)
        taken: dict[int, list[tuple[int, int]]] = {}
        spans = []
        while found:
            edits, start, end, n, low, high = heappop(found)
            own = taken.setdefault(n, [])
            at = bisect_left(own, (start, start))
            over = [x for x in own[max(0, at - 1) : at + 1] if x[0] < end and x[1] > start]
            if over:  # what the window has before and after the span taken
                if over[0] != (start, end):
                    match(n, low, over[0][0])
                    match(n, over[-1][1], high)
                continue
            own.insert(at, (start, end))
            spans.append(Span(self.notices[n][1], start, end, edits))
        return sorted(spans, key=lambda s: (s.start, s.end, s.label))

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
        words = words_of(text)
        padded = f" {b' '.join(words).decode()} "
        places, labels = [], set()
        for phrase, label in self.base:
            at, before, word = padded.find(phrase), 0, 0
            while at >= 0:
                word += padded.count(" ", before, at)
                places.append(word)
                labels.add(label)
                at, before = padded.find(phrase, at + 1), at
        spans = self.fuzzy(padded[1:-1]) if words else []
        both = labels | {s.label for s in spans}
        best = max([0.0, *(1.0 for _ in places[:1]), *(max(0.0, 1 - s.edits / max(1, s.end - s.start)) for s in spans)])
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(both)), best, [vars(s) for s in spans]


@lru_cache(4)
def _scanner(base: tuple, notices: tuple, per_edit: int) -> Scanner:
    return Scanner(dict(base), dict(notices), per_edit)


_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None, per_edit: int = PER_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: base phrases counted, notices verified with their spans.

    Null text counts as empty: no words, no labels, score 0, null word places.  Texts
    of any length are scanned whole.  A null id stays null; repeated rows give equal
    rows; other columns aren't read; an empty table gives none.  score: 1 with a base phrase, else the best notice's
    share of unchanged characters, else 0.
    """
    key = tuple((BASE if base is None else base).items()), tuple((NOTICES if notices is None else notices).items()), per_edit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(*key).scan
        for batch in batches:
            rows = [(i, *scan(t.as_py())) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: bigint, end: bigint, edits: bigint>>")
