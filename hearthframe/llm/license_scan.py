"""Licence notices: exact phrases by words, and short notices with a few errors, found from exact seeds."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

# Phrases whose words must stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices, in words, with the errors (characters) that each may have.
NOTICES = [
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("licensed under the apache license version 2", "apache-2", 4),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 4),
    ("licensed under the gnu general public license version 3", "gpl-3", 5),
    ("licensed under the gnu general public license version 2", "gpl-2", 5),
    ("gnu lesser general public license", "lgpl", 3),
    ("mozilla public license version 2", "mpl-2", 3),
    ("redistribution and use in source and binary forms", "bsd", 4),
]
#: Lower-cases A-Z and makes a blank of every ASCII character that is no digit or letter; other bytes belong to words.
WORD_BYTES = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def pigeonhole(notice: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces with their starts; at most errors edits leave one of them whole."""
    n, k = len(notice), errors + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Built once in each Python worker."""

    def __init__(self, phrases: dict[str, str], notices: list[tuple[str, str, int]]):
        self.phrases = [(f" {p} ", label) for p, label in phrases.items()]
        self.notices = notices
        self.fuzzy = [regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={errors}}}") for text, _, errors in notices]
        self.seeds = ahocorasick.Automaton()
        by_seed: dict[str, list[tuple[int, int]]] = {}
        for k, (text, _, errors) in enumerate(notices):
            for at, piece in pigeonhole(text, errors):
                by_seed.setdefault(piece, []).append((k, at))
        for piece, places in by_seed.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(notice, begin, end) wherever seeds stand, overlapping stretches of one notice joined."""
        open_: dict[int, tuple[int, int]] = {}
        for last, (width, places) in self.seeds.iter(text):
            for k, at in places:
                notice, _, errors = self.notices[k]
                begin = max(0, last + 1 - width - at - errors)
                end = min(len(text), last + 1 - width - at + len(notice) + errors)
                was = open_.get(k)
                if was and begin <= was[1]:
                    open_[k] = (min(was[0], begin), max(was[1], end))
                else:
                    if was:
                        yield (k, *was)
                    open_[k] = (begin, end)
        for k, was in open_.items():
            yield (k, *was)

    def matches(self, k: int, text: str, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(begin, end, errors) of a notice's matches in a window: exact ones, then the best of what is left on either side."""
        notice, _, errors = self.notices[k]
        left = []
        while (at := text.find(notice, begin, end)) >= 0:
            yield at, at + len(notice), 0
            left.append((begin, at))
            begin = at + len(notice)
        left.append((begin, end))
        while left:
            a, b = left.pop()
            m = self.fuzzy[k].search(text, a, b) if b - a >= len(notice) - errors else None
            if m:
                yield m.start(), m.end(), sum(m.fuzzy_counts)
                left += [(a, m.start()), (m.end(), b)]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, int, float]]]:
        """Words; (word, label) of each phrase; (begin, end, label, errors, score) of each notice, in the words' text."""
        words = (text or "").encode().translate(WORD_BYTES).split()
        plain = b" ".join(words).decode()
        padded, exact = f" {plain} ", []
        for phrase, label in self.phrases:
            at = padded.find(phrase)
            while at >= 0:
                exact.append((padded.count(" ", 0, at), label))
                at = padded.find(phrase, at + 1)
        spans = set()
        for k, begin, end in self.windows(plain):
            notice, label, _ = self.notices[k]
            for a, b, errors in self.matches(k, plain, begin, end):
                spans.add((a, b, label, errors, 1 - errors / len(notice)))
        best: list[tuple[int, int, str, int, float]] = []  # of overlapping spans the one with fewest errors, by place
        longest = max((x[1] - x[0] for x in spans), default=0)
        for span in sorted(spans, key=lambda x: (x[3], x[0], -x[1], x[2])):
            near = best[bisect_left(best, (span[0] - longest,)) : bisect_left(best, (span[1],))]
            if all(span[1] <= x[0] or span[0] >= x[1] for x in near if x[2] != span[2]):
                insort(best, span)
        return len(words), exact, best


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, notices: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """(id, n_words, phrases array<struct<word, label>>, spans array<struct<start, end, label, errors, score>>).

    Only A-Z is lower-cased; words are the runs of digits, letters and characters beyond ASCII. Spans are character
    offsets in the words joined by single blanks. Whole texts, of any length. Null text: no words. Each row is judged
    alone, repeated ones alike; ids pass through as they are, other columns are left out. No rows: none.
    """
    key = (phrases or PHRASES, notices or NOTICES)
    kinds = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("errors", pa.int32()), ("score", pa.float64())]))
    made: list[Scanner] = []  # one in each task

    def run(texts: Iterator[str | None]) -> dict[str, pa.Array]:
        if not made:
            made.append(Scanner(*key))
        found = [made[0].scan(t) for t in texts]
        phrases_ = [[{"word": a, "label": b} for a, b in x[1]] for x in found]
        spans = [[dict(zip(("start", "end", "label", "errors", "score"), s, strict=True)) for s in x[2]] for x in found]
        return {"n_words": pa.array([x[0] for x in found], pa.int64()), "phrases": pa.array(phrases_, kinds[0]), "spans": pa.array(spans, kinds[1])}

    added = "n_words long, phrases array<struct<word:long,label:string>>, spans array<struct<start:long,end:long,label:string,errors:int,score:double>>"
    return map_texts(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), text_col, added, run, keep=False)
