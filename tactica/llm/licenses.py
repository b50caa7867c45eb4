"""License scans: exact phrases, and fuzzy short notices by pigeonhole seeds.

A notice with at most e edits, cut into e + 1 pieces, keeps one piece unharmed. An automaton of all
pieces finds those places in one pass; only around them the regex library's bounded-error matching
decides, and reports the span and the number of edits. One map over the documents, no shuffle.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import table, text_or_empty

#: Fixed phrases and the labels they stand for.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices, as words, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license version 3": "gpl",
    "redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under the creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 12
#: Words are ASCII letters and digits and everything outside ASCII; A-Z are lowered.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


class Scanner:
    def __init__(self, notices: dict[str, str] = NOTICES, phrases: dict[str, str] = PHRASES, chars_per_edit: int = CHARS_PER_EDIT):
        self.phrases = {f" {p} ": label for p, label in phrases.items()}
        self.notices, seeds = [], {}
        for text, label in notices.items():
            edits = max(1, len(text) // chars_per_edit)
            # whole words only; of all matches within the bound, the best
            pattern = regex.compile(f"(?b)(?<= )(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}(?= )")
            cuts = [i * len(text) // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(text[a:b], []).append((len(self.notices), a))
            self.notices.append((text, label, edits, pattern))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def words(self, text: str) -> list[bytes]:
        return text.encode().translate(WORDS).split()

    def base(self, line: str, word_at) -> list[tuple[str, int]]:
        """(label, first word) of every place of a phrase in the words joined by spaces."""
        out = []
        for phrase, label in self.phrases.items():
            at = line.find(phrase)
            while at >= 0:
                out.append((label, word_at(at + 1)))
                at = line.find(phrase, at + 1)
        return out

    def _matches(self, k: int, starts: list[int], line: str) -> list[tuple[int, int, int]]:
        """(edits, start, end) of notice ``k`` around its seeds; of overlapping ones the nearest, then the first."""
        text, _, edits, pattern = self.notices[k]
        found = set()
        for a in starts:
            if m := pattern.search(line, max(0, a), min(len(line), a + len(text) + 2 * edits + 2)):
                found.add((sum(m.fuzzy_counts), m.start(), m.end()))
        taken: list[tuple[int, int, int]] = []  # by start, none overlapping
        for m in sorted(found):
            i = bisect.bisect(taken, m[1], key=lambda x: x[1])
            if (not i or taken[i - 1][2] <= m[1]) and (i == len(taken) or m[2] <= taken[i][1]):
                taken.insert(i, m)
        return taken

    def fuzzy(self, line: str, word_at) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, end word, edits, likeness) of verified notices."""
        starts: dict[int, set[int]] = {}
        for end, (size, uses) in self.seeds.iter(line):
            for k, offset in uses:
                starts.setdefault(k, set()).add(end + 1 - size - offset - self.notices[k][2] - 1)
        out = []
        for k, places in starts.items():
            text, label, _, _ = self.notices[k]
            out += [(label, word_at(a), word_at(b - 1) + 1, wrong, 1 - wrong / len(text)) for wrong, a, b in self._matches(k, sorted(places), line)]
        out.sort(key=lambda x: (x[1], x[2], x[0]))
        # of overlapping notices of different labels the nearest stays; equally near ones all do
        longest = max((x[2] - x[1] for x in out), default=0)
        firsts = [x[1] for x in out]
        near = lambda x: out[bisect.bisect_left(firsts, x[1] - longest) : bisect.bisect_left(firsts, x[2])]
        return [x for x in out if not any(y[0] != x[0] and y[2] > x[1] and y[4] > x[4] for y in near(x))]

    def scan(self, text: str) -> tuple[int, list, list]:
        words = self.words(text)
        # Latin-1 keeps one character for a byte; notices are ASCII
        line = " " + b" ".join(words).decode("latin-1") + " "
        starts: list[int] = []  # where words start; only texts with a hit need them

        def word_at(place: int) -> int:
            if not starts:
                starts.extend(itertools.accumulate((len(w) + 1 for w in words), initial=1))
            return bisect.bisect_right(starts, place) - 1

        return len(words), self.base(line, word_at), self.fuzzy(line, word_at)


def scan_licenses(docs: DataFrame, text_col: str = "text", notices: dict[str, str] = NOTICES) -> DataFrame:
    """doc_id, n_words, base (label, first_word) and notices (label, first_word, end_word, edits, likeness).

    Null and empty texts have no words and no places; repeated rows and null ids are scanned like
    any others; other columns are not looked at. Of overlapping places of one notice the nearest is
    reported (equally near: the first), of overlapping notices of different labels the nearest (equally
    near: all).
    """
    base = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))
    found = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("likeness", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for b in batches:
            rows = [scanner.scan(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([[dict(zip(("label", "first_word"), x, strict=True)) for x in r[1]] for r in rows], base),
                 pa.array([[dict(zip(("label", "first_word", "end_word", "edits", "likeness"), x, strict=True)) for x in r[2]] for r in rows], found)],
                ["doc_id", "n_words", "base", "notices"])

    schema = "doc_id long, n_words long, base array<struct<label:string,first_word:long>>, notices array<struct<label:string,first_word:long,end_word:long,edits:int,likeness:double>>"
    return docs.select("doc_id", text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def query(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "n_words", "cast(size(base) AS long) AS n_base",
        "array_min(base.first_word) AS first_word", "array_max(base.first_word) AS last_word",
        "array_join(array_sort(array_distinct(base.label)), ',') AS base_labels",
        "array_join(array_sort(array_distinct(concat(base.label, notices.label))), ',') AS labels",
        "CASE WHEN size(base) > 0 THEN 1D ELSE coalesce(array_max(notices.likeness), 0D) END AS score",
        "array_join(transform(notices, x -> concat_ws(':', x.label, x.first_word, x.end_word, x.edits)), ',') AS notices")
