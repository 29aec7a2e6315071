"""License scans: fuzzy search for short notices.

A text is folded to its words (A-Z lowered), joined by one space. A notice that may differ in k
characters is split into k + 1 pieces; by the pigeonhole principle one piece stands unchanged in
every occurrence within k edits, so exact searches for the pieces find all places to look at. At
each, the regex library's bounded-error matching verifies the notice in the part of the text where
it can lie and reports its span of whole words and its edits. A license is told from its neighbours by
a word or two, which a match must have nearly unchanged (Notice.telling), so that the edits can't be
spent on making another license of it. The exact phrases are notices with no edits: their only piece
is the whole phrase.

Whole texts are searched; nothing is shuffled, and memory is bounded by an Arrow batch.

Edge cases: a null text has no words; repeated rows are scanned each on its own; an empty table
gives an empty result; a text without notices has null first and last words, empty labels, score 0.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_pass, texts_of


@dataclass(frozen=True)
class Notice:
    """Words that tell a license; errors: how many characters may differ; telling: words of them that a match has with `told` edits at most, or with letters put in alone."""

    phrase: str
    label: str
    errors: int = 0
    telling: str = ""
    told: int = 1


#: The base: exact phrases.
PHRASES = (
    Notice("gnu general public license", "gpl"),
    Notice("apache license", "apache"),
    Notice("cc by", "cc-by"),
    Notice("mit license", "mit"),
)
#: Short notices of the licenses' own texts, searched with errors.
NOTICES = (
    Notice("gnu general public license", "gpl", 3, "gnu"),
    Notice("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", 8, "gnu general", 2),
    Notice("gnu lesser general public license", "lgpl", 3, "lesser"),
    Notice("gnu affero general public license", "agpl", 3, "affero"),
    Notice("licensed under the apache license version 2 0", "apache", 4, "apache"),
    Notice("creative commons attribution", "cc-by", 3, "attribution"),
    Notice("licensed under cc by", "cc-by", 2, "cc by", 0),
    Notice("released under the mit license", "mit", 3, "mit"),
    Notice("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", 7, "software"),
    Notice("redistribution and use in source and binary forms with or without modification", "bsd", 7),
    Notice("mozilla public license", "mpl", 2, "mozilla"),
    Notice("eclipse public license", "epl", 2, "eclipse"),
    Notice("permission to use copy modify and or distribute this software for any purpose", "isc", 7),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 6),
)

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded(text: str) -> bytes:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the lowered text, each followed by one space, after a space."""
    words = text.encode("utf-8", "replace").translate(_FOLD).split(b" ")
    return b" " + b"".join([w + b" " for w in words if w])


def pieces(phrase: str, errors: int) -> list[tuple[int, bytes]]:
    """errors + 1 parts of the phrase with their places in it."""
    raw, n = phrase.encode(), errors + 1
    cuts = [len(raw) * i // n for i in range(n + 1)]
    return [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def patterns_of(x: Notice) -> tuple[regex.Pattern, regex.Pattern]:
    """Whole words that are the notice within its errors: for the leftmost match, and for the best within it."""
    source = rb"(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(x.phrase.encode(), literal_spaces=True), x.errors)
    return regex.compile(source), regex.compile(source, regex.BESTMATCH)


class Telling:
    """The words of a notice that tell its license."""

    def __init__(self, notice: Notice):
        self.size, self.none = notice.telling.count(" ") + 1, not notice.telling
        escaped = regex.escape(notice.telling.encode(), literal_spaces=True)
        self.near = regex.compile(rb"(?:%s){e<=%d}" % (escaped, notice.told))
        self.longer = regex.compile(rb"(?:%s){i<=%d}" % (escaped, notice.errors if notice.told else 0))

    def among(self, matched: bytes) -> bool:
        words = matched.split(b" ")

        def parts(n: int) -> Iterator[bytes]:
            return (b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))

        # A blank put in or left out changes the number of words; letters put in don't.
        near = (x for n in {self.size, max(1, self.size - 1), self.size + 1} for x in parts(n))
        return self.none or any(map(self.near.fullmatch, near)) or any(map(self.longer.fullmatch, parts(self.size)))


def places(text: bytes, seed: bytes) -> Iterator[int]:
    at = text.find(seed)
    while at >= 0:
        yield at
        at = text.find(seed, at + 1)


class Scanner:
    """Phrases and notices with their pieces and patterns, made once for each task."""

    def __init__(self, phrases: tuple[Notice, ...] = PHRASES, notices: tuple[Notice, ...] = NOTICES):
        self.phrases, self.notices = phrases, []
        for x in notices:
            self.notices.append((x, pieces(x.phrase, x.errors), *patterns_of(x), Telling(x)))

    def exact(self, text: bytes) -> list[tuple[int, str]]:
        """(place, label) of each phrase's occurrences as whole words; the place is of the first word's first byte."""
        return sorted((at + 1, x.label) for x in self.phrases for at in places(text, b" " + x.phrase.encode() + b" "))

    def fuzzy(self, text: bytes) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of the notices within their errors, bytes of the folded text; none overlaps another of its notice."""
        out = []
        for notice, parts, *checks in self.notices:
            size, most = len(notice.phrase), notice.errors
            # Where a piece stands the notice starts at most `errors` bytes off.
            starts = sorted({at - offset for offset, seed in parts for at in places(text, seed)})
            end, group = -1, []
            for s in starts:  # neighbours share one window
                if group and s - group[-1] <= 2 * most:
                    group.append(s)
                    continue
                end = self._verify(text, group, size, most, checks, notice, end, out)
                group = [s]
            self._verify(text, group, size, most, checks, notice, end, out)
        return sorted(out)

    @staticmethod
    def _verify(text: bytes, group: list[int], size: int, most: int, checks: list, notice: Notice, end: int, out: list) -> int:
        """Adds what the window around group's starts holds; returns the end of the last span added."""
        if not group:
            return end
        pattern, best, telling = checks
        # A byte before the first word and one after the last are their borders.
        lo, hi = max(0, end, group[0] - most - 1), min(len(text), group[-1] + size + 2 * most + 1)
        while (m := pattern.search(text, lo, hi)) is not None:
            start, m = m.start(), best.search(text, m.start(), m.end() + 1) or m
            if m.end() > m.start() and telling.among(m.group()):
                out.append((m.start(), m.end(), notice.label, sum(m.fuzzy_counts)))
                end = lo = m.end()
            else:
                lo = start + 1
        return end


def scan_licenses(docs: DataFrame, phrases: tuple[Notice, ...] = PHRASES, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(doc_id, n_words, places, spans) of each row.

    places: the exact phrases' occurrences as (word, label); spans: the fuzzy notices as
    (first_word, last_word, label, edits, similarity), words counted from 0, similarity 1 less edits by phrase length.
    """
    held: list[Scanner] = []
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("edits", pa.int32()), ("similarity", pa.float64())]))

    def one(text: str) -> tuple[int, list[dict], list[dict]]:
        flat = folded(text)
        found, near = held[0].exact(flat), held[0].fuzzy(flat)
        if not found and not near:
            return flat.count(b" ") - 1, [], []
        blanks = [i for i, c in enumerate(flat) if c == 32]

        def word(at: int) -> int:
            return max(0, bisect_right(blanks, at) - 1)

        spans = [{"first_word": word(a), "last_word": word(max(a, b - 1)), "label": x, "edits": n, "similarity": max(0.0, 1 - n / (b - a))} for a, b, x, n in near]
        return len(blanks) - 1, [{"word": word(at), "label": x} for at, x in found], spans

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held or held.append(Scanner(phrases, notices))
        rows = [one(x) for x in texts_of(batch.column(1))]
        columns = [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], place), pa.array([x[2] for x in rows], span)]
        yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "n_words", "places", "spans"])

    schema = "doc_id long, n_words long, places array<struct<word:long,label:string>>, spans array<struct<first_word:long,last_word:long,label:string,edits:int,similarity:double>>"
    return arrow_pass(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, schema)
