"""Substring dedup by super-k-mer partitioning.

The words of a document that a window of WINDOW consecutive words covers whose word sequence also
starts earlier are removed. Consecutive windows that share a minimiser travel as one packed string
to the minimiser's bucket (repeats.py), once a group with the number of its copies there; in the
bucket all windows are sorted by their words, which counts each word sequence exactly and puts its
earliest place first. Windows counted more than once are covered but for that place.

Edge cases: a null text has no words; a text with fewer words than a window loses none; repeats
within a document count; rows equal in doc_id and text are one document, each gets its result; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import BYTE_HASH, META, PART_UNITS, SPAN, Corpus, Deal, Local, Pieces, Units, by_bucket, one_by_one, ordered, polynomial, ranges, span_rows

WINDOW, ANCHOR = 20, 6

class WordUnits(Units):
    window, anchor = WINDOW, ANCHOR

    def parts(self, raw: bytes) -> list[tuple[int, int, bytes]]:
        words, step = raw.split(), PART_UNITS
        cuts = range(0, max(1, len(words) - self.window + 1), step)
        return [(a, len(x), b" ".join(x)) for a in cuts for x in (words[a : a + step + self.window - 1],)]

    def block(self, parts: list[bytes]):
        text = b" ".join(parts)
        codes = np.frombuffer(text, dtype=np.uint8)
        ends = np.concatenate([np.flatnonzero(codes == 32), [len(codes)]])
        starts = np.concatenate([[0], ends[:-1] + 1])
        return text, polynomial(BYTE_HASH[codes], starts, ends), starts, ends

    def windows(self, text: bytes) -> list[bytes]:
        return windows_of(text)

    def local(self) -> Local:
        return GroupCounts(self)


def windows_of(text: bytes) -> list[bytes]:
    """The windows of words parted by one space."""
    ends = list(accumulate((len(w) for w in text.split(b" ")), lambda a, n: a + n + 1))
    starts = [0, *(x + 1 for x in ends)]
    return [text[a:b] for a, b in zip(starts, ends[WINDOW - 1 :], strict=False)]


class GroupCounts(Local):
    """A group's super-k-mers, each distinct text once with how often it stands in the group; its later places are covered by its first."""

    def __init__(self, units: Units):
        self.units, self.number, self.hashes, self.meta, self.copies = units, {}, [], [], []
        self.covered: list[tuple] = []

    def take(self, document: tuple, h: int, hot: bool, first: int, windows: int, text: bytes) -> None:
        for key, place, piece in one_by_one(self.units, text, first) if hot else ((h, first, text),):
            n = 1 if hot else windows
            at = self.number.setdefault(piece, len(self.meta))
            if at < len(self.meta):
                self.copies[at] += 1
                self.covered.append((*document, place, place + n + WINDOW - 1))
                continue
            self.hashes.append(key)
            self.copies.append(1)
            self.meta.append((*document, place, n, len(piece)))

    def finish(self) -> tuple[np.ndarray, Pieces, list[np.ndarray]]:
        columns = zip(*self.meta, strict=True) if self.meta else ([],) * (len(META) - 1)
        meta = [np.array(x, dtype=kind) for x, kind in zip((*columns, self.copies), META, strict=True)]
        spans = [np.array(x, dtype=kind) for x, kind in zip(zip(*self.covered, strict=True) if self.covered else ([],) * len(SPAN), SPAN, strict=True)]
        return np.array(self.hashes, dtype=np.uint64), Pieces(meta, list(self.number)), spans


def counted(pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a bucket's pieces sorted: of each its piece and number in it, how often its words stand in the corpus, and whether it is the first of them."""
    number: dict[bytes, int] = {}
    words = [number.setdefault(w, len(number)) for text in pieces.texts for w in text.split(b" ")]
    windows = pieces.meta[4].astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(windows + WINDOW - 1)])[:-1]
    owner = np.repeat(np.arange(len(windows)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    rank = ordered(np.array(words, dtype=np.int64), 1, WINDOW)[1][np.repeat(offsets, windows) + inside]
    _, first, content = np.unique(rank, return_index=True, return_inverse=True)  # pieces are in order, so the first of equals is the earliest
    count = np.bincount(content, weights=pieces.meta[6][owner]).astype(np.int64)
    alone = np.zeros(len(owner), dtype=bool)
    alone[first] = True
    return owner, inside, count[content], alone


def _bucket_spans(deal: Deal):
    """(bucket, blob) of pieces, sorted by bucket -> (bucket, blob) of spans, with groups for buckets: windows whose count is over 1, but for the first of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket((b.append_column("n", b.column(0)).select(["bucket", "n", "blob"]) for b in batches)):
            pieces = Pieces.read([blob for _, blob in rows])
            owner, inside, count, first = counted(pieces)
            a, b = ranges((count > 1) & ~first, np.flatnonzero(inside == 0))
            start = pieces.meta[3][owner[a]] + inside[a]
            for g, blob in span_rows(deal, pieces.spans(owner[a], start, start + b - a + WINDOW - 1)):
                yield pa.record_batch([pa.array([g], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])

    return run


def cut_words(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
    words, at, out = raw.split(), 0, []
    for a, b in spans:
        out += words[at:a]
        at = b
    return len(words), b" ".join([*out, *words[at:]])


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """(doc_id, n_units, spans, kept) of each row: words, the spans of words removed, and the words left."""
    corpus = Corpus(docs, WordUnits())
    pieces = corpus.pieces()
    spans = corpus.by_bucket(pieces.read(1, 0)).mapInArrow(_bucket_spans(corpus.deal), "bucket int, blob binary")
    return corpus.cut(pieces.read(0, 0).unionByName(spans), cut_words)
