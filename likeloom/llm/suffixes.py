"""Suffix-array dedup with a logarithmic index family.

The bytes of a document that a WINDOW-byte string covers which also starts earlier are removed.

Groups of documents (repeats.py) are dealt into batches, and the family takes in batch after batch:
 * each group of a batch gets the suffix array of its texts, as far as their minimisers stand more
   than once in the corpus (suffixes by their first WINDOW bytes, compared as numbers word by word
   as far as those tell them apart). Neighbours with WINDOW bytes in common are repeats: the earliest
   stays, the others are covered; the distinct suffixes left go, as texts, to the buckets of their
   minimisers;
 * a bucket of the batch gets the suffix array of what its groups sent, and is merge-scanned against
   the same bucket's sorted array of every level there is; of two equal windows the later is covered;
 * what is left becomes a level, a table in the shared folder with a sorted array for each bucket.
   Levels that hold equally many batches are merged into one as binary digits carry: after n
   batches there are log2(n) + 1 levels at most, and a suffix is merged log2(n) times.
The last batch's level isn't written, as nothing is scanned against it.

Edge cases: a null text counts as empty; a text shorter than a window loses nothing; repeats within
a document count, overlapping ones too; rows equal in doc_id and text are one document, each gets
its result; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import BYTE_HASH, META, PART_UNITS, SPAN, Corpus, Deal, Local, Pieces, Run, Units, one_by_one, polynomial, ranges, span_rows
from .shared import Table, packed, unpacked

WINDOW, ANCHOR = 100, 32
#: Bytes that are compared as one number.
WORD = 8
#: Batches that the corpus comes in.
BATCHES = 4
#: Bytes of text that one suffix array within a group is made for, and windows of one within a bucket.
BATCH_BYTES, PART = 1 << 20, 1 << 20
#: A merge-scan holds so many windows at once.
SCAN = 1 << 16


class ByteUnits(Units):
    window, anchor = WINDOW, ANCHOR

    def parts(self, raw: bytes) -> list[tuple[int, int, bytes]]:
        step = PART_UNITS
        cuts = range(0, max(1, len(raw) - self.window + 1), step)
        return [(a, len(x), x) for a in cuts for x in (raw[a : a + step + self.window - 1],)]

    def block(self, parts: list[bytes]):
        text = b"".join(parts)
        return text, BYTE_HASH[np.frombuffer(text, dtype=np.uint8)], None, None

    def anchors(self, unit_hash: np.ndarray) -> np.ndarray:
        at = np.arange(len(unit_hash) - ANCHOR + 1)
        return polynomial(unit_hash, at, at + ANCHOR)

    def windows(self, text: bytes) -> list[bytes]:
        return [text[i : i + WINDOW] for i in range(len(text) - WINDOW + 1)]

    def local(self) -> Local:
        return GroupArrays(self)


# ---- suffix arrays -------------------------------------------------------------------------------


def bytes_at(text: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from places of a text as fixed-width byte strings, which numpy orders as bytes."""
    if not len(places):
        return np.zeros(0, dtype=f"S{n}")
    return np.ndarray(len(text) - n + 1, f"S{n}", text, strides=(1,))[places]


def windows_at(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return bytes_at(text, starts, WINDOW)


def words_at(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The WORD bytes from places of a text as numbers, which are ordered as the bytes."""
    if not len(places):
        return np.zeros(0, dtype=np.uint64)
    return np.ndarray(len(text) - WORD + 1, ">u8", text, strides=(1,))[places].astype(np.uint64)


def changes(x: np.ndarray) -> np.ndarray:
    """Whether each is another than the one before it."""
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a == b for byte strings whose width is a multiple of four."""
    x, y = (s.view("<u4").reshape(len(s), s.itemsize // 4) for s in (a, b))
    return (x == y).all(axis=1)


def within(group: np.ndarray, by: np.ndarray) -> np.ndarray:
    """An order made one by group first; groups are numbers under 2 ** 32."""
    keys = (group[by].astype(np.uint64) << np.uint64(32)) | np.arange(len(by), dtype=np.uint64)
    keys.sort()
    return by[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def suffix_array(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ascending starts ordered by their first WINDOW bytes, which is as far as a repeat must reach: which are the first of their content, and those by number in their order.

    They are sorted by a first word as numbers, those tied by a second one, and those tied then as
    strings, unless all of a tie are equal.
    """
    fresh = np.zeros(len(starts), dtype=bool)
    if not len(starts):
        return fresh, np.zeros(0, dtype=np.int64)
    words = words_at(text, starts)
    order = np.argsort(words)
    new = changes(words[order])
    tied, group, part = _ties(order, new)
    words = words_at(text, starts[part] + WORD)
    by = within(group, np.argsort(words))
    order[tied], new[tied] = part[by], changes(group) | changes(words[by])
    tied, group, part = _ties(order, new)
    rest = bytes_at(text, starts[part] + 2 * WORD, WINDOW - 2 * WORD)
    several = np.zeros(len(starts) + 1, dtype=bool)
    several[group[1:][~equal(rest[1:], rest[:-1]) & (group[1:] == group[:-1])]] = True
    mixed = np.flatnonzero(several[group])
    tied, group, part, rest = tied[mixed], group[mixed], part[mixed], rest[mixed]
    by = within(group, np.argsort(rest, kind="stable"))
    order[tied], new[tied] = part[by], changes(group) | changes(rest[by])
    index = np.minimum.reduceat(order, np.flatnonzero(new))  # of equal ones the earliest
    fresh[index] = True
    return fresh, index


def _ties(order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in an order that are tied with a neighbour, the numbers of their ties, and what stands there."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    tied = np.flatnonzero(~alone)
    return tied, np.cumsum(new)[tied], order[tied]


def stretch_of(size: int, first: np.ndarray, places: np.ndarray) -> np.ndarray:
    """In which of the stretches that begin at ascending first places of a text of some size each place is."""
    count = np.zeros(size + 1, dtype=np.int32)
    count[first] = 1
    return np.cumsum(count, dtype=np.int32)[places] - 1


def window_starts(lengths: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts one after the other: the places of all their windows, and the number of the first window of each text."""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)[:-1]])
    before = np.concatenate([[0], np.cumsum(windows, dtype=np.int64)])
    return np.arange(before[-1]) + np.repeat(offsets - before[:-1], windows), before[:-1]


class GroupArrays(Local):
    """A group's suffix arrays, one for each BATCH_BYTES of runs; runs of a block that follow each other share their text."""

    def __init__(self, units: Units):
        self.units, self.hashes, self.meta, self.texts, self.covered = units, [], [], [], []
        self._clear()

    def _clear(self) -> None:
        self.runs: list[list[np.ndarray]] = []
        self.text = bytearray()

    def take_block(self, documents: list[tuple], text: bytes, runs: Run, hot: np.ndarray) -> None:
        ids, keys, none = (np.array(x, dtype=np.int64) for x in zip(*documents, strict=True))
        cuts = np.flatnonzero(changes(runs.start // BATCH_BYTES))
        for a, b in itertools.pairwise([*cuts.tolist(), len(runs.start)]):
            self._take(ids, keys, none, text, runs.some(slice(a, b)), hot[a:b])

    def _take(self, ids: np.ndarray, keys: np.ndarray, none: np.ndarray, text: bytes, runs: Run, hot: np.ndarray) -> None:
        apart = changes(runs.document)
        apart[1:] |= runs.first[1:] != runs.first[:-1] + runs.windows[:-1]
        first = np.flatnonzero(apart)
        start, end = runs.start[first], runs.end[np.append(first[1:], len(apart)) - 1]
        reach = np.cumsum(end - start)
        if self.runs and len(self.text) + reach[-1] > BATCH_BYTES:
            self._settle()
        moved = len(self.text) + np.concatenate([[0], reach[:-1]]) - start
        at = runs.start + moved[np.cumsum(apart) - 1]
        self.text += b"".join([text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        d = runs.document
        self.runs.append([runs.hashes, hot.astype(bool), ids[d], keys[d], none[d], runs.first, runs.windows, at])

    def _settle(self) -> None:
        h, hot, ids, keys, none, first, windows, at = (np.concatenate(x) for x in zip(*self.runs, strict=True))
        before = np.concatenate([[0], np.cumsum(windows)])
        starts = np.arange(before[-1]) + np.repeat(at - before[:-1], windows)
        text = bytes(self.text)
        fresh, _ = suffix_array(np.frombuffer(text, dtype=np.uint8), starts)
        owner = np.repeat(np.arange(len(windows)), windows)
        a, b = ranges(~fresh, before)
        run = owner[a]
        start = first[run] + a - before[run]
        self.covered.append([ids[run], keys[run], none[run], start, start + b - a + WINDOW - 1])
        a, b = ranges(fresh, before)
        run = owner[a]
        start, offset, count = first[run] + a - before[run], starts[a], b - a
        end = offset + count + WINDOW - 1
        whole = np.flatnonzero(~hot[run])
        r = run[whole]
        self.hashes.append(h[r])
        self.meta.append([ids[r], keys[r], none[r], start[whole], count[whole], (end - offset)[whole], np.ones(len(r), dtype=np.int64)])
        self.texts += [text[x:y] for x, y in zip(offset[whole].tolist(), end[whole].tolist(), strict=True)]
        for n in np.flatnonzero(hot[run]).tolist():
            r = run[n]
            key, place, parts = zip(*one_by_one(self.units, text[offset[n] : end[n]], int(start[n])), strict=True)
            size = len(parts)
            self.hashes.append(np.array(key, dtype=np.uint64))
            self.meta.append([*(np.full(size, x[r]) for x in (ids, keys, none)), np.array(place), *(np.full(size, x) for x in (1, WINDOW, 1))])
            self.texts += parts
        self._clear()

    def finish(self) -> tuple[np.ndarray, Pieces, list[np.ndarray]]:
        if self.runs:
            self._settle()
        meta, spans = ([np.concatenate([np.zeros(0, dtype=kind), *x]).astype(kind) for x, kind in zip(zip(*found, strict=True) if found else ([],) * len(kinds), kinds, strict=True)] for found, kinds in ((self.meta, META), (self.covered, SPAN)))
        return np.concatenate([np.zeros(0, dtype=np.uint64), *self.hashes]), Pieces(meta, self.texts), spans


# ---- levels --------------------------------------------------------------------------------------


class Level:
    """A bucket's sorted array of distinct windows: pieces of text one after the other, with their places, and the windows' places in the text in their order."""

    KINDS = ("<i8", "<i8", "u1", "<i8", "<i8", "<i4")  # of each piece: id, key, whether the id is null, first byte, place in the text; then the order

    def __init__(self, text: np.ndarray, pieces: list[np.ndarray], order: np.ndarray):
        self.text, self.pieces, self.order = text, pieces, order

    @classmethod
    def read(cls, blob: bytes) -> Level:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        *pieces, order = unpacked(raw, *cls.KINDS)
        head = 4 * (len(cls.KINDS) + 1) + sum(x.nbytes for x in (*pieces, order))
        return cls(np.frombuffer(raw, dtype=np.uint8, offset=head), pieces, order)

    def blob(self) -> bytes:
        arrays = (np.asarray(x, dtype=kind) for x, kind in zip((*self.pieces, self.order), self.KINDS, strict=True))
        return zstandard.ZstdCompressor(level=1).compress(packed(*arrays) + self.text.tobytes())

    def windows(self, a: int, b: int) -> np.ndarray:
        """The windows a to b of the order."""
        return windows_at(self.text, self.order[a:b])

    def words(self, a: int, b: int) -> np.ndarray:
        """The first words of the windows a to b of the order."""
        return words_at(self.text, self.order[a:b])

    def places(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """(null id, id, key, first byte) of windows by their numbers in the order."""
        at = self.order[which].astype(np.int64)
        piece = stretch_of(len(self.text), self.pieces[4], at)
        return self.pieces[2][piece], self.pieces[0][piece], self.pieces[1][piece], self.pieces[3][piece] + at - self.pieces[4][piece]

    def without(self, gone: np.ndarray) -> Level:
        return Level(self.text, self.pieces, np.delete(self.order, gone)) if len(gone) else self


def scan(level: Level, words: np.ndarray, edges: np.ndarray, new: Level, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge-scan of the windows a to b of a level against another level: where each belongs in it, and whether it is there.

    words: the other's distinct first words, and at which window each begins and the last ends. Windows
    are read only where first words are equal.
    """
    own = new.words(a, b)
    tie = np.searchsorted(words, own)
    where, there = edges[tie], np.zeros(len(own), dtype=bool)
    left = np.flatnonzero(words[np.minimum(tie, len(words) - 1)] == own)
    low, high = where[left], edges[tie[left] + 1]
    windows = windows_at(new.text, new.order[a:b][left])
    while len(left):
        middle = (low + high) // 2
        theirs = windows_at(level.text, level.order[middle])
        same = equal(theirs, windows)
        there[left[same]] = True
        other = np.flatnonzero(~same)
        less = np.zeros(len(left), dtype=bool)
        less[other] = theirs[other] < windows[other]
        low, high = np.where(less, middle + 1, np.where(same, middle, low)), np.where(less, high, middle)
        where[left] = low
        more = np.flatnonzero(low < high)
        left, windows, low, high = left[more], windows[more], low[more], high[more]
    return where, there


def scanned(new: Level, level: Level) -> tuple[np.ndarray, np.ndarray]:
    """scan() of all of a level's windows against another's."""
    size = len(new.order)
    if not size or not len(level.order):
        return np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool)
    words = level.words(0, len(level.order))
    first = np.flatnonzero(changes(words))
    edges = np.append(first, len(words))
    words = words[first]
    parts = [scan(level, words, edges, new, a, min(a + SCAN, size)) for a in range(0, size, SCAN)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def earlier(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether places a come before places b."""
    out, same = np.zeros(len(a[0]), dtype=bool), np.ones(len(a[0]), dtype=bool)
    for x, y in zip(a, b, strict=True):
        out |= same & (x < y)
        same &= x == y
    return out


Cover = Callable[[tuple[np.ndarray, ...]], None]


def beaten(new: Level, old: Level, there: np.ndarray, where: np.ndarray, cover: Cover) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of new and of old windows that stand in the other before, which cover() is told of."""
    i = np.flatnonzero(there)
    j = where[i]
    mine, theirs = new.places(i), old.places(j)
    first = earlier(mine, theirs)
    cover(tuple(x[~first] for x in mine))
    cover(tuple(x[first] for x in theirs))
    return i[~first], j[first]


def merged(old: Level, new: Level, cover: Cover) -> Level:
    """Both as one; of equal windows the earlier stays."""
    if not len(old.order) or not len(new.order):
        return old if len(old.order) else new
    where, there = scanned(new, old)
    lost, gone = beaten(new, old, there, where, cover)
    where = np.delete(where, lost) - np.searchsorted(gone, np.delete(where, lost))
    new, old = new.without(lost), old.without(gone)
    order = np.insert(old.order.astype(np.int64), where, new.order + len(old.text))
    pieces = [np.concatenate([x, y]) for x, y in zip(old.pieces[:4], new.pieces[:4], strict=True)]
    return Level(np.concatenate([old.text, new.text]), [*pieces, np.concatenate([old.pieces[4], new.pieces[4] + len(old.text)])], order)


def array_of(pieces: Pieces) -> tuple[Level, list[np.ndarray]]:
    """The suffix array of a batch's pieces, in the order of their places, as a level; and the spans of windows that stand in them before."""
    ids, keys, none, first, windows, lengths, _ = pieces.meta
    text = np.frombuffer(b"".join(pieces.texts), dtype=np.uint8)
    starts, before = window_starts(lengths, windows)
    fresh, index = suffix_array(text, starts)
    owner = np.repeat(np.arange(len(windows)), windows)
    a, b = ranges(~fresh, before)
    run = owner[a]
    start = first[run] + a - before[run]
    level = Level(text, [ids, keys, none, first, starts[before] if len(before) else before], starts[index])
    return level, pieces.spans(run, start, start + b - a + WINDOW - 1)


def taken_in(new: Pieces, levels: dict[int, Level], absorbed: set[int], keep: bool) -> tuple[Level | None, list[np.ndarray]]:
    """A bucket's step: the level that new and the absorbed levels become, if it is to be kept, and the spans covered.

    A batch with more windows in the bucket than PART comes in parts, in the order of places; those
    before a part are a level of their own to it.
    """
    covered: list[list[np.ndarray]] = [[np.zeros(0, dtype=kind) for kind in SPAN]]
    own: Level | None = None

    def cover(places: tuple[np.ndarray, ...]) -> None:
        none, ids, keys, first = places
        covered.append([ids, keys, none, first, first + WINDOW])

    parts = new.parts(PART)
    for n, part in enumerate(parts):
        level, spans = array_of(part)
        covered.append(spans)
        for name, old in levels.items():
            if name not in absorbed:
                where, there = scanned(level, old)
                level = level.without(beaten(level, old, there, where, cover)[0])
        if keep or absorbed or n < len(parts) - 1:
            own = compact(level) if own is None else merged(own, compact(level), cover)
        elif own is not None:
            beaten(level, own, *reversed(scanned(level, own)), cover)
    for name in sorted(absorbed, reverse=True):  # the newest and smallest first
        if name in levels:
            own = levels[name] if own is None else merged(levels[name], own, cover)
    return own if keep else None, [np.concatenate(x).astype(kind) for x, kind in zip(zip(*covered, strict=True), SPAN, strict=True)]


def compact(level: Level) -> Level:
    """The same windows over no more text than they need."""
    size = len(level.text)
    live = np.zeros(size, dtype=bool)
    live[level.order] = True
    a, b = ranges(live, level.pieces[4].astype(np.int64))
    if not len(a):
        return Level(level.text[:0], [x[:0] for x in level.pieces], level.order[:0])
    piece = np.searchsorted(level.pieces[4], a, side="right") - 1
    lengths = b - a + WINDOW - 1
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    text = level.text[np.arange(int(lengths.sum())) + np.repeat(a - offsets, lengths)]
    moved = stretch_of(size, a, level.order)
    first = level.pieces[3][piece] + a - level.pieces[4][piece]
    return Level(text, [*(x[piece] for x in level.pieces[:3]), first, offsets], level.order - a[moved] + offsets[moved])


# ---- the family ----------------------------------------------------------------------------------


def _step(deal: Deal, absorbed: set[int], keep: bool):
    """(bucket, level, blob) sorted by bucket, level -1 for the batch -> (bucket, blob, kind): the new level's arrays (kind 1), spans by group (kind 0)."""

    def one(bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes, int]]:
        new = Pieces.read([blob for n, blob in rows if n < 0])
        levels = {n: Level.read(blob) for n, blob in rows if n >= 0}
        level, spans = taken_in(new, levels, absorbed, keep)
        if level is not None and len(level.order):
            yield bucket, level.blob(), 1
        for g, blob in span_rows(deal, spans):
            yield g, blob, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def rows() -> Iterator[pa.RecordBatch]:
            for bucket, blob, kind in one(now, held) if held else ():
                yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary()), pa.array([kind], pa.int32())], names=["bucket", "blob", "kind"])

        for batch in batches:
            for bucket, n, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if bucket != now:
                    yield from rows()
                    now, held = bucket, []
                held.append((n, blob))
        yield from rows()

    return run


class SuffixFamily:
    """Levels of sorted suffix arrays, as tables; each holds a power of two batches."""

    def __init__(self, corpus: Corpus):
        self.corpus, self.spans = corpus, []
        self.levels: list[tuple[int, Table]] = []  # batches and table of each, the oldest first

    def add(self, batch: DataFrame, last: bool = False) -> None:
        """Takes in a batch (bucket, blob) of pieces. After the last one nothing is scanned, so its level isn't made."""
        size, absorbed = 1, []
        for n in range(len(self.levels) - 1, -1, -1):
            if self.levels[n][0] != size:
                break
            absorbed.append(n)
            size *= 2
        rows = [batch.select("bucket", F.lit(-1).alias("level"), "blob")]
        rows += [table.read(1).select("bucket", F.lit(n).alias("level"), "blob") for n, (_, table) in enumerate(self.levels)]
        together = self.corpus.by_bucket(reduce(DataFrame.unionByName, rows), "level")
        work = _step(self.corpus.deal, set() if last else set(absorbed), not last)
        found = Table(together.mapInArrow(work, "bucket int, blob binary, kind int"), "level", by=("kind",))
        self.spans.append(found.read(0))
        spent = range(len(self.levels)) if last else absorbed
        for n in spent:
            self.levels[n][1].drop(1)
        self.levels = [x for n, x in enumerate(self.levels) if n not in spent] + ([] if last else [(size, found)])


def cut_bytes(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return len(raw), b"".join([*out, raw[at:]])


def remove_repeated_strings(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_units, spans, kept) of each row: bytes, the spans removed, and the bytes left."""
    corpus = Corpus(docs, ByteUnits())
    pieces = corpus.pieces(batches)
    family = SuffixFamily(corpus)
    for b in range(batches):
        family.add(pieces.read(1, b), last=b == batches - 1)
        pieces.drop(1, b)
    known = [pieces.read(0, b) for b in range(batches)]
    return corpus.cut(reduce(DataFrame.unionByName, [*known, *family.spans]), cut_bytes)
