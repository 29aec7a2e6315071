"""Windows of a document that also start earlier in the corpus: the frame for the substring operators.

A window is a fixed number of units (bytes or words). Its minimiser is the place of the smallest
hash among its anchors (short runs of units), the leftmost of equals; equal windows have equal
minimisers at equal places. Consecutive windows with one minimiser are a run, whose text (a
super-k-mer) holds all their windows.

Steps, with documents dealt into groups by a hash of doc_id and text, whole texts packed:
 1. anchors: each group sends the distinct minimiser hashes of its runs to their buckets;
 2. the buckets answer which hashes stand in more than one place: only runs with such a minimiser
    can hold a repeated window, the others' windows are alone in the corpus;
 3. pieces: each group settles what repeats within it by the operator's own method (Units.local) and
    sends the rest, as run texts with their places, to the buckets of their minimisers;
 4. the operator compares the windows of each bucket by content, all of them, by its own method;
 5. the groups get the covered spans and cut their texts.

A group holds about GROUP_BYTES of text and there are as many buckets as groups, whatever the number
of shuffle partitions; a task works one group or bucket at a time, so its memory doesn't grow with
the input. A passage in a third of all documents is settled group by group and reaches its buckets
once a group. Messages are rows of some bytes for each group and bucket that have to do with each
other, never more rows than there are runs.

A minimiser whose runs have more than HOT_VARIANTS variants, and several a group, would fill one
bucket with them (a line with a number in it, in every document); its windows are dealt one by one
by their own hashes, and compared there as all others are.

"Earlier" is by doc_id (null last), then hash of the document, then place; rows equal in doc_id
and text are one document. Hashes only choose what to compare: a collision costs a comparison, never
a wrong result (documents are told apart by doc_id with a 64-bit hash of doc_id and text).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Table, packed, shuffle_width, unpacked

#: Bytes of text that the hash arrays are made for at once.
HASH_BLOCK = 1 << 18
#: A longer document is worked in parts of so many units that overlap by a window less one unit.
PART_UNITS = 1 << 22
#: Documents unpacked at once.
CHUNK = 256
#: A minimiser whose runs have more variants than this, and over 4 a group, is hot.
HOT_VARIANTS = 1000
#: Bytes of text in a group; there are as many groups as shuffle partitions at least.
GROUP_BYTES = 16 << 20

_PLACE = np.uint64((1 << 24) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
BYTE_HASH = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


_BASE = 0xD1342543DE82EF95
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0 to n - 1 and their inverses, mod 2 ** 64."""
    size = max(1 << 16, 1 << n.bit_length())
    if size not in _POWERS:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS.clear()
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def polynomial(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of units from a start to an end, from the units' hashes and their order alone."""
    power, inverse = _powers(len(h))
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * power[: len(h)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def joint(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of n neighbours at each place, from the places' own hashes."""
    out, done, power, have = None, 0, h, 1
    while True:
        if n & have:
            out = power if out is None else mixed(out[: len(power) - done] * _MIX + power[done:]) if done else power
            done += have
        if done == n:
            return out
        power = mixed(power[: len(power) - have] * _MIX + power[have:])
        have *= 2


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    least, have = keys, 1
    while 2 * have <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    rest = width - have
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


class Units:
    """How texts are cut into units: words of an operator. See ByteUnits and WordUnits."""

    window: int
    anchor: int

    def parts(self, raw: bytes) -> list[tuple[int, int, bytes]]:
        """(first unit, units, text) of a document's parts."""
        raise NotImplementedError

    def block(self, parts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """The parts as one text, with the units' hashes and, unless units are bytes, their first and end bytes."""
        raise NotImplementedError

    def anchors(self, unit_hash: np.ndarray) -> np.ndarray:
        """The hash of the anchor at each unit."""
        return joint(unit_hash, self.anchor)

    def windows(self, text: bytes) -> list[bytes]:
        """The texts of all windows of a run's text."""
        raise NotImplementedError

    def local(self) -> Local:
        """What settles the repeats within a group."""
        raise NotImplementedError


class Run:
    """Runs of one block as arrays: minimiser hash, document, first unit in it, windows, first and end byte in the block, and a hash of the text."""

    def __init__(self, hashes, document, first, windows, start, end, variant):
        self.hashes, self.document, self.first, self.windows, self.start, self.end, self.variant = hashes, document, first, windows, start, end, variant

    def some(self, which: np.ndarray | slice) -> Run:
        return Run(*(x[which] for x in (self.hashes, self.document, self.first, self.windows, self.start, self.end, self.variant)))


def runs_of(units: Units, texts: list[bytes]) -> Iterator[tuple[bytes, Run]]:
    """The runs of documents, block by block."""
    todo = [(i, *part) for i, raw in enumerate(texts) for part in units.parts(raw) if part[1] >= units.window]
    at = 0
    while at < len(todo):
        end, size = at, 0
        while end < len(todo) and (end == at or size + len(todo[end][3]) <= HASH_BLOCK):
            size += len(todo[end][3])
            end += 1
        yield _block_runs(units, todo[at:end])
        at = end


def _block_runs(units: Units, part: list[tuple[int, int, int, bytes]]) -> tuple[bytes, Run]:
    text, unit_hash, unit_start, unit_end = units.block([x[3] for x in part])
    counts = np.array([x[2] for x in part], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    hashes = units.anchors(unit_hash)
    keys = (mixed(hashes) & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    minimiser = (sliding_least(keys, units.window - units.anchor + 1) & _PLACE).astype(np.int64)
    edge = np.zeros(len(minimiser) + 1, dtype=np.int8)
    np.add.at(edge, starts, 1)
    ends = starts + counts - units.window + 1
    np.add.at(edge, ends[ends < len(edge)], -1)
    place = np.flatnonzero(np.cumsum(edge[:-1]))
    least = minimiser[place]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(least) != 0) | (np.diff(place) != 1)]))
    windows = np.diff(np.concatenate([first, [len(place)]]))
    p0 = place[first]
    owner = np.searchsorted(starts, p0, side="right") - 1
    document = np.array([x[0] for x in part], dtype=np.int64)[owner]
    base = np.array([x[1] for x in part], dtype=np.int64)[owner]
    last = p0 + windows + units.window - 2
    start = p0 if unit_start is None else unit_start[p0]
    end = last + 1 if unit_end is None else unit_end[last]
    variant = mixed(hashes[p0] * _MIX + hashes[last + 1 - units.anchor]) + windows.astype(np.uint64)
    return text, Run(hashes[least[first]], document, p0 - starts[owner] + base, windows, start, end, variant)


# ---- pieces ------------------------------------------------------------------------------------

#: A piece's place: its document's id, key and whether the id is null, its first unit; then its windows, length in bytes and, where copies are counted, how many.
META = ("<i8", "<i8", "u1", "<i8", "<i4", "<i4", "<i4")
#: Document's id, key and whether the id is null, start and end unit.
SPAN = ("<i8", "<i8", "u1", "<i8", "<i8")


class Pieces:
    """Texts of consecutive windows with their places, as arrays of META."""

    def __init__(self, meta: list[np.ndarray], texts: list[bytes]):
        self.meta, self.texts = meta, texts

    @classmethod
    def read(cls, blobs: list[bytes]) -> Pieces:
        """The pieces of blobs in the order of their places."""
        opened, meta, texts = zstandard.ZstdDecompressor(), [], []
        for blob in map(opened.decompress, blobs):
            arrays = unpacked(blob, *META)
            ends = np.cumsum(arrays[5], dtype=np.int64) + (len(blob) - int(arrays[5].sum(dtype=np.int64)))
            texts += [blob[a:b] for a, b in zip((ends - arrays[5]).tolist(), ends.tolist(), strict=True)]
            meta.append(arrays)
        joined = [np.concatenate(x) for x in zip(*meta, strict=True)] if meta else [np.zeros(0, dtype=kind) for kind in META]
        order = np.lexsort((joined[3], joined[1], joined[0], joined[2]))
        return cls([x[order] for x in joined], [texts[i] for i in order.tolist()])

    def parts(self, most: int) -> list[Pieces]:
        """The pieces in stretches of about `most` windows; a longer piece stands alone."""
        part = np.cumsum(self.meta[4], dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        return [Pieces([x[a:b] for x in self.meta], self.texts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    def spans(self, which: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """SPAN arrays of unit ranges in pieces."""
        return [self.meta[0][which], self.meta[1][which], self.meta[2][which], start, end]


class Local:
    """Repeats within a group. take_block() gets runs in the order of their documents; the rest is what the buckets must see."""

    def take_block(self, documents: list[tuple], text: bytes, runs: Run, hot: np.ndarray) -> None:
        """Runs of a block of text: take() of each, unless a method takes them together. documents: by the runs' numbers of them."""
        columns = (x.tolist() for x in (runs.hashes, hot, runs.document, runs.first, runs.windows, runs.start, runs.end))
        for h, split, d, first, windows, a, b in zip(*columns, strict=True):
            self.take(documents[d], h, bool(split), first, windows, text[a:b])

    def take(self, document: tuple, h: int, hot: bool, first: int, windows: int, text: bytes) -> None:
        """document: (id or 0, key, whether the id is null); h: the run's minimiser hash."""
        raise NotImplementedError

    def finish(self) -> tuple[np.ndarray, Pieces, list[np.ndarray]]:
        """Hashes to deal by with the pieces left, and the SPAN arrays settled."""
        raise NotImplementedError


def ranges(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end places of maximal runs of true flags that don't reach over breaks (places where a new run must begin)."""
    edge = flags.copy()
    edge[1:] &= ~flags[:-1]
    edge[breaks[breaks < len(flags)]] |= flags[breaks[breaks < len(flags)]]
    first = np.flatnonzero(edge)
    stop = np.ones(len(flags) + 1, dtype=bool)
    stop[:-1] = ~flags
    stop[breaks] = True
    stops = np.flatnonzero(stop)
    return first, stops[np.searchsorted(stops, first, side="right")] if len(first) else first


def ordered(keys: np.ndarray, have: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by prefix doubling: (order, rank) of the places by their first `depth` units.

    keys: numbers in the order of the places' first `have` units. Equal prefixes have equal ranks, the
    place of the first of them in the order. Only places that are tied so far are sorted again.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while have < depth:
        step = min(have, depth - have)
        alone = new.copy()
        alone[:-1] &= new[1:]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        part = order[tied]
        after = part + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1) + 1
        key = rank[part] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        key, part = key[by], part[by]
        order[tied] = part
        fresh = np.ones(len(part), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        new[tied] = fresh
        rank[part] = np.maximum.accumulate(np.where(fresh, tied, 0))
        have += step
    return order, rank


# ---- the passes --------------------------------------------------------------------------------


def _row(**columns) -> pa.RecordBatch:
    kinds = {"blob": pa.binary()}
    return pa.record_batch([pa.array(v, kinds.get(k, pa.int32())) for k, v in columns.items()], names=list(columns))


def _texts(packs: list[bytes]) -> list[bytes]:
    opened = zstandard.ZstdDecompressor()
    return [opened.decompress(x) if x else b"" for x in packs]


def _pack(deal: Deal):
    """(dkey, doc_id, text) -> (g, dkey, doc_id, pack): the group by dkey, the text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closed = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for a in range(0, batch.num_rows, 4 * CHUNK):
                part = batch.slice(a, 4 * CHUNK)
                packs = [closed.compress(x.encode("utf-8", "replace")) if x else b"" for x in part.column(2).to_pylist()]
                g = deal(np.asarray(part.column(0).to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64))
                yield pa.record_batch([pa.array(g), *part.columns[:2], pa.array(packs, pa.binary())], names=["g", "dkey", "doc_id", "pack"])

    return run


class Deal:
    """For each hash the key of its group or bucket. keys: the keys, or their number where they are 0 and on."""

    def __init__(self, keys: np.ndarray | int):
        self.keys, self.size = keys, keys if isinstance(keys, int) else len(keys)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes % np.uint64(self.size)).astype(np.int32)
        return place if isinstance(self.keys, int) else self.keys[place]


def deal_of(spark: SparkSession, size: int, width: int) -> Deal:
    """size keys over width hash partitions: up to 16 a partition exactly as many in each, more by chance."""
    if size > 16 * width:
        return Deal(size)
    each, found, reach = -(-size // width), [], 16 * size
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(width)).alias("place")
    while len(found) < each * width:
        first = Window.partitionBy("place").orderBy("id")
        numbered = spark.range(reach).select(F.col("id").cast("int").alias("id"), place).withColumn("n", F.row_number().over(first))
        found = numbered.filter(F.col("n") <= each).collect()  # 17 * width rows at most
        reach *= 2
    return Deal(np.array([r["id"] for r in sorted(found, key=lambda r: (r["n"], r["place"]))], dtype=np.int32)[:size])


def _send_anchors(units: Units, deal: Deal):
    """(g, dkey, doc_id, pack) -> (bucket, g, blob of distinct hashes, in how many places each stands and with how many variants, up to 255)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            order = np.argsort(groups, kind="stable")
            packs = batch.column(3)
            cuts = np.flatnonzero(np.diff(groups[order])) + 1
            for rows in np.split(order, cuts):
                chunks = (_texts(packs.take(pa.array(rows[a : a + CHUNK])).to_pylist()) for a in range(0, len(rows), CHUNK))
                found = [(r.hashes, r.variant) for texts in chunks for _, r in runs_of(units, texts)]
                if not found:
                    continue
                hashes, variants = (np.concatenate(x) for x in zip(*found, strict=True))
                by = np.lexsort((variants, hashes))
                hashes, variants = hashes[by], variants[by]
                new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
                first = np.flatnonzero(new)
                kinds = np.add.reduceat(np.concatenate([[True], variants[1:] != variants[:-1]]) | new, first, dtype=np.int64)
                count = np.diff(np.concatenate([first, [len(hashes)]]))
                hashes = hashes[first]
                bucket = deal(hashes)
                by = np.argsort(bucket, kind="stable")
                arrays = (hashes[by], np.minimum(count[by], 255).astype(np.uint8), np.minimum(kinds[by], 255).astype(np.uint8))
                bucket = bucket[by]
                edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                blobs = [packed(*(x[a:b] for x in arrays)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield _row(bucket=bucket[edges[:-1]].astype(np.int32), g=np.full(len(blobs), groups[rows[0]], dtype=np.int32), blob=blobs)

    return run


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows (bucket, number, blob) sorted by bucket, as (bucket, rows)."""
    now, held = None, []
    for batch in batches:
        for bucket, number, blob in zip(*(x.to_pylist() for x in batch.columns[:3]), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append((number, blob))
    if held:
        yield now, held


def _answer_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, g, blob) sorted by bucket -> (g, blob of the hashes of g that stand in more than one place, and whether each is hot)."""
    for _, rows in by_bucket(batches):
        arrays = [unpacked(blob, "<u8", "u1", "u1") for _, blob in rows]
        hashes, often, kinds = (np.concatenate(x) for x in zip(*arrays, strict=True))
        _, at = np.unique(hashes, return_inverse=True)
        places, variants, groups = (np.bincount(at, weights=x) for x in (often, kinds, None))
        hot = (variants > HOT_VARIANTS) & (variants > 4 * groups)
        start, gs, blobs = 0, [], []
        for (g, _), (own, *_) in zip(rows, arrays, strict=True):
            here = at[start : start + len(own)]
            start += len(own)
            more = places[here] > 1
            if more.any():
                gs.append(g)
                blobs.append(packed(own[more], hot[here][more].astype(np.uint8)))
        if gs:
            yield _row(g=gs, blob=blobs)


def joined_spans(ids: np.ndarray, keys: np.ndarray, none: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans sorted by document, with those that touch made one."""
    if not len(ids):
        return ids, keys, none, start, end
    order = np.lexsort((start, keys, ids, none))
    ids, keys, none, start, end = (x[order] for x in (ids, keys, none, start, end))
    document = np.concatenate([[0], np.cumsum((np.diff(ids) != 0) | (np.diff(keys) != 0) | (np.diff(none) != 0))])
    far = int(end.max()) + 2
    reach = np.maximum.accumulate(end + document * far) - document * far
    first = np.concatenate([[True], (start[1:] > reach[:-1]) | (np.diff(document) != 0)])
    last = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(first) - 1]])
    return ids[first], keys[first], none[first].astype(np.uint8), start[first], reach[last]


def _send_pieces(units: Units, deal: Deal, batches: int):
    """A group's documents and its answers -> (batch, bucket, kind, blob): kind 1 pieces for the bucket, kind 0 spans already known, with the group for bucket."""

    def run(key, documents: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, bytes]] = []
        blobs = answers.column("blob").to_pylist()
        known, hot = (np.concatenate(x) for x in zip(*(unpacked(x, "<u8", "u1") for x in blobs), strict=True)) if blobs else (np.zeros(0, dtype=np.uint64),) * 2
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        rows = sorted({(i is None, i or 0, k): n for n, (k, i) in enumerate(zip(documents.column("dkey").to_pylist(), documents.column("doc_id").to_pylist(), strict=True))}.items()) if len(known) else []
        packs, local = documents.column("pack"), units.local()
        for part in range(0, len(rows), CHUNK):  # in the documents' order, so that a text's first place is met first
            chosen = rows[part : part + CHUNK]
            places = [(i, k, none) for (none, i, k), _ in chosen]
            for text, run in runs_of(units, _texts(packs.take(pa.array([n for _, n in chosen])).to_pylist())):
                at = np.minimum(np.searchsorted(known, run.hashes), len(known) - 1)
                hit = np.flatnonzero(known[at] == run.hashes)
                local.take_block(places, text, run.some(hit), hot[at[hit]])
        g = key[0].as_py()
        if rows:
            hashes, pieces, spans = local.finish()
            closed = zstandard.ZstdCompressor(level=3)
            bucket = deal(hashes)
            by = np.argsort(bucket, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
                blob = packed(*(np.asarray(x[part], dtype=kind) for x, kind in zip(pieces.meta, META, strict=True))) + b"".join([pieces.texts[i] for i in part.tolist()])
                out.append((g % batches, int(bucket[part[0]]), 1, closed.compress(blob)))
            if len(spans[0]):
                out.append((g % batches, g, 0, packed(*joined_spans(*spans))))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([],) * 4, kinds, strict=True)], names=["batch", "bucket", "kind", "blob"])

    return run


def one_by_one(units: Units, text: bytes, first: int) -> Iterator[tuple[int, int, bytes]]:
    """The windows of a hot run: (hash to deal by, first unit, text) of each."""
    for i, piece in enumerate(units.windows(text)):
        yield xxhash.xxh64_intdigest(piece), first + i, piece


def span_rows(deal: Deal, spans: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(group, blob) of SPAN arrays."""
    if len(spans[0]):
        merged = joined_spans(*spans)
        g = deal(merged[1].view(np.uint64))
        for one in np.unique(g).tolist():
            yield one, packed(*(x[g == one] for x in merged))


def _cut(cut: Callable[[bytes, list[tuple[int, int]]], tuple[int, bytes]]):
    """A group's documents and its spans -> (doc_id, n_units, spans, kept)."""

    def run(key, documents: pa.Table, answers: pa.Table) -> pa.Table:
        by: dict[tuple, list[tuple[int, int]]] = {}
        blobs = answers.column("blob").to_pylist()
        if blobs:
            merged = joined_spans(*(np.concatenate(x) for x in zip(*(unpacked(b, *SPAN) for b in blobs), strict=True)))
            for i, k, none, a, b in zip(*(x.tolist() for x in merged), strict=True):
                by.setdefault((None if none else i, k), []).append((a, b))
        ids = documents.column("doc_id").to_pylist()
        counts, spans, kept = [], [], []
        opened = zstandard.ZstdDecompressor()
        for i, k, pack in zip(ids, documents.column("dkey").to_pylist(), documents.column("pack").to_pylist(), strict=True):
            own = by.get((i, k), [])
            n, rest = cut(opened.decompress(pack) if pack else b"", own)
            counts.append(n)
            spans.append([{"start": a, "end": b} for a, b in own])
            kept.append(rest)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
        return pa.table(columns, names=["doc_id", "n_units", "spans", "kept"])

    return run


class Corpus:
    """Documents dealt into groups, with the deal that groups and buckets share."""

    def __init__(self, docs: DataFrame, units: Units, group_bytes: int = GROUP_BYTES):
        spark = docs.sparkSession
        self.units, self.width = units, shuffle_width(spark)
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        size = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        self.deal = deal_of(spark, max(self.width, -(-size // group_bytes)), self.width)
        self.keyed = source.select(F.xxhash64("doc_id", "text").alias("dkey"), "doc_id", "text")

    def dealt(self) -> DataFrame:
        """(g, dkey, doc_id, pack) by g."""
        return self.keyed.mapInArrow(_pack(self.deal), "g int, dkey long, doc_id long, pack binary").repartition(self.width, "g")

    def pieces(self, batches: int = 1) -> Table:
        """(bucket, blob) by kind and batch: pieces for the buckets (kind 1) and spans already known (kind 0), groups dealt into batches."""
        dealt = self.dealt()  # one deal of the texts, which both passes over them share
        anchors = dealt.mapInArrow(_send_anchors(self.units, self.deal), "bucket int, g int, blob binary")
        answers = anchors.repartition(self.width, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer_anchors, "g int, blob binary")
        answers = answers.repartition(self.width, "g")
        found = dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_send_pieces(self.units, self.deal, batches), "batch int, bucket int, kind int, blob binary")
        return Table(found, "pieces", by=("kind", "batch"))

    def cut(self, spans: DataFrame, cut: Callable[[bytes, list[tuple[int, int]]], tuple[int, bytes]]) -> DataFrame:
        """(doc_id, n_units, spans, kept) of each row, from spans (bucket, blob) with groups for buckets; cut(raw, spans) gives a document's units and what is left of it."""
        spans = spans.select(F.col("bucket").alias("g"), "blob").repartition(self.width, "g")
        return self.dealt().groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(_cut(cut), "doc_id long, n_units long, spans array<struct<start:long,end:long>>, kept binary")

    def by_bucket(self, rows: DataFrame, *order: str) -> DataFrame:
        return rows.repartition(self.width, "bucket").sortWithinPartitions("bucket", *order)
