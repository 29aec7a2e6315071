"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: XXH64 (seed 42) of each 3-word shingle, repeats counted; a bit is 1 if it is set in
over half the hashes. Links: fingerprints that differ in MOST_BITS bits at most.

The trie of all distinct fingerprints is dealt out by three blocks of their bits: two fingerprints
that differ in two bits agree on one block at least, so each link is found in a bucket of
fingerprints that share a block. In a bucket, pairs of trie nodes are traversed together from the
root; a pair carries the bits by which its paths differ and goes when they are over the budget. A
fingerprint has at most 64 + 64 * 63 / 2 others within two bits, so what a traversal meets grows
in proportion to the fingerprints, and a bucket yields a spanning forest rather than its pairs. A
bucket over HOT_BUCKET fingerprints is dealt anew by three blocks of its remaining bits.

Copies share a fingerprint and are one node, however many they are. Components are found by
alternating large-star and small-star steps over tables in the shared folder; nothing but counts
comes to the driver.

Edge cases: a text without words (null, empty) has the fingerprint 0 and links like any other; a
text of one or two words is one shingle; repeated rows and rows that share a doc_id keep their own
fingerprints; a null doc_id is never a component's smallest unless all are null; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_pass, shuffle_width, stage, texts_of, unused

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: The blocks of bits, as (lowest bit, width).
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: A bucket with more fingerprints is dealt anew.
HOT_BUCKET = 200_000
#: Node pairs that a traversal holds at once; more are worked in parts.
FRONTIER = 1 << 20


# ---- fingerprints ------------------------------------------------------------------------------


def shingle_hashes(text: str) -> list[int]:
    words = text.encode("utf-8", "replace").lower().split()  # of bytes: lowers A-Z, splits at ASCII white space
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return [digest(joined, SEED)]
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    return [digest(joined[a:b], SEED) for a, b in zip([0, *(x + 1 for x in ends)], ends[SHINGLE - 1 :], strict=False)]


def fingerprints_of(texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text), dtype=np.uint64)
        ones = np.zeros(64, dtype=np.int64)
        for part in range(0, len(hashes), 1 << 16):
            raw = hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = weights[2 * ones > len(hashes)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """keys of each row with its fingerprint, as the long of the same bits."""
    names = [*keys, "fingerprint"]

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = fingerprints_of(texts_of(batch.column(len(keys)))).view(np.int64)
        yield pa.record_batch([*batch.columns[:-1], pa.array(found)], names=names)

    source = docs.select(*(F.col(k).cast("long").alias(k) for k in keys), F.col("text").cast("string"))
    return arrow_pass(source, work, ", ".join(f"{x} long" for x in names))


# ---- the self-join of a bucket's tries -----------------------------------------------------------


def trie_links(prints: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of all links within buckets. prints: unsigned, ascending and distinct within each bucket; starts: the buckets' first places and the end."""
    zeros = [np.concatenate([[0], np.cumsum((prints >> np.uint64(bit)) & np.uint64(1) == 0)]) for bit in range(63, -1, -1)]
    lo, hi = starts[:-1], starts[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    # A part of the frontier: its depth, then two nodes as ranges of places and the bits by which they differ.
    parts = [(0, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int8))]
    while parts:
        depth, a, a_end, b, b_end, bits = parts.pop()
        if not len(a):
            continue
        if len(a) > FRONTIER:
            half = len(a) // 2
            parts += [(depth, *(x[:half] for x in (a, a_end, b, b_end, bits))), (depth, *(x[half:] for x in (a, a_end, b, b_end, bits)))]
            continue
        leaf = (a_end - a == 1) & (b_end - b == 1)
        near = np.bitwise_count(prints[a[leaf]] ^ prints[b[leaf]]) <= MOST_BITS
        out.append((a[leaf][near], b[leaf][near]))
        inner = ~leaf
        if depth == 64 or not inner.any():
            continue
        a, a_end, b, b_end, bits = (x[inner] for x in (a, a_end, b, b_end, bits))
        below = zeros[depth]
        a_mid, b_mid = a + below[a_end] - below[a], b + below[b_end] - below[b]
        same, more = a == b, (bits + 1).astype(np.int8)
        children = (
            (a, a_mid, b, b_mid, bits, same),
            (a_mid, a_end, b_mid, b_end, bits, same),
            (a, a_mid, b_mid, b_end, more, None),
            (a_mid, a_end, b, b_mid, more, same),  # for a node with itself, the pair above is this one
        )
        kept = []
        for i, (p, p_end, q, q_end, cost, own) in enumerate(children):
            ok = (p_end > p) & (q_end > q) & (cost <= MOST_BITS)
            if i < 2:
                ok &= ~own | (p_end - p > 1)
            elif i == 3:
                ok &= ~own
            kept.append([x[ok] for x in (p, p_end, q, q_end, cost)])
        parts.append((depth + 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))
    return tuple(np.concatenate(x) if out else np.zeros(0, dtype=np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 2


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of size places the smallest place that links connect it with."""
    label = np.arange(size)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while (deeper := label[label] != label).any():
            label[deeper] = label[label[deeper]]
        if (before == label).all():
            break
    return label


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (bucket, fingerprint) sorted by bucket; yields each bucket's links as a spanning forest (a, b)."""

    def links(bucket: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((prints, bucket))
        bucket, prints = bucket[order], prints[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        label = forest(len(prints), *trie_links(prints, starts))
        linked = np.flatnonzero(label != np.arange(len(label)))
        if len(linked):
            yield pa.record_batch([pa.array(prints[linked].view(np.int64)), pa.array(prints[label[linked]].view(np.int64))], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        bucket, prints = (np.asarray(x.to_numpy(zero_copy_only=False), dtype=np.int64) for x in batch.columns[:2])
        if not len(bucket):
            continue
        last = np.searchsorted(bucket, bucket[-1])  # what belongs to the last bucket may go on in the next batch
        if held and bucket[-1] == held[0][0][-1] and last == 0:
            held.append((bucket, prints))
            continue
        held.append((bucket[:last], prints[:last]))
        yield from links(*(np.concatenate(x) if i == 0 else np.concatenate(x).view(np.uint64) for i, x in enumerate(zip(*held, strict=True))))
        held = [(bucket[last:], prints[last:])]
    if held:
        yield from links(*(np.concatenate(x) if i == 0 else np.concatenate(x).view(np.uint64) for i, x in enumerate(zip(*held, strict=True))))


def _parts_of(blocks: tuple[tuple[int, int], ...]) -> Column:
    """The fingerprint's blocks as an array of (number, value)."""
    value = [F.shiftrightunsigned("fingerprint", low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in blocks]
    return F.array(*(F.struct(F.lit(i).alias("n"), v.alias("v")) for i, v in enumerate(value)))


def _thirds(taken: int) -> tuple[tuple[int, int], ...]:
    """Three blocks of the bits outside BLOCKS[taken], as masks' (low, width) where they are whole runs."""
    low, width = BLOCKS[taken]
    rest = [(a, n) for a, n in ((0, low), (low + width, 64 - low - width)) if n]
    if len(rest) == 2:  # two runs around the taken block: the longer one is halved
        (a, n), (b, m) = rest
        return ((a, n), (b, m // 2), (b + m // 2, m - m // 2)) if m >= n else ((a, n // 2), (a + n // 2, n - n // 2), (b, m))
    a, n = rest[0]
    third = n // 3
    return ((a, third), (a + third, third), (a + 2 * third, n - 2 * third))


def links(prints: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b): links that connect what prints' distinct fingerprints within MOST_BITS bits connect. prints: distinct (fingerprint)."""
    spark = prints.sparkSession
    dealt = prints.select("fingerprint", F.explode(_parts_of(BLOCKS)).alias("p")).select("fingerprint", (F.col("p.n") * (1 << 22) + F.col("p.v")).cast("long").alias("bucket"))
    crowded = dealt.groupBy("bucket").count().filter(F.col("count") > hot).select("bucket", F.lit(True).alias("hot"))
    crowded = stage(crowded, "hot-buckets")
    if not crowded.isEmpty():
        marked = dealt.join(crowded, "bucket", "left")
        number = F.shiftright("bucket", 22)
        again = F.when(number == 0, _parts_of(_thirds(0))).when(number == 1, _parts_of(_thirds(1))).otherwise(_parts_of(_thirds(2)))
        split = marked.filter("hot").select("fingerprint", "bucket", F.explode(again).alias("p"))
        # A collision of this hash only joins two buckets: their links are checked all the same.
        split = split.select("fingerprint", F.xxhash64("bucket", "p.n", "p.v").alias("bucket"))
        dealt = marked.filter("hot IS NULL").select("fingerprint", "bucket").unionByName(split)
    ordered = dealt.select("bucket", "fingerprint").repartition(shuffle_width(spark), "bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(_bucket_links, "a long, b long")


# ---- components --------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b): root is the smallest node connected with it; roots themselves are left out.

    Large-star and small-star steps in turn until the stars no longer change.
    """

    def lowest(pairs: DataFrame) -> DataFrame:
        """pairs (u, v) with m, the least of u and its v."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u")

    def signature(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    at = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    seen = signature(at)
    while seen[0]:
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = lowest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = lowest(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        at = stage(small.filter("u <> v").distinct(), "stars")
        now = signature(at)
        if now == seen:
            break
        seen = now
    return at.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: component_id is the smallest doc_id that links reach from it."""
    rows = stage(fingerprints(docs, "doc_id"), "fingerprints")
    return rows.join(classes(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))), "fingerprint").select("doc_id", "fingerprint", F.col("first").alias("component_id"))


def classes(prints: DataFrame) -> DataFrame:
    """prints (fingerprint, first), fingerprints distinct, with first as the least within each component."""
    prints = stage(prints, "prints")
    found = components(links(prints.select("fingerprint")))
    rooted = prints.join(found, prints["fingerprint"] == found["node"], "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fingerprint", "root").join(least, "root").select("fingerprint", "first")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row, nulls told apart; maps, which have no hash, as text."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    empty = F.concat(*(F.when(F.col(f"`{x}`").isNull(), "1").otherwise("0") for x in docs.columns))
    return F.xxhash64(empty, *plain)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are the first of their component: smallest doc_id (null last), then hash of text, then hash of the row; of equal rows one.

    Components are made of the fingerprints alone. Texts are shuffled once, to meet the rows that stay.
    """
    key, row, own, place = unused(docs, "_key", "_row", "_own", "_place")
    named = docs.withColumns({key: F.xxhash64(F.coalesce("text", F.lit(""))), row: row_hash(docs), own: F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("hash").alias("hash"), F.col("row").alias("row"))
    rows = stage(fingerprints(named.select("doc_id", F.col(key).alias("hash"), F.col(row).alias("row"), "text"), "doc_id", "hash", "row"), "fingerprints")
    first = classes(rows.groupBy("fingerprint").agg(F.min(order).alias("first"))).select("first").distinct()
    kept = first.select(F.col("first.row").alias(row), F.coalesce("first.id", F.lit(0)).alias(own))
    left = named.join(kept, [row, own], "left_semi")
    # The join has brought rows with these keys together: equal rows are numbered without a further shuffle, and one of them stays.
    numbered = left.withColumn(place, F.row_number().over(Window.partitionBy(row, own).orderBy(key)))
    return numbered.filter(F.col(place) == 1).select(*(F.col(f"`{x}`") for x in docs.columns))
