"""The operators that compare documents or vectors: SimHash, exact top-k, suffix arrays, super-k-mers; the pipeline."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import time
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from likeloom.llm import queries as Q
from likeloom.llm import repeats, simhash, suffixes, superkmers, topk
from likeloom.llm.shared import stage

# ---- SimHash -------------------------------------------------------------------------------------


def plain_print(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """For each of distinct prints the smallest it is linked with, link by link."""
    prints = sorted(prints)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {p: find(p) for p in prints}


def clustered(rng, n):
    """Prints in chains and clusters, a few bits apart, many of them sharing a block of bits."""
    prints = [rng.getrandbits(64) for _ in range(8)]
    while len(prints) < n:
        p = rng.choice(prints)
        for bit in rng.sample(range(64), rng.choice((1, 1, 2, 2, 3, 4))):
            p ^= 1 << bit
        prints.append(p)
    return sorted(set(prints))


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aB \n\té\x0b\x85"), max_size=60))
def test_fingerprint(text):
    assert int(simhash.fingerprints_of([text])[0]) == plain_print(text)


@pytest.mark.parametrize("frontier", [64, 1 << 20])
def test_trie_links(monkeypatch, frontier):
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    rng = random.Random(2)
    buckets = [clustered(rng, 60) for _ in range(4)] + [[5]]
    flat = np.array(list(itertools.chain(*buckets)), dtype=np.uint64)
    starts = np.cumsum([0, *map(len, buckets)])
    got = Counter(zip(*(x.tolist() for x in simhash.trie_links(flat, starts)), strict=True))
    want = {(a, b) for lo, hi in zip(starts, starts[1:], strict=False) for a, b in itertools.combinations(range(lo, hi), 2) if int(flat[a] ^ flat[b]).bit_count() <= 2}
    assert {tuple(sorted(p)) for p in got} == want and max(got.values()) == 1


@pytest.mark.parametrize("hot", [simhash.HOT_BUCKET, 3])
def test_classes(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (hot,))
    prints = clustered(random.Random(7), 250)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fingerprint bigint, first bigint")
    got = {r["fingerprint"]: r["first"] for r in simhash.classes(df).collect()}
    roots = plain_classes(prints)
    least = {}
    for i, p in enumerate(prints):
        least[roots[p]] = min(i, least.get(roots[p], i))
    assert got == {s: least[roots[p]] for s, p in zip(signed, prints, strict=True)}
    assert len(set(got.values())) < len(prints)


def test_components_of_a_long_chain(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a bigint, b bigint")
    assert {(r["node"], r["root"]) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, n)}


def test_simhash_awkward(awkward, nothing, awkward_rows):
    rows = simhash.near_duplicates(awkward).collect()
    prints = {}
    for r in awkward_rows:
        prints.setdefault(plain_print(r[1] or ""), []).append(r[0])
    roots = plain_classes(prints)
    least = {}
    for p, ids in prints.items():
        known = [i for i in ids if i is not None]
        least[roots[p]] = min([*known, *([least[roots[p]]] if least.get(roots[p]) is not None else [])], default=None)
    want = Counter((r[0], plain_print(r[1] or ""), least[roots[plain_print(r[1] or "")]]) for r in awkward_rows)
    assert Counter((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in rows) == want
    assert simhash.near_duplicates(nothing).collect() == [] == simhash.drop_near_duplicates(nothing).collect()
    kept = simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(set(roots.values()))


def test_the_row_that_stays_does_not_depend_on_partitions(spark):
    text = "one two three four five six"
    rows = [(1, text, f"s{i}", None if i else 3) for i in range(4)] + [(2, text, "s9", 1), (None, text, "s", 1), (1, text, "s3", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n int").withColumn("more", F.create_map(F.lit("k"), F.col("source")))
    kept = {tuple(map(str, r)) for n in (1, 2, 5) for r in simhash.drop_near_duplicates(df.repartition(n)).collect()}
    assert len(kept) == 1
    same = spark.createDataFrame([(1, text, "s", 1)] * 5, "doc_id bigint, text string, source string, n int")
    assert simhash.drop_near_duplicates(same.repartition(3)).count() == 1


def test_op2_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: plain_print(t) for i, t in docs.items()}
    roots = plain_classes(set(prints.values()))
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in Q.op2_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


# ---- top-k ---------------------------------------------------------------------------------------


def plain_top(rows, k, scale, is_query):
    clean = [(i, [int(np.floor(scale * x)) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    queries = {}
    for i, e in sorted(clean, key=lambda r: (r[0], r[1])):
        if is_query(i):
            queries.setdefault(i, e)
    out = set()
    for q, e in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(e, x, strict=False)), i) for i, x in clean if i != q)[:k]
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)}
    return out


def found(df):
    return {tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()}


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "TILE", 32)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 20))
    rows = [(i, (centres[i % 6] + rng.normal(size=20) * 0.2).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(20)]  # ties
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    assert found(topk.top_k(df, F.col("vec_id") % 10 == 0, 5, 16.0)) == plain_top(rows, 5, 16.0, lambda i: i % 10 == 0)


def test_topk_awkward(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []), (None, [9.0, 9.0]), (7, [-1.0, -2.0]), (8, [1e9, 1e9]), (10, [1.0, 2.0, 3.0]), (5, [1.0])]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "vec_id bigint, embedding array<double>, score string, rank int")
    assert found(topk.top_k(df, F.col("vec_id") % 5 == 0, 3)) == plain_top(rows, 3, 256.0, lambda i: i % 5 == 0)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 5 == 0).collect() == []
    assert topk.top_k(df, F.lit(False)).collect() == []
    one = df.filter("vec_id = 0")
    assert topk.top_k(one, F.lit(True)).collect() == []


@pytest.mark.parametrize("width", [1, 2, 3, 37, 64])
def test_bounds_hold(width):
    rng = np.random.default_rng(0)
    x, y = np.floor(rng.normal(size=(40, width)) * 100), np.floor(rng.normal(size=(50, width)) * 100)
    exact = x @ y.T
    bounds = [topk.statistics(x, starts) @ topk.statistics(y, starts).T for starts in topk.levels(width)]
    assert all((b >= exact - 1e-6).all() for b in bounds)
    assert all(fine.mean() <= coarse.mean() for coarse, fine in itertools.pairwise(bounds))


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_bounds_spare_most_exact_scores(sf):
    """On the given embeddings, which have no structure, under half of the pairs are scored."""
    rows = pq.read_table(f"/root/testdata/sf{sf}/embeddings.parquet").to_pydict()
    ids, vectors = np.array(rows["vec_id"]), topk.integers(rows["embedding"], 256.0, 64)
    asked = ids % 50 == 0
    best = topk.Best(topk.Block(ids[asked].tolist(), vectors[asked], 5))
    for a in range(0, len(ids), topk.TILE):
        best.search(ids[a : a + topk.TILE], vectors[a : a + topk.TILE])
    assert best.met == asked.sum() * (len(ids) - 1) and 0 < best.scored < 0.5 * best.met
    print(best.scored / best.met)


def test_op5_equals_sql(same):
    same(Q.op5_topk, Q.ORACLE["op5_topk"])


# ---- repeated strings and windows ------------------------------------------------------------------


def plain_removed(docs, window, split):
    """Documents as (order, units): for each the joined spans of its windows that stood before."""
    seen, out = set(), []
    for _, units in sorted(docs, key=lambda d: d[0]):
        spans = []
        for i in range(len(units) - window + 1):
            w = tuple(units[i : i + window])
            if w in seen:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + window
                else:
                    spans.append([i, i + window])
            seen.add(w)
        out.append([tuple(s) for s in spans])
    del split
    return out


def check_removed(spark, rows, operator, window, units_of):
    """The operator against plain_removed() for rows (doc_id, text); rows equal in both are one document."""
    keys = {r: spark.createDataFrame([r], "doc_id bigint, text string").select(F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).first()[0] for r in set(rows)}
    distinct = sorted(keys, key=lambda r: (r[0] is None, r[0] or 0, keys[r]))
    spans = dict(zip(distinct, plain_removed([(n, units_of(r[1] or "")) for n, r in enumerate(distinct)], window, None), strict=True))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_units"], tuple(map(tuple, r["spans"])), bytes(r["kept"])) for r in operator(df).collect())
    want = Counter()
    for r in rows:
        units, left, at = units_of(r[1] or ""), [], 0
        for a, b in spans[r]:
            left += units[at:a]
            at = b
        left += units[at:]
        kept = bytes(left) if window == suffixes.WINDOW else b" ".join(left)
        want[r[0], len(units), tuple(spans[r]), kept] += 1
    assert got == want
    return sum(b - a for s in spans.values() for a, b in s)


def bytes_of(text):
    return list(text.encode())


def words_of(text):
    return text.encode().split()


def mutated(rng, text, n):
    letters = list(text)
    for _ in range(n):
        letters[rng.randrange(len(letters))] = rng.choice("xyz ")
    return "".join(letters)


@pytest.fixture(scope="module")
def copies(awkward_rows):
    """Exact and near copies, passages in many documents, periodic texts, shared ids."""
    rng = random.Random(6)
    texts = [r[1] for r in awkward_rows if r[1] and len(r[1]) > 200][:8]
    texts = [t if len(t) < 5000 else t[:4000] for t in texts]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, mutated(rng, rng.choice(texts), rng.randrange(4))) for i in range(40)]
    rows += [(200 + i, f"début {i} " + texts[0][50:400] + f" fin {i}") for i in range(15)]
    rows += [(300, "ab" * 300), (301, "a b " * 150), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[3]), (7, texts[4]), (400, None), (401, ""), (402, "kurz")]
    return rows


def test_removed_strings(spark, copies):
    assert check_removed(spark, copies, suffixes.remove_repeated_strings, suffixes.WINDOW, bytes_of) > 10_000


def test_removed_words(spark, copies):
    assert check_removed(spark, copies, superkmers.remove_repeated_words, superkmers.WINDOW, words_of) > 1000


def test_hot_minimisers_are_split(spark, copies, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_VARIANTS", -1)
    monkeypatch.setattr(repeats, "GROUP_BYTES", 3000)
    monkeypatch.setattr(repeats.Corpus.__init__, "__defaults__", (3000,))
    check_removed(spark, copies, suffixes.remove_repeated_strings, suffixes.WINDOW, bytes_of)
    check_removed(spark, copies, superkmers.remove_repeated_words, superkmers.WINDOW, words_of)


def test_long_documents_in_parts(spark, copies, monkeypatch):
    monkeypatch.setattr(suffixes, "PART_UNITS", 150)
    monkeypatch.setattr(superkmers, "PART_UNITS", 150)
    monkeypatch.setattr(repeats, "HASH_BLOCK", 700)
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 500)
    monkeypatch.setattr(suffixes, "SCAN", 50)
    monkeypatch.setattr(suffixes, "PART", 200)
    rows = copies[:25]
    for operator, window, units in ((suffixes.remove_repeated_strings, suffixes.WINDOW, bytes_of), (superkmers.remove_repeated_words, superkmers.WINDOW, words_of)):
        check_removed(spark, rows, operator, window, units)


def test_repeats_awkward(awkward, nothing, awkward_rows, spark):
    plain = [(r[0], r[1]) for r in awkward_rows if r[1] is None or len(r[1]) < 20_000]
    check_removed(spark, plain, suffixes.remove_repeated_strings, suffixes.WINDOW, bytes_of)
    check_removed(spark, plain, superkmers.remove_repeated_words, superkmers.WINDOW, words_of)
    for operator in (suffixes.remove_repeated_strings, superkmers.remove_repeated_words):
        assert operator(nothing).collect() == []
        assert operator(awkward).count() == len(awkward_rows)


def test_repeats_come_from_levels_of_several_batches(spark, copies, monkeypatch):
    """Eight batches: every one after the first finds repeats in the levels, of which there are never more than a logarithm."""
    steps = []
    plain = suffixes.SuffixFamily.add

    def add(self, batch, last=False):
        plain(self, batch, last)
        steps.append(([n for n, _ in self.levels], self.spans[-1].count()))
        for n, table in self.levels:
            windows = [suffixes.Level.read(r["blob"]) for r in table.read(1).collect()]
            assert all((w[1:] > w[:-1]).all() for w in (x.windows(0, len(x.order)) for x in windows)), n

    monkeypatch.setattr(suffixes.SuffixFamily, "add", add)
    monkeypatch.setattr(repeats.Corpus.__init__, "__defaults__", (1000,))
    rows = [(i, t[:900]) for i, t in copies[:50]]
    check_removed(spark, rows, lambda docs: suffixes.remove_repeated_strings(docs, batches=8), suffixes.WINDOW, bytes_of)
    assert [n for n, _ in steps[:-1]] == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]
    assert sum(found > 0 for _, found in steps[1:]) >= 3


def texts_with_repeats(rng, n):
    base = [bytes(rng.integers(97, 101, 300, dtype=np.uint8)) for _ in range(4)]
    return [base[rng.integers(4)][rng.integers(60) :] + bytes(rng.integers(97, 99, int(rng.integers(120)), dtype=np.uint8)) for _ in range(n)]


@pytest.mark.parametrize("part", [150, 1 << 20])
def test_levels_take_in_batches_in_any_order(part, monkeypatch):
    """Buckets' steps against a plain table of windows, with the batches' places out of order and levels absorbed or not."""
    monkeypatch.setattr(suffixes, "PART", part)
    rng = np.random.default_rng(4)
    texts = texts_with_repeats(rng, 60)
    where = rng.permutation(60)
    first, covered, want = {}, set(), set()
    levels, size = {}, suffixes.WINDOW
    for step in range(12):
        own = sorted(range(5 * step, 5 * step + 5), key=lambda i: where[i])
        meta = [np.array(x, dtype=k) for x, k in zip([[where[i] for i in own], [0] * 5, [0] * 5, [0] * 5, [len(texts[i]) - size + 1 for i in own], [len(texts[i]) for i in own], [1] * 5], repeats.META, strict=True)]
        absorbed = {n for n in levels if rng.random() < 0.5}
        level, spans = suffixes.taken_in(repeats.Pieces(meta, [texts[i] for i in own]), levels, absorbed, True)
        levels = {n: x for n, x in levels.items() if n not in absorbed} | {step: suffixes.Level.read(level.blob())}
        covered |= {(i, p) for i, a, b in zip(spans[0].tolist(), spans[3].tolist(), spans[4].tolist(), strict=True) for p in range(a, b - size + 1)}
        for i in own:
            for p in range(len(texts[i]) - size + 1):
                first.setdefault(texts[i][p : p + size], []).append((int(where[i]), p))
    for places in first.values():
        want |= set(sorted(places)[1:])
    # A covered span can be longer than its windows only by windows that are covered too.
    assert covered == want


def seconds(work):
    """The least CPU seconds of three runs, and the last one's result."""
    taken = []
    for _ in range(3):
        begun = time.process_time()
        found = work()
        taken.append(time.process_time() - begun)
    return min(taken), found


def windows_of_words(rng, n):
    """A text of words, a third of it copied, and all places of windows in it."""
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), dtype=np.uint8)) for _ in range(3000)]
    text = b" ".join(words[i] for i in rng.integers(len(words), size=n // 6))
    text = np.frombuffer(text + text[: len(text) // 2], dtype=np.uint8)
    return text, np.arange(len(text) - suffixes.WINDOW + 1)


def test_suffix_array_is_cheaper_than_sorting_strings():
    text, starts = windows_of_words(np.random.default_rng(5), 300_000)
    strings, (_, first) = seconds(lambda: np.unique(suffixes.windows_at(text, starts), return_index=True))
    numbers, (fresh, index) = seconds(lambda: suffixes.suffix_array(text, starts))
    assert (index == first).all() and fresh.sum() == len(first) and fresh[first].all()
    assert numbers < 0.6 * strings


def test_scan_equals_searching_strings():
    rng = np.random.default_rng(6)
    text, starts = windows_of_words(rng, 300_000)
    one, two = (suffixes.Level(text, [], own[suffixes.suffix_array(text, own)[1]]) for own in (starts[rng.random(len(starts)) < 0.7] for _ in range(2)))
    own, other = one.windows(0, len(one.order)), two.windows(0, len(two.order))
    place = np.searchsorted(other, own)
    where, there = suffixes.scanned(one, two)
    assert (where == place).all() and (there == (other[np.minimum(place, len(other) - 1)] == own)).all() and 0 < there.sum() < len(there)


@pytest.mark.parametrize("same", [0, 7, 8, 12, 16, 60, 99])
def test_suffix_array_and_scan_of_long_ties(same, monkeypatch):
    """Windows that are equal for so many bytes, then differ or don't, with zero and high bytes in them."""
    monkeypatch.setattr(suffixes, "SCAN", 7)
    rng = np.random.default_rng(same)
    size = suffixes.WINDOW
    heads = [bytes(rng.integers(256, size=same, dtype=np.uint8)) for _ in range(2)]
    tails = [bytes(x) + bytes(size - same - 1) for x in ([0], [1], [127], [128], [255])]
    windows = [heads[rng.integers(2)] + tails[rng.integers(5)] for _ in range(90)]
    levels = []
    for own in (windows[:60], windows[30:], windows[:1]):
        text, starts = np.frombuffer(b"".join(own), dtype=np.uint8), np.arange(0, size * len(own), size)
        fresh, index = suffixes.suffix_array(text, starts)
        assert index.tolist() == [own.index(x) for x in sorted(set(own))]
        assert fresh.tolist() == [x not in own[:i] for i, x in enumerate(own)]
        levels.append((suffixes.Level(text, [], starts[index]), sorted(set(own))))
    for one, own in levels:
        for two, other in levels:
            where, there = suffixes.scanned(one, two)
            assert where.tolist() == [bisect.bisect_left(other, x) for x in own] and there.tolist() == [x in other for x in own]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60), st.integers(1, 20))
def test_prefix_doubling_orders_suffixes(units, depth):
    order, rank = repeats.ordered(np.array(units, dtype=np.int64) + 1, 1, depth)
    prefixes = [tuple(x + 1 for x in units[i : i + depth]) for i in range(len(units))]
    assert [prefixes[i] for i in order] == sorted(prefixes)
    assert all((rank[i] == rank[j]) == (prefixes[i] == prefixes[j]) for i in range(len(units)) for j in range(len(units)))


def test_windows_are_counted_exactly():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(30)).encode() for _ in range(30)]
    copies = [rng.randrange(1, 4) for _ in texts]
    meta = [np.array(x, dtype=k) for x, k in zip([range(30), [0] * 30, [0] * 30, [0] * 30, [11] * 30, [59] * 30, copies], repeats.META, strict=True)]
    owner, inside, count, first = superkmers.counted(repeats.Pieces(meta, texts))
    windows = [tuple(texts[o].split()[i : i + 20]) for o, i in zip(owner, inside, strict=True)]
    want = Counter()
    for w, o in zip(windows, owner, strict=True):
        want[w] += copies[o]
    assert [want[w] for w in windows] == count.tolist()
    assert [w not in windows[:n] for n, w in enumerate(windows)] == first.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=200), st.integers(1, 12))
def test_sliding_least(values, width):
    keys = np.array(values, dtype=np.uint64)
    if len(keys) >= width:
        assert repeats.sliding_least(keys, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@pytest.mark.parametrize("n", [1, 2, 5, 6, 32])
def test_joint_hash_depends_on_content_alone(n):
    rng = np.random.default_rng(n)
    h = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    twice = np.concatenate([h, h])
    got = repeats.joint(twice, n)
    assert len(got) == 200 - n + 1 and (got[: 100 - n + 1] == got[100 : 200 - n + 1]).all() and len(set(got[:100].tolist())) == 100


def test_deals_are_even(spark):
    keys = repeats.deal_of(spark, 26, 13).keys
    df = spark.createDataFrame([(int(k),) for k in keys], "g int").repartition(13, "g").select(F.spark_partition_id().alias("p"))
    assert sorted(r["p"] for r in df.collect()) == sorted([*range(13)] * 2)
    assert repeats.deal_of(spark, 1000, 4)(np.array([1003], dtype=np.uint64)).tolist() == [3]


def test_op7_and_op8_equal_brute_force(spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    for query, window, units_of, join in ((Q.op7_suffix_dedup, 100, bytes_of, bytes), (Q.op8_substring_dedup, 20, words_of, b" ".join)):
        spans = plain_removed([(i, units_of(t)) for i, t in docs], window, None)
        want = {}
        for (i, t), own in zip(docs, spans, strict=True):
            units, left, at = units_of(t), [], 0
            for a, b in own:
                left += units[at:a]
                at = b
            want[i] = (len(units), sum(b - a for a, b in own), hashlib.sha256(join([*left, *units[at:]])).hexdigest(), len(own))
        for r in query(spark, sf_dir).collect():
            size = r["n_bytes"] if window == 100 else r["n_words"]
            assert (size, r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]][:3]
            assert window == 20 or r["n_spans"] == want[r["doc_id"]][3]


# ---- the pipeline --------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, work in P.STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and 0 < sizes[4] < sizes[3]
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "source_mix", "bpe_encode"]
    staged = sorted(map(tuple, P.STAGES[-1][1](spark, docs, sf_dir).collect()))
    assert staged == sorted(map(tuple, P.run(spark, sf_dir).collect())) and len(staged) == sizes[-1]


def test_pipeline_equals_the_plain_parts(spark, sf_dir):
    """Each stage's decisions, from the operators' reports and brute force."""
    import corpus_pipeline as P
    from likeloom.llm import mixing, quality, secrets

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in quality.quality_report(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in P.quality_rules(spark, docs, sf_dir).collect()} == good
    prints = {i: plain_print(rows[i]["text"]) for i in good}
    roots = plain_classes(set(prints.values()))
    first = {}
    for i in sorted(good):
        first.setdefault(roots[prints[i]], i)
    left = docs.filter(F.col("doc_id").isin(sorted(good)))
    assert {r["doc_id"] for r in P.near_dedup(spark, left, sf_dir).collect()} == set(first.values())
    for r in P.secret_scan(spark, docs, sf_dir).collect():
        assert r["text"] == secrets.redacted(rows[r["doc_id"]]["text"], secrets.Scanner().spans([rows[r["doc_id"]]["text"]])[0])
    drawn = {r["doc_id"] for r in mixing.mixing(docs, P.MIX_BUDGET).filter("sampled").collect()}
    assert {r["doc_id"] for r in P.source_mix(spark, docs, sf_dir).collect()} == drawn


def test_pipeline_stages_awkward(spark, awkward, nothing):
    import corpus_pipeline as P

    for docs in (awkward, nothing):
        for name, work in P.STAGES[:-1]:
            docs = stage(work(spark, docs, ""), name)
            assert docs.columns == awkward.columns
        assert P.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_redaction_joins_overlaps():
    from likeloom.llm import secrets

    assert secrets.redacted("abcdefghij", [("x", 1, 4), ("y", 2, 6), ("z", 8, 9)]) == "a[SECRET]gh[SECRET]j"
