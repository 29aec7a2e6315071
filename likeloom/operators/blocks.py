"""The walk's last step, users -> sources -> posts, by blocks of users: a block gets each source's list once.

A path from a user over a source to a post is only an intermediate result, of which there are many times
as many as likes. Joined and summed by key, all of them go through a shuffle. Here the users are dealt
into blocks of neighbouring ids, the sources' lists go to the blocks that have the source, and a block's
paths are made and summed in numpy, a bounded number at a time: nothing of a path's size is ever dealt out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import staged

#: Edges user -> source of a block; fewer where that leaves machines idle. Paths that are held at once (one user's at least).
MOST_EDGES, FEW_EDGES, MOST_PATHS = 500_000, 20_000, 1 << 18
#: What stands for a null feed, and for the feed of a post that is in none.
NULL, NO_FEED = -(1 << 63), -(1 << 63) + 1


@dataclass(frozen=True)
class Scoring:
    """What becomes of the paths. cap: of weights; fading: a source's factor from one post to the next, among the posts not excluded.

    checks: the best posts of a user by raw score that are looked up in the feeds (0: all). results: of a
    feed and user by score (0: all). by_paths: the penalty is of the paths, not the likers. contributors: paths listed.
    """

    boost: float
    popularity: float
    cap: float | None = None
    fading: float = 1.0
    min_overlap: int = 1
    positive: bool = True
    by_paths: bool = False
    checks: int = 0
    results: int = 0
    contributors: int = 0


def _block_of(bounds: list[float]) -> Column:
    """The number of bounds that a user's id is above, by halving."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("user_id") <= F.lit(int(bounds[mid])), among(low, mid)).otherwise(among(mid + 1, high))

    return among(0, len(bounds))


def walked(weights: DataFrame, items: DataFrame, excluded: DataFrame | None, s: Scoring) -> DataFrame:
    """(algo_id, user_id, post_id, raw_score, paths, liker_count, score, rank[, contributors]) for all users of the weights.

    weights: (user_id, source_id, weight), each pair once. items: (source_id, algo_id, post_id, liker_count,
    like_ts, factor), what each source leads to; a path adds weight * factor. excluded: (user_id, post_id).
    Ids are integers. A user's weights and a source's items are one array each. contributors: array of
    (source_id, weight, recency, contribution), the largest first, ties by source_id.
    """
    spark = weights.sparkSession
    kinds = dict(items.dtypes) | {"user_id": dict(weights.dtypes)["user_id"]}
    both = weights.groupBy("user_id").agg(F.collect_list(F.struct("source_id", "weight")).alias("x"))
    both = both.select(F.col("user_id").cast("long").alias("user_id"), F.col("x.source_id").cast("array<bigint>").alias("sources"), F.col("x.weight").cast("array<double>").alias("weights"))
    if excluded is None:
        both = both.withColumn("gone", F.lit(None).cast("array<bigint>"))
    else:
        gone = excluded.groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.collect_list(F.col("post_id").cast("long")).alias("gone"))
        both = both.join(gone, "user_id", "left")
    users = staged(both, "users")
    n_users, edges = users.agg(F.count("*"), F.coalesce(F.sum(F.size("sources")), F.lit(0))).first()
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges // FEW_EDGES))
    n = max(1, min(n_users, max(least, -(-edges // MOST_EDGES))))
    bounds = users.approxQuantile("user_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    users = users.withColumn("block", _block_of(bounds))

    entry = F.struct(
        F.coalesce(F.col("algo_id").cast("long"), F.lit(NULL)).alias("algo_id"), (-F.col("like_ts")).alias("_order"), F.col("post_id").cast("long").alias("post_id"),
        F.col("liker_count").cast("long").alias("liker_count"), F.col("factor").cast("double").alias("factor"),
    )
    lists = staged(items.groupBy(F.col("source_id").cast("long").alias("source_id")).agg(F.sort_array(F.collect_list(entry)).alias("x")), "lists")
    asked = users.select("block", F.explode("sources").alias("source_id")).distinct()
    lists = asked.join(lists, "source_id").select("block", F.lit(0).alias("kind"), F.col("source_id").alias("id"), F.col("x.post_id").alias("a"), F.col("x.liker_count").alias("b"), F.col("x.algo_id").alias("c"), F.col("x.factor").alias("x"))
    users = users.select("block", F.lit(1).alias("kind"), F.col("user_id").alias("id"), F.col("sources").alias("a"), F.col("gone").alias("b"), F.lit(None).cast("array<bigint>").alias("c"), F.col("weights").alias("x"))
    dealt = lists.unionByName(users).repartitionById(n, F.col("block")).sortWithinPartitions("kind")
    schema = "algo_id long, user_id long, post_id long, raw_score double, paths long, liker_count long, score double, rank int"
    schema += ", contributors array<struct<source_id:long,weight:double,recency:double,contribution:double>>" * bool(s.contributors)
    found = dealt.mapInArrow(_scorer(s), schema)
    return found.withColumns({c: F.col(c).cast(kinds[c]) for c in ("algo_id", "user_id", "post_id", "liker_count") if kinds[c] != "bigint"})


def _flat(lists: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _order(keys: np.ndarray, most: int) -> np.ndarray:
    """A stable order of keys from 0 to below most: key and place in one number where that fits, which sorts much faster."""
    bits = max(1, len(keys) - 1).bit_length()
    if most.bit_length() + bits > 62:
        return np.argsort(keys, kind="stable")
    return np.sort((keys << bits) | np.arange(len(keys))) & ((1 << bits) - 1)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _places(new: np.ndarray) -> np.ndarray:
    """Each row's place in its run, from 0."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


class _Block:
    """A block's lists, and the scores of its users."""

    def __init__(self, batches: list[pa.RecordBatch], s: Scoring):
        self.s = s
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda c: table[c].combine_chunks() if table[c].num_chunks != 1 else table[c].chunk(0)
        ids = table["id"].to_numpy()
        posts, lengths = _flat(column("a"), np.int64)
        likers, algos, self.factor = _flat(column("b"), np.int64)[0], _flat(column("c"), np.int64)[0], _flat(column("x"), np.float64)[0]
        by_id = np.argsort(ids)
        self.sources, self.length, self.start = ids[by_id], lengths[by_id], _ends(lengths)[:-1][by_id]
        self.posts, post = np.unique(posts, return_inverse=True)
        known, algo = np.unique(algos, return_inverse=True)
        # Items are numbered by feed, then post.
        item, at, self.item = np.unique(algo * len(self.posts) + post, return_index=True, return_inverse=True)
        self.post, self.algo, self.likers = item % max(1, len(self.posts)), algos[at], likers[at]
        self.feed = algo[at]

    def batches(self, users: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = users.column("id").to_numpy()
        sources, n_sources = _flat(users.column("a"), np.int64)
        gone, n_gone = _flat(users.column("b"), np.int64)
        weights = _flat(users.column("x"), np.float64)[0]
        at = np.minimum(np.searchsorted(self.sources, sources), len(self.sources) - 1)
        length = np.where(self.sources[at] == sources, self.length[at], 0)
        edge, out = _ends(n_sources), _ends(n_gone)
        paths = _ends(length)[edge]  # before each user
        first = 0
        while first < len(ids):
            last = max(first + 1, int(np.searchsorted(paths, paths[first] + MOST_PATHS, "right")) - 1)
            if paths[last] > paths[first]:
                e, g = slice(edge[first], edge[last]), slice(out[first], out[last])
                part = self.scored(ids[first:last], sources[e], weights[e], at[e], length[e], n_sources[first:last], gone[g], n_gone[first:last])
                if part.num_rows:
                    yield part
            first = last

    def scored(self, ids, sources, weights, at, length, n_sources, gone, n_gone) -> pa.RecordBatch:
        s, n_posts, n_items = self.s, len(self.posts), len(self.post)
        entry = np.arange(length.sum()) + np.repeat(self.start[at] - _ends(length)[:-1], length)
        edge = np.repeat(np.arange(len(at)), length)
        user, item = np.repeat(np.arange(len(ids)), n_sources)[edge], self.item[entry]
        recency = self.factor[entry]
        place = np.minimum(np.searchsorted(self.posts, gone), n_posts - 1)
        known = self.posts[place] == gone
        gone = np.unique((np.repeat(np.arange(len(ids)), n_gone) * n_posts + place)[known])

        def shown(user: np.ndarray, item: np.ndarray) -> np.ndarray:
            if not len(gone):
                return np.ones(len(user), bool)
            key = user * n_posts + self.post[item]
            return gone[np.minimum(np.searchsorted(gone, key), len(gone) - 1)] != key

        if s.fading != 1.0:  # a source's rank counts only the posts that the user can be shown
            keep = shown(user, item)
            edge, user, item, recency = edge[keep], user[keep], item[keep], recency[keep]
            if len(edge):
                rank = _places(_firsts(edge, self.feed[item]))
                recency = recency * (s.fading ** np.arange(rank.max() + 1, dtype=float))[rank]
        part = (np.minimum(weights, s.cap) if s.cap else weights)[edge] * recency
        key = user * n_items + item
        order = _order(key, len(ids) * n_items)
        key = key[order]
        starts = np.flatnonzero(_firsts(key))
        if not len(starts):
            return self.batch(ids, *([np.zeros(0, np.int64)] * 5), None)
        raw, n = np.add.reduceat(part[order], starts), np.diff(np.append(starts, len(key)))
        user, item = np.divmod(key[starts], n_items)
        keep = n >= s.min_overlap
        if s.positive:
            keep &= raw > 0
        if s.fading == 1.0:
            keep &= shown(user, item)
        user, item, raw, n, starts = user[keep], item[keep], raw[keep], n[keep], starts[keep]
        if s.checks:  # rows of one post in several feeds have one place
            best = np.lexsort((self.post[item], -raw, user))
            new = _firsts(user[best], self.post[item][best])
            counted = np.cumsum(new)
            place = counted - np.maximum.accumulate(np.where(_firsts(user[best]), counted - 1, 0))
            best = np.sort(best[(place <= s.checks) & (self.algo[item][best] != NO_FEED)])
            user, item, raw, n, starts = user[best], item[best], raw[best], n[best], starts[best]
        base = n if s.by_paths else self.likers[item]
        score = raw
        if s.boost > 0 and len(n):
            score = score * (np.arange(n.max() + 1, dtype=float) ** s.boost)[n]
        if s.popularity > 0:
            score = score * (1.0 / np.maximum(base, 1)) ** (s.popularity * 0.5)
        # Rows stand by user, feed and post; those of a feed and user go by score.
        group = np.cumsum(_firsts(user, self.feed[item])) - 1 if len(user) else user
        best = np.argsort(-score, kind="stable")
        best = best[_order(group[best], int(group[-1]) + 1 if len(group) else 1)]
        rank = _places(_firsts(group[best])) + 1 if len(best) else best
        if s.results:
            best, rank = best[rank <= s.results], rank[rank <= s.results]
        lists = None
        if s.contributors:
            lists = self.contributions(starts[best], n[best], order, edge, part, recency, sources, weights)
        return self.batch(ids, user[best], item[best], raw[best], n[best], score[best], lists, rank)

    def contributions(self, starts, n, order, edge, part, recency, sources, weights) -> pa.Array:
        """The paths that add most to each row."""
        path = order[np.arange(n.sum()) + np.repeat(starts - _ends(n)[:-1], n)]
        row = np.repeat(np.arange(len(n)), n)
        best = np.lexsort((sources[edge[path]], -part[path], row))
        best = best[_places(_firsts(row[best])) < self.s.contributors] if len(best) else best
        path = path[best]
        each = pa.StructArray.from_arrays([pa.array(sources[edge[path]]), pa.array(weights[edge[path]]), pa.array(recency[path]), pa.array(part[path])], names=["source_id", "weight", "recency", "contribution"])
        return pa.ListArray.from_arrays(pa.array(_ends(np.minimum(n, self.s.contributors)).astype(np.int32)), each)

    def batch(self, ids, user, item, raw, n, score, lists=None, rank=None) -> pa.RecordBatch:
        algo = self.algo[item]
        columns = {
            "algo_id": pa.array(algo, mask=algo == NULL), "user_id": pa.array(ids[user]), "post_id": pa.array(self.posts[self.post[item]]), "raw_score": pa.array(raw.astype(float)),
            "paths": pa.array(n.astype(np.int64)), "liker_count": pa.array(self.likers[item]), "score": pa.array(score.astype(float)), "rank": pa.array((n if rank is None else rank).astype(np.int32)),
        }
        if lists is not None:
            columns["contributors"] = lists
        return pa.RecordBatch.from_pydict(columns)


def _scorer(s: Scoring) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a partition's rows, the lists stand first."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, block = [], None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            cut = int(np.searchsorted(kind, 1))
            if cut:
                lists.append(batch.slice(0, cut))
            if cut < len(kind) and lists:
                block = block or _Block(lists, s)
                yield from block.batches(batch.slice(cut))

    return score
