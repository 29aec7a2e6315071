"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments, coarse to fine. With each segment's mean and deviation,
Cauchy-Schwarz bounds what two segments can add to the inner product:
  sum(q * x) <= m * (mean(q) * mean(x) + dev(q) * dev(x))   for m components,
which, with the vectors' norms, is the same as a lower bound of their distance. Each level bounds
the survivors of the level before; those whose bound stays below the query's k-th best score so
far go. The last level has pairs of components and single ones in turn. Of what survives it, each
query's most promising candidates get their exact integer scores first, which raises the k-th best
for the rest.

Queries are put down as a table in blocks of about QUERY_BLOCK. Block by block they come to the driver,
go to the tasks of one pass over the vectors, and leave again when that pass's answers are written, so
neither the driver's memory nor a plan grows with the queries. A task keeps the k best per query of
what it has seen, so k rows a query and task are shuffled.

Scores are exact: components are integers floor(scale * x), and products are summed in doubles
only where they stay below 2 ** 53, else in Python integers. Scores beyond a long are put as its
end.

Edge cases: vectors that are null or hold a null or non-finite component take no part, as query or
candidate; a shorter vector counts as filled up with zeros; an empty vector has score 0; a null id
takes no part; rows that share an id are candidates each on its own, none for the query of that id,
and such a query is its first vector in ascending order; queries without candidates have no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Table, workspace

#: Queries broadcast and searched at once: with 64 components, 1 MB.
QUERY_BLOCK = 2048
#: Candidates compared with a query block at once.
TILE = 512
#: Pairs of a query and a candidate that are scored at once.
PAIRS = 1 << 16

LONG = (-(1 << 63), (1 << 63) - 1)


def _clean(vectors: Column) -> Column:
    """True for arrays without null and non-finite components."""
    return vectors.isNotNull() & ~F.exists(vectors, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def integers(rows: list[list[float]], scale: float, width: int) -> np.ndarray:
    """floor(scale * x) of each component, zeros up to width; Python integers where doubles can't sum their products exactly."""
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x[:width]
    return np.floor(out * scale)


def levels(width: int) -> list[np.ndarray]:
    """The first components of the segments at each level: 1, 4, 16... segments, then pairs, then pairs and single components in turn."""
    counts = [4**i for i in range(16) if 4**i < width / 2] or [1]
    out = [np.unique(np.arange(n) * width // n) for n in counts]
    if width > 2:
        pairs = np.arange(0, width, 2)
        out += [pairs, np.union1d(pairs, np.arange(1, width, 4))]
    return out


class Block:
    """Queries with their statistics at each level."""

    def __init__(self, ids: list[int], vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = np.array(ids, dtype=np.int64), vectors, k
        self.levels = levels(max(1, vectors.shape[1]))
        self.stats = [statistics(vectors, starts) for starts in self.levels]


def statistics(vectors: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """sqrt(m) * (mean, deviation) of each segment, side by side; the dot product of two rows is the bound. Single components have no deviation."""
    n, width = vectors.shape
    if not width:
        return np.zeros((n, 1))
    m = np.diff(np.append(starts, width))
    mean = np.add.reduceat(vectors, starts, axis=1) / m
    square = np.add.reduceat((vectors - np.repeat(mean, m, axis=1)) ** 2, starts, axis=1)
    return np.hstack([np.sqrt(m) * mean, np.sqrt(square[:, m > 1])])


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of paired rows as integers (int64, or objects beyond it)."""
    big = max(np.abs(left).max(initial=0), np.abs(right).max(initial=0))
    if big**2 * max(left.shape[1], 1) < 2**53:
        return np.einsum("ij,ij->i", left, right).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(left, right, strict=True)]
    return np.array([min(max(s, LONG[0]), LONG[1]) for s in sums], dtype=np.int64)


class Best:
    """The k best (score, id) of each query so far; ties go to smaller ids."""

    def __init__(self, block: Block):
        n = len(block.ids)
        self.block = block
        #: Pairs of a query and a candidate met, and scored exactly.
        self.met = self.scored = 0
        self.scores = np.full((n, block.k), LONG[0], dtype=np.int64)
        self.ids = np.full((n, block.k), LONG[1], dtype=np.int64)
        self.filled = np.zeros((n, block.k), dtype=bool)

    def least(self) -> np.ndarray:
        """The score that a candidate must reach, -inf where fewer than k are known."""
        return np.where(self.filled[:, -1], self.scores[:, -1].astype(float), -np.inf)

    def add(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        k, own = self.block.k, np.unique(query)
        query = np.concatenate([query, np.repeat(own, k)])
        scores = np.concatenate([scores, self.scores[own].ravel()])
        ids = np.concatenate([ids, self.ids[own].ravel()])
        filled = np.concatenate([np.ones(len(ids) - len(own) * k, dtype=bool), self.filled[own].ravel()])
        order = np.lexsort((ids, ~scores, ~filled, query))  # ~score descends without overflow
        query, scores, ids, filled = query[order], scores[order], ids[order], filled[order]
        first = np.searchsorted(query, own)
        take = first[:, None] + np.arange(k)
        self.scores[own], self.ids[own], self.filled[own] = scores[take], ids[take], filled[take]

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Takes in candidates, at most TILE of them."""
        block, least = self.block, self.least()
        rows, columns = np.arange(len(block.ids)), np.arange(len(ids))
        alive = block.ids[:, None] != ids
        self.met += int(alive.sum())
        for starts, queries in zip(block.levels, block.stats, strict=True):
            stats = statistics(vectors[columns], starts)
            bound = queries[rows] @ stats.T
            # Rounding of the bound itself, in proportion to the norms, and of the score.
            error = 1e-9 * (1 + np.sqrt((queries**2).sum(axis=1).max(initial=0) * (stats**2).sum(axis=1).max(initial=0)))
            bound += error + 1e-9 * (1 + np.abs(np.where(np.isfinite(least[rows]), least[rows], 0)))[:, None]
            alive &= bound >= least[rows][:, None]
            kept, left = alive.any(axis=1), alive.any(axis=0)  # what no pair is left of goes before the next level
            rows, columns, alive, bound = rows[kept], columns[left], alive[np.ix_(kept, left)], bound[np.ix_(kept, left)]
        if not alive.size:
            return
        first, some = np.zeros_like(alive), min(2 * block.k, alive.shape[1])
        best = np.argpartition(np.where(alive, -bound, np.inf), some - 1, axis=1)[:, :some]
        np.put_along_axis(first, best, True, axis=1)
        self._score(rows, columns, alive & first, ids, vectors)
        self._score(rows, columns, alive & ~first & (bound >= self.least()[rows][:, None]), ids, vectors)

    def _score(self, rows: np.ndarray, columns: np.ndarray, chosen: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        i, j = np.nonzero(chosen)
        self.scored += len(i)
        for a in range(0, len(i), PAIRS):
            query, candidate = rows[i[a : a + PAIRS]], columns[j[a : a + PAIRS]]
            self.add(query, exact_scores(self.block.vectors[query], vectors[candidate]), ids[candidate])


def _search(block: Block, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, width = Best(block), block.vectors.shape[1]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(ids), TILE):
                part = batch.column(1).slice(a, TILE)
                rows = part.to_pylist()
                best.search(ids[a : a + TILE].astype(np.int64), integers(rows, scale, width))
        query, place = np.nonzero(best.filled)
        yield pa.record_batch([pa.array(block.ids[query]), pa.array(best.ids[query, place]), pa.array(best.scores[query, place])], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query. vectors: (vec_id, embedding)."""
    spark, width = vectors.sparkSession, "query_id long, rank int, vec_id long, score long"
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("_query"))
    clean = clean.filter(F.col("vec_id").isNotNull() & _clean(F.col("embedding")))
    queries = clean.filter("_query").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-clean.filter("_query").count() // QUERY_BLOCK))
    asked = Table(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "queries", by=("block",))
    answers = workspace(spark, "nearest")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for b in range(blocks):
        rows = asked.read(b).toArrow().to_pydict()  # about QUERY_BLOCK rows, whatever the table's size
        if rows["vec_id"]:
            block = Block(rows["vec_id"], integers(rows["embedding"], scale, max(map(len, rows["embedding"]))), k)
            found = clean.select("vec_id", "embedding").mapInArrow(_search(block, scale), "query_id long, vec_id long, score long")
            ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            ranked.select("query_id", "rank", "vec_id", "score").write.parquet(f"{answers}/block={b}")
        asked.drop(b)
    return spark.read.schema(f"{width}, block int").parquet(answers).drop("block")
