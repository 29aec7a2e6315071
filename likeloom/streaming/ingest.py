"""Streaming ingest of likes with Structured Streaming.

The checkpoint holds the offsets and commits, so a restart goes on where the last micro-batch was
committed; a batch that was cut off is done again, and merging makes that harmless: an edge is one
row for user, post and day with its latest time.

A micro-batch writes what it has to a folder of its own (a delta), which costs no more than the batch.
Every so many deltas are compacted into the day partitions: the days they touch are merged with what
they hold and written aside, then put in place of the partitions, then the deltas go. The copy aside
is whole before anything is replaced and stays until everything is, so whoever comes next after a
crash finishes the replacement first (recover()). A day is written by as many tasks as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expressions import hash16, top
from ..schema import LIKE_COLUMNS, LIKES
from ..sources import events
from ..storage import release, store_of

#: Names of the folders beside a table's own: its deltas, and the copy that a compaction is about to put in place.
DELTAS, ASIDE = "-deltas", "-merge"


def user_key() -> Column:
    return F.conv(hash16(F.col("user_did")), 16, -10).cast("bigint")


def edges(likes: DataFrame) -> DataFrame:
    """Parsed events as edges whose user and post are 64-bit hashes of their names: no dictionary is needed to write them."""
    return likes.select(
        user_key().alias("user_id"),
        F.xxhash64("post_uri").alias("post_id"),
        "like_ts",
        "like_date",
    )


def _deltas(spark: SparkSession, path: str) -> list[str]:
    """The complete deltas of a table."""
    store, at = store_of(spark, path.rstrip("/") + DELTAS)
    if not store.exists(at):
        return []
    found = [str(s.getPath()) for s in store.listStatus(at)]
    return sorted(f for f in found if store.exists(store_of(spark, f"{f}/_SUCCESS")[1]))


def _merged(edges_: DataFrame, cap: int | None) -> DataFrame:
    latest = edges_.groupBy("user_id", "post_id", "like_date").agg(F.max("like_ts").alias("like_ts")).select(*LIKE_COLUMNS)
    return top(latest, cap, ["user_id", "like_date"], F.desc("like_ts"), F.col("post_id")) if cap else latest


def current(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """The table's edges, those of deltas that are not compacted yet among them."""
    store, root = store_of(spark, path)
    parts = [spark.read.schema(LIKES).parquet(path).select(*LIKE_COLUMNS)] if store.exists(root) else [spark.createDataFrame([], LIKES)]
    if deltas := _deltas(spark, path):
        parts.append(spark.read.schema(LIKES).parquet(*deltas).select(*LIKE_COLUMNS))
    return _merged(parts[0].unionByName(parts[-1]), cap) if len(parts) > 1 else parts[0]


def _put(spark: SparkSession, path: str) -> None:
    """The copy aside in place of the partitions of its days."""
    ready = spark.read.schema(LIKES).parquet(path.rstrip("/") + ASIDE)
    ready.hint("rebalance", "like_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("like_date").parquet(path)


def recover(spark: SparkSession, path: str) -> bool:
    """Finishes a compaction that was cut off while it replaced partitions; drops one that was cut off before. True if there was one to finish."""
    aside = path.rstrip("/") + ASIDE
    store, at = store_of(spark, aside)
    if not store.exists(at):
        return False
    whole = store.exists(store_of(spark, f"{aside}/_SUCCESS")[1])
    if whole:
        _put(spark, path)
    release(spark, aside)
    return whole


def compact(spark: SparkSession, path: str, cap: int | None = None) -> None:
    """Merges the deltas into the day partitions; a user keeps the `cap` latest of a day. Deltas that are merged twice change nothing."""
    recover(spark, path)
    deltas = _deltas(spark, path)
    if not deltas:
        return
    new = spark.read.schema(LIKES).parquet(*deltas).select(*LIKE_COLUMNS)
    days = [r[0] for r in new.select("like_date").distinct().collect()]  # the days of some micro-batches
    store, root = store_of(spark, path)
    if store.exists(root):
        new = new.unionByName(spark.read.schema(LIKES).parquet(path).filter(F.col("like_date").isin(days)).select(*LIKE_COLUMNS))
    _merged(new, cap).write.mode("overwrite").parquet(path.rstrip("/") + ASIDE)
    _put(spark, path)
    release(spark, *deltas)
    release(spark, path.rstrip("/") + ASIDE)


def merge(spark: SparkSession, batch: DataFrame, path: str, cap: int | None = None, number: int = 0, every: int = 1) -> None:
    """Takes a batch of edges into the table at path: as delta `number`, which a batch that is done again overwrites; compacts when there are `every` deltas."""
    recover(spark, path)
    _merged(batch, cap).write.mode("overwrite").parquet(f"{path.rstrip('/')}{DELTAS}/{number:012d}")
    if len(_deltas(spark, path)) >= every:
        compact(spark, path, cap)


def ingest(lines: DataFrame, path: str, checkpoint: str, keep_from: str | None = None, cap: int | None = 5000, now_us: int | None = None, interval: str | None = None, every: int = 1) -> StreamingQuery:
    """Starts the ingest of streamed lines into the table at path. keep_from: days before it are dropped, however late they come.

    Without an interval all there is is taken in and the query ends. every: micro-batches between two
    compactions; with more than one, current() reads the table.
    """
    likes = edges(events.parsed(lines, now_us))
    likes = likes if keep_from is None else likes.filter(F.col("like_date") >= keep_from)
    writer = likes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: merge(batch.sparkSession, batch, path, cap, n, every))
    return writer.trigger(processingTime=interval).start() if interval else writer.trigger(availableNow=True).start()


def windowed_counts(lines: DataFrame, late: str = "8 days", width: str = "1 day", now_us: int | None = None) -> DataFrame:
    """A stream of likes by tumbling window of event time; later events than the watermark are dropped, which bounds the state."""
    timed = events.parsed(lines, now_us).withColumn("at", F.timestamp_seconds("like_ts"))
    return timed.withWatermark("at", late).groupBy(F.window("at", width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def expire(spark: SparkSession, path: str, before: str) -> int:
    """Deletes the day partitions before a day; returns how many. Retention is by whole partitions."""
    store, root = store_of(spark, path)
    gone = [s.getPath() for s in store.listStatus(root) if s.getPath().getName().startswith("like_date=") and s.getPath().getName()[10:] < before]
    for day in gone:
        store.delete(day, True)
    return len(gone)
