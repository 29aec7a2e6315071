"""Streaming counts of users' liked authors.

A micro-batch writes its own counts to a folder of its own, which a batch that is done again
overwrites, so that no like is counted twice. Reading sums them; a user's counts go when the user was
not active for `ttl` seconds, however old each count is; the best authors of each user stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expressions import author_of, top
from ..params import DAY
from ..sources import events
from ..storage import release, store_of
from . import ingest

COUNTS = "user_id bigint, author_did string, like_count bigint, last_ts bigint"


def increments(likes: DataFrame) -> DataFrame:
    """COUNTS of parsed events: likes of each author by each user; likes of posts without an author count for none."""
    authored = likes.withColumn("author_did", author_of(F.col("post_uri"))).filter("author_did IS NOT NULL")
    keyed = authored.select(ingest.user_key().alias("user_id"), "author_did", "like_ts")
    return keyed.groupBy("user_id", "author_did").agg(F.count("*").alias("like_count"), F.max("like_ts").alias("last_ts"))


def summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("user_id", "author_did").agg(F.sum("like_count").alias("like_count"), F.max("last_ts").alias("last_ts"))


def count(lines: DataFrame, path: str, checkpoint: str, now_us: int | None = None, interval: str | None = None) -> StreamingQuery:
    """Starts counting streamed lines into the folder at path."""

    def flush(batch: DataFrame, number: int) -> None:
        increments(batch).write.mode("overwrite").parquet(f"{path}/{number:012d}")

    writer = events.parsed(lines, now_us).writeStream.option("checkpointLocation", checkpoint).foreachBatch(flush)
    return writer.trigger(processingTime=interval).start() if interval else writer.trigger(availableNow=True).start()


def parts(spark: SparkSession, path: str) -> list[str]:
    store, at = store_of(spark, path)
    return sorted(str(s.getPath()) for s in store.listStatus(at) if s.isDirectory()) if store.exists(at) else []


def liked_authors(spark: SparkSession, path: str, now: int, n: int = 500, ttl: int = 8 * DAY) -> DataFrame:
    """(user_id, author_did, like_count): the n most liked authors of users who liked something within ttl."""
    found = parts(spark, path)
    counts = summed(spark.read.schema(COUNTS).parquet(*found)) if found else spark.createDataFrame([], COUNTS)
    active = counts.withColumn("active", F.max("last_ts").over(Window.partitionBy("user_id"))).filter(F.col("active") > now - ttl)
    return top(active, n, ["user_id"], F.desc("like_count"), F.col("author_did")).select("user_id", "author_did", "like_count")


def compact(spark: SparkSession, path: str) -> None:
    """Sums all folders but the newest, which the stream may do again, into one in place of the newest of them.

    The sum is written aside with the list of what it holds, and only then the folders go and it gets
    the newest one's name: what a crash leaves in between is finished by the next call.
    """
    store, root = store_of(spark, path)
    ready = f"{path.rstrip('/')}-sum"
    aside, at = store_of(spark, ready)
    if aside.exists(at) and not aside.exists(store_of(spark, f"{ready}/_SUCCESS")[1]):
        release(spark, ready)
    found = parts(spark, path)
    if not aside.exists(at):
        if len(found) < 3:
            return
        summed(spark.read.schema(COUNTS).parquet(*found[:-1])).write.parquet(f"{ready}/sum")
        spark.createDataFrame([(f,) for f in found[:-1]], "folder string").coalesce(1).write.text(f"{ready}/folders")
        store.create(store_of(spark, f"{ready}/_SUCCESS")[1]).close()
    done = [r[0] for r in spark.read.text(f"{ready}/folders").collect()]  # folders of micro-batches
    release(spark, *done)
    source = store_of(spark, f"{ready}/sum")[1]
    if aside.exists(source):
        store.rename(source, store_of(spark, max(done))[1])
    release(spark, ready)
