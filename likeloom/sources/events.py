"""Like events as the firehose sends them: JSON text, one event a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import day_of
from ..schema import EVENT, LIKE_COLLECTION


def parsed(lines: DataFrame, now_us: int | None = None) -> DataFrame:
    """(user_did, post_uri, time_us, like_ts, like_date) of the like events in lines (value); all other lines are left out.

    An event without a time gets now_us, or the time of the batch.
    """
    now = F.lit(now_us) if now_us is not None else F.unix_micros(F.current_timestamp())
    event = lines.select(F.from_json("value", EVENT).alias("e")).select("e.*")
    uri = F.col("commit.record.subject.uri")
    likes = event.filter((F.col("kind") == "commit") & (F.col("commit.collection") == LIKE_COLLECTION) & (F.col("commit.operation") == "create") & uri.isNotNull() & F.col("did").isNotNull())
    timed = likes.select(F.col("did").alias("user_did"), uri.alias("post_uri"), F.coalesce("time_us", now).alias("time_us"))
    seconds = F.floor(F.col("time_us") / 1_000_000).cast("bigint")
    return timed.withColumn("like_ts", seconds).withColumn("like_date", day_of(F.col("like_ts")))


def replay(lines: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """The like events of a past span [start, end); count() of it is a dry run."""
    return parsed(lines, 0).filter((F.col("time_us") >= start_us) & (F.col("time_us") < end_us))


def stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of lines from files that arrive in a folder; admission control bounds a micro-batch."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def backoff(attempt: int, jitter: float, least: float = 1.0, most: float = 60.0) -> float:
    """Seconds before the next attempt to connect: doubled each time, with up to a quarter more; jitter in [0, 1)."""
    return min(least * 2**attempt, most) * (1 + 0.25 * jitter)
