"""A feed's candidate posts from the source table and the moderation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import top
from ..params import CandidateParams


def _visible(source: DataFrame, hidden: DataFrame, now: int, p: CandidateParams) -> DataFrame:
    """Posts not hidden in their feed, not from the future, and written no later than `late` after they came in."""
    gone = hidden.filter("hidden").select("algo_id", "uri").distinct()
    when = F.col("written_at")
    return source.filter((when <= F.col("created_at") + p.late) & (when <= now)).join(gone, ["algo_id", "uri"], "left_anti")


def _newest(posts: DataFrame, limit: int) -> DataFrame:
    return top(posts, limit, ["algo_id"], F.desc("written_at"), F.col("uri"), name="place").select("algo_id", "uri", "written_at", "place")


def candidates(source: DataFrame, hidden: DataFrame, now: int, max_age: int, p: CandidateParams) -> DataFrame:
    """(algo_id, uri, written_at, place): each feed's newest visible posts of an age. Times are unix seconds."""
    return _newest(_visible(source.filter(F.col("written_at") >= now - max_age), hidden, now, p), p.limit)


def candidates_widened(source: DataFrame, hidden: DataFrame, now: int, p: CandidateParams) -> DataFrame:
    """candidates() of the preferred age, or of the fallback age for feeds with too few; one pass over the source for both.

    A feed's posts within the preferred age count up to the limit, as in a query that is cut there.
    """
    wide = _visible(source.filter(F.col("written_at") >= now - max(p.preferred_age, p.fallback_age)), hidden, now, p)
    preferred: Column = F.col("written_at") >= now - p.preferred_age
    counted = wide.withColumn("n", F.least(F.count_if(preferred).over(Window.partitionBy("algo_id")), F.lit(p.limit)))
    chosen = F.when(F.col("n") < p.minimum, F.col("written_at") >= now - p.fallback_age).otherwise(preferred)
    return _newest(counted.filter(chosen), p.limit)


def no_candidates(source: DataFrame) -> DataFrame:
    """The source of a feed that only administrators fill."""
    return source.limit(0)


def added(posts: DataFrame, more: DataFrame) -> DataFrame:
    """posts (algo_id, post_id) with more, each once."""
    return posts.select("algo_id", "post_id").unionByName(more.select("algo_id", "post_id")).distinct()


def removed(posts: DataFrame, less: DataFrame) -> DataFrame:
    return posts.join(less.select("algo_id", "post_id").distinct(), ["algo_id", "post_id"], "left_anti")


def listed(posts: DataFrame, limit: int | None = None) -> DataFrame:
    """The first posts of each feed: 10 000, or as many as asked for up to 50 000."""
    return top(posts, min(limit or 10_000, 50_000), ["algo_id"], F.col("post_id"))
