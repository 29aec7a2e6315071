"""Fallback lists of the feeds, all from one table of post statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import day_of, decay, retained_days, top
from ..params import DECAY, HOUR, TrancheParams


def candidate_counts(candidates: DataFrame, likes: DataFrame, now: int, days: int) -> DataFrame:
    """(algo_id, post_id, liker_count): likers by day summed over the retained days, 0 for posts without."""
    kept = likes.filter(F.col("like_date").isin(*retained_days(now, days)))
    counts = kept.groupBy("post_id").agg(F.count_distinct("user_id", "like_date").alias("liker_count"))
    return candidates.select("algo_id", "post_id").distinct().join(counts, "post_id", "left").select("algo_id", "post_id", F.coalesce("liker_count", F.lit(0)).alias("liker_count"))


def post_stats(candidates: DataFrame, likes: DataFrame, now: int, p: TrancheParams) -> DataFrame:
    """(algo_id, post_id, likes, recent, post_time): what all tranches need, in one aggregation of the likes.

    Likes are aggregated by post before they meet the candidates, so a post in many feeds is counted once.
    """
    kept = likes.filter(F.col("like_date").isin(*retained_days(now, p.retention_days))) if p.retention_days else likes
    when = F.min("like_ts") if p.post_time == "first_like" else F.min(F.when(F.col("like_date") == day_of(F.lit(now)), F.col("like_ts")))
    stats = kept.groupBy("post_id").agg(
        F.count_distinct("user_id", "like_date").alias("likes"),
        F.count_if(F.col("like_ts").between(now - p.velocity_window, now)).alias("recent"),
        when.alias("first"),
    )
    joined = candidates.select("algo_id", "post_id").distinct().join(stats, "post_id", "left")
    return joined.select("algo_id", "post_id", F.coalesce("likes", F.lit(0)).alias("likes"), F.coalesce("recent", F.lit(0)).alias("recent"), F.coalesce("first", F.lit(now)).alias("post_time"))


def _faded(now: int, half_life: float) -> Column:
    return decay(F.least("post_time", F.lit(now)), now, half_life, DECAY)


def _ranked(scores: DataFrame, limit: int, name: str) -> DataFrame:
    best = top(scores.filter("score > 0"), limit, ["algo_id"], F.desc("score"), F.col("post_id"), name="rank")
    return best.select("algo_id", F.lit(name).alias("tranche"), "post_id", "score", "rank")


def trending(stats: DataFrame, now: int, p: TrancheParams) -> DataFrame:
    return _ranked(stats.filter("likes > 0").withColumn("score", F.col("likes") * _faded(now, p.trending_half_life)), p.trending_limit, "trending")


def popular(stats: DataFrame, now: int, p: TrancheParams) -> DataFrame:
    return _ranked(stats.filter(F.col("likes") >= p.popular_min_likes).withColumn("score", F.col("likes") * _faded(now, p.popular_half_life)), p.popular_limit, "popular")


def velocity(stats: DataFrame, now: int, p: TrancheParams) -> DataFrame:
    hours = F.greatest((F.lit(now) - F.col("post_time")) / HOUR, F.lit(1.0))
    return _ranked(stats.filter(F.col("recent") >= p.velocity_min_likes).withColumn("score", F.col("recent") / hours), p.velocity_limit, "velocity")


def author_success(stats: DataFrame, posts: DataFrame, now: int, p: TrancheParams) -> DataFrame:
    """(algo_id, author_did, score, n_posts): mean likes of an author's posts by recency, raised by their number, twice at most."""
    weight = _faded(now, p.author_half_life)
    known = stats.join(posts.select("post_id", "author_did").filter("author_did IS NOT NULL"), "post_id").withColumn("w", weight)
    summed = known.groupBy("algo_id", "author_did").agg(F.count("*").alias("n_posts"), F.sum(F.col("likes") * F.col("w")).alias("a"), F.sum("w").alias("b"))
    score = F.col("a") / F.col("b") * F.least(1 + F.col("n_posts") / 20, F.lit(2.0))
    return summed.filter((F.col("n_posts") >= p.author_min_posts) & (F.col("b") > 0)).select("algo_id", "author_did", score.alias("score"), "n_posts")


def discovery(stats: DataFrame, posts: DataFrame, success: DataFrame, now: int, p: TrancheParams) -> DataFrame:
    """Posts with few likes by successful authors, the fresh ones first."""
    cold = stats.filter(F.col("likes") <= p.discovery_max_likes).join(posts.select("post_id", "author_did"), "post_id")
    score = F.col("author_score") * (0.5 + 0.5 * _faded(now, p.discovery_half_life))
    found = cold.join(success.select("algo_id", "author_did", F.col("score").alias("author_score")), ["algo_id", "author_did"])
    best = top(found.withColumn("score", score), p.discovery_limit, ["algo_id"], F.desc("score"), F.col("post_id"), name="rank")
    return best.select("algo_id", F.lit("discovery").alias("tranche"), "post_id", "score", "rank")


def all_tranches(candidates: DataFrame, likes: DataFrame, posts: DataFrame, now: int, p: TrancheParams) -> DataFrame:
    """The four lists one below the other, in one plan."""
    made = lists(post_stats(candidates, likes, now, p), posts, now, p)
    return reduce(DataFrame.unionByName, (make() for make in made.values()))


def lists(stats: DataFrame, posts: DataFrame, now: int, p: TrancheParams) -> dict[str, Callable[[], DataFrame]]:
    """How each list is made from the post statistics, by name."""
    return {
        "trending": lambda: trending(stats, now, p),
        "popular": lambda: popular(stats, now, p),
        "velocity": lambda: velocity(stats, now, p),
        "discovery": lambda: discovery(stats, posts, author_success(stats, posts, now, p), now, p),
    }


def sync(stats: DataFrame, posts: DataFrame, now: int, p: TrancheParams, put: Callable[[str, DataFrame], None]) -> dict[str, Exception]:
    """Makes each list and hands it to put(name, list), each in a job of its own: one that fails doesn't keep the others from being put.

    Returns the failures by name. stats should be a stored table, as every list reads it.
    """
    failed: dict[str, Exception] = {}
    for name, make in lists(stats, posts, now, p).items():
        try:
            put(name, make())
        except Exception as error:  # whatever went wrong with a list is reported, and the others go on
            failed[name] = error
    return failed


def algo_likers(candidates: DataFrame, likes: DataFrame, now: int, days: int) -> DataFrame:
    """(algo_id, user_id): users who liked a candidate of the feed in the retained days."""
    kept = likes.filter(F.col("like_date").isin(*retained_days(now, days))) if days else likes
    return kept.select("post_id", "user_id").join(candidates.select("algo_id", "post_id").distinct(), "post_id").select("algo_id", "user_id").distinct()


def feeds_to_sync(access: DataFrame, synced: DataFrame, now: int, active: int = 24 * HOUR, every: int = 300) -> DataFrame:
    """Feeds of access (algo_id, last_access) that were asked for lately and not synced (algo_id, last_sync) within `every` seconds."""
    recent = access.filter(F.col("last_access") >= now - active).select("algo_id").distinct()
    return recent.join(synced.filter(F.col("last_sync") > now - every), "algo_id", "left_anti")
