"""Co-likers: users who liked the same posts earlier, with weights, for all given users at once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import decay, top
from ..params import AuthorParams, RankParams

LN2 = math.log(2)


def earlier_likers(liked: DataFrame, likers: DataFrame) -> DataFrame:
    """(user_id, source_id, post_id, source_ts, n_sources): likers of a user's posts that liked them before the user did, and how many.

    likers are already cut to the latest of each post: a post whose latest likers all came later has
    none. A post's likers are one array, as bounded as that cut, so the join has one row for each like
    and can be split where a post is liked by very many; the number of sources needs no window.
    """
    source = F.struct(F.col("user_id").alias("source_id"), F.col("like_ts").alias("source_ts"))
    lists = likers.groupBy("post_id").agg(F.collect_list(source).alias("likers"))
    earlier = F.filter("likers", lambda x: (x["source_ts"] < F.col("like_ts")) & (x["source_id"] != F.col("user_id")))
    kept = liked.join(lists, "post_id").select("user_id", "post_id", earlier.alias("sources"))
    each = kept.select("user_id", "post_id", F.size("sources").alias("n_sources"), F.explode("sources").alias("x"))
    return each.select("user_id", "x.source_id", "post_id", "x.source_ts", "n_sources")


def plain_weights(edges: DataFrame, now: int, half_life: float, limit: int) -> DataFrame:
    """(user_id, source_id, weight): the sum of the recency of the likes shared."""
    weights = edges.groupBy("user_id", "source_id").agg(F.sum(decay(F.col("source_ts"), now, half_life, LN2)).alias("weight"))
    return top(weights, limit, ["user_id"], F.desc("weight"), F.col("source_id"))


def walk_weights(edges: DataFrame, liked: DataFrame, counts: DataFrame, now: int, half_life: float, limit: int, cap: float | None) -> DataFrame:
    """(user_id, source_id, weight): the chance of a walk user -> post -> source, times recency, by the source's lifetime likes.

    The steps are uniform over the user's likes used and over the post's earlier likers that are left.
    """
    n_liked = liked.groupBy("user_id").agg(F.count("*").alias("n_liked"))
    walked = edges.groupBy("user_id", "source_id").agg(F.sum(decay(F.col("source_ts"), now, half_life, LN2) / F.col("n_sources")).alias("mass"))
    known = walked.join(n_liked, "user_id").join(counts.select(F.col("user_id").alias("source_id"), "like_count"), "source_id", "left")
    weight = F.col("mass") / F.col("n_liked") / F.greatest(F.coalesce("like_count", F.lit(1)), F.lit(1))
    weight = F.least(weight, F.lit(cap)) if cap else weight
    return top(known.select("user_id", "source_id", weight.alias("weight")), limit, ["user_id"], F.desc("weight"), F.col("source_id"))


def weights(liked: DataFrame, likers: DataFrame, counts: DataFrame, now: int, p: RankParams) -> DataFrame:
    """plain_weights() or walk_weights() of the likes' earlier likers.

    A like's sources go to the user's partition as two arrays, one row a like, with all that the weight
    takes; there they are summed and cut, so that no edge is dealt out again.
    """
    share = decay(F.col("like_ts"), now, p.half_life, LN2)
    if p.normalized:
        known = likers.select("post_id", "user_id", "like_ts").join(counts.select("user_id", "like_count"), "user_id", "left")
        likers = known.withColumn("share", share / F.greatest(F.coalesce("like_count", F.lit(1)), F.lit(1)))
        liked = liked.withColumn("n_liked", F.count("*").over(Window.partitionBy("user_id")))
    else:
        likers, liked = likers.withColumn("share", share), liked.withColumn("n_liked", F.lit(1))
    source = F.struct(F.col("user_id").alias("source_id"), F.col("like_ts").alias("source_ts"), "share")
    lists = likers.groupBy("post_id").agg(F.collect_list(source).alias("likers"))
    earlier = F.filter("likers", lambda x: (x["source_ts"] < F.col("like_ts")) & (x["source_id"] != F.col("user_id")))
    kept = liked.join(lists, "post_id").select("user_id", "n_liked", earlier.alias("x")).filter(F.size("x") > 0)
    kept = kept.select("user_id", "n_liked", F.col("x.source_id").alias("source_id"), F.col("x.share").alias("share")).repartition("user_id")
    part = F.col("x.share") / F.size("source_id") / F.col("n_liked") if p.normalized else F.col("x.share")
    edges = kept.withColumn("x", F.explode(F.arrays_zip("source_id", "share"))).select("user_id", F.col("x.source_id").alias("source_id"), part.alias("part"))
    summed = edges.groupBy("user_id", "source_id").agg(F.sum("part").alias("weight"))
    if p.normalized and p.cap:
        summed = summed.withColumn("weight", F.least("weight", F.lit(p.cap)))
    return top(summed, p.max_total_sources, ["user_id"], F.desc("weight"), F.col("source_id"))


def author_sources(author_likers: DataFrame, now: int, p: AuthorParams) -> DataFrame:
    """(author_did, source_id): each author's latest likers."""
    recent = author_likers.filter(F.col("like_ts").between(now - p.window, now)).groupBy("author_did", "user_id").agg(F.max("like_ts").alias("like_ts"))
    return top(recent, p.max_likers, ["author_did"], F.desc("like_ts"), F.col("user_id")).select("author_did", F.col("user_id").alias("source_id"))


def author_weights(liked_authors: DataFrame, author_likers: DataFrame, now: int, p: AuthorParams) -> DataFrame:
    """(user_id, source_id, weight) over a user's best liked authors: the sum of the square roots of the user's likes of them."""
    return shared_authors(liked_authors, author_sources(author_likers, now, p), p)


def shared_authors(liked_authors: DataFrame, sources: DataFrame, p: AuthorParams) -> DataFrame:
    """author_weights() from author_sources()."""
    own = top(liked_authors, p.max_authors, ["user_id"], F.desc("like_count"), F.col("author_did")).filter(F.col("like_count") >= p.min_likes)
    shared = own.join(sources, "author_did").filter(F.col("source_id") != F.col("user_id"))
    summed = shared.groupBy("user_id", "source_id").agg(F.sum(F.sqrt("like_count")).alias("weight"))
    return top(summed, p.max_sources, ["user_id"], F.desc("weight"), F.col("source_id"))


def stale(cached: DataFrame, window: DataFrame, now: int, ttl: int) -> DataFrame:
    """Users of cached (user_id, as_of) whose weights must be made anew: too old, or the user liked something since."""
    latest = window.groupBy("user_id").agg(F.max("like_ts").alias("latest"))
    old = (F.col("as_of") + ttl <= now) | (F.col("latest") > F.col("as_of"))
    return cached.join(latest, "user_id", "left").filter(F.coalesce(old, F.lit(False))).select("user_id")
