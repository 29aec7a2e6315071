"""Why a post was ranked: contributions, breakdowns and counts of the walk's steps, of the real ranker's math."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import hash16, paths_boost, popularity_penalty, seeded_unit, top
from ..params import RankParams
from . import blocks, colikers, graph, ranker


def top_contributors(paths: DataFrame, n: int) -> DataFrame:
    """(algo_id, user_id, post_id, source_id, weight, recency, contribution, place): the n paths that add most to a post's score."""
    best = top(paths, n, ["algo_id", "user_id", "post_id"], F.desc("contribution"), F.col("source_id"), name="place")
    return best.select("algo_id", "user_id", "post_id", "source_id", "weight", "recency", "contribution", "place")


def breakdown(scores: DataFrame, contributors: DataFrame, p: RankParams) -> DataFrame:
    """Scores with their factors as a struct, and the contributors as an array in order."""
    each = F.struct("place", "source_id", "weight", "recency", "contribution")
    lists = contributors.groupBy("algo_id", "user_id", "post_id").agg(F.array_sort(F.collect_list(each)).alias("top_contributors"))
    return scores.withColumn("breakdown", factors(p)).join(lists, ["algo_id", "user_id", "post_id"], "left")


def factors(p: RankParams) -> Column:
    """A score's factors as a struct."""
    return F.struct(
        F.col("raw_score").alias("raw"),
        popularity_penalty(F.col("liker_count"), p.popularity_power).alias("popularity_penalty"),
        F.col("liker_count").alias("likers"),
        F.col("paths").alias("paths"),
        paths_boost(F.col("paths"), p.num_paths_power).alias("paths_boost"),
    )


def audited(requests: DataFrame, enabled: bool, everyone: bool, share: float, users: DataFrame | None = None) -> DataFrame:
    """Requests (request_id, user_id) that are audited: all, a seeded sample, or those of chosen users."""
    if not enabled:
        return requests.limit(0)
    if everyone:
        return requests
    sampled = seeded_unit("audit", F.col("request_id")) < share
    if users is None:
        return requests.filter(sampled)
    marked = requests.join(users.select("user_id", F.lit(True).alias("_chosen")).distinct(), "user_id", "left")
    return marked.filter(sampled | F.coalesce("_chosen", F.lit(False))).drop("_chosen")


def preset_label() -> Column:
    """The preset that parameter columns look like; times are seconds."""
    return (
        F.when((F.col("max_user_likes") == 200) & (F.col("specificity_power") > 1.4), "discovery")
        .when((F.col("max_user_likes") == 1000) & (F.col("half_life") > 360_000), "stable")
        .when((F.col("max_sources_per_post") == 50) & (F.col("result_ttl") > 500), "fast")
        .otherwise("default")
    )


def walk_counts(likes: DataFrame, candidates: DataFrame, counts: DataFrame, like_counts: DataFrame, now: int, p: RankParams, users: DataFrame) -> DataFrame:
    """By user: likes ever, in the window and used; edges to and number of co-likers, and those kept; posts scored and paths."""
    window = graph.windowed(likes, now, p.window)
    own = window.join(users, "user_id", "left_semi")
    liked = graph.user_likes(own, p.max_user_likes)
    edges = colikers.earlier_likers(liked, graph.post_likers(window, p.max_sources_per_post))
    weights = colikers.weights(liked, graph.post_likers(window, p.max_sources_per_post), like_counts, now, p)
    excluded, posts = ranker.exclusions(own, None, p), ranker.scoreable(candidates, counts, p)
    paths = ranker.contributions(weights, ranker.candidate_likers(window, posts, p.max_likers_per_post), posts, excluded, now, p)
    scores = ranker.scored(paths, excluded, p)
    ever = likes.select("user_id", "post_id").distinct()
    steps = (
        ever.join(users, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("likes_ever")),
        own.groupBy("user_id").agg(F.count("*").alias("likes_in_window")),
        liked.groupBy("user_id").agg(F.count("*").alias("likes_used")),
        edges.groupBy("user_id").agg(F.count("*").alias("edges"), F.count_distinct("source_id").alias("colikers")),
        weights.groupBy("user_id").agg(F.count("*").alias("sources")),
        scores.groupBy("user_id").agg(F.count("*").alias("scored"), F.sum("paths").alias("paths")),
    )
    out = users.select("user_id").distinct()
    for step in steps:
        out = out.join(step, "user_id", "left")
    return out.fillna(0)


def sample_likes(liked: DataFrame, window: DataFrame, n: int = 20) -> DataFrame:
    """(user_id, post_id, like_ts, place, other_likers): each user's n latest likes used, with how many others had liked the post by then."""
    by_then = Window.partitionBy("post_id").orderBy("like_ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = window.withColumn("other_likers", F.count("*").over(by_then) - 1).select("user_id", "post_id", "other_likers")
    return top(liked, n, ["user_id"], F.desc("like_ts"), F.col("post_id"), name="place").join(counted, ["user_id", "post_id"])


def sample_colikers(weights: DataFrame, edges: DataFrame, liked: DataFrame, n: int = 20, shared: int = 5) -> DataFrame:
    """(user_id, source_id, weight, place, shared, sample): each user's n best co-likers, the number of posts shared, and the latest of them.

    sample: array of (like_ts, post_id, source_ts), the user's latest likes first.
    """
    best = top(weights, n, ["user_id"], F.desc("weight"), F.col("source_id"), name="place")
    posts = edges.join(best.select("user_id", "source_id"), ["user_id", "source_id"], "left_semi").join(liked, ["user_id", "post_id"])
    latest = Window.partitionBy("user_id", "source_id").orderBy(F.desc("like_ts"), "post_id")
    numbered = posts.withColumn("n", F.row_number().over(latest))
    each = F.when(F.col("n") <= shared, F.struct("n", "like_ts", "post_id", "source_ts"))
    lists = numbered.groupBy("user_id", "source_id").agg(F.count("*").alias("shared"), F.array_sort(F.collect_list(each)).alias("sample"))
    short = F.transform("sample", lambda x: F.struct(x["like_ts"].alias("like_ts"), x["post_id"].alias("post_id"), x["source_ts"].alias("source_ts")))
    return best.join(lists, ["user_id", "source_id"]).withColumn("sample", short)


def sample_posts(weights: DataFrame, items: DataFrame, excluded: DataFrame | None, p: RankParams, n: int = 20, contributors: int = 10) -> DataFrame:
    """The n best posts of each feed and user with the score's breakdown and the paths that add most to it; arguments as blocks.walked() takes them."""
    best = blocks.walked(weights, items, excluded, replace(ranker.scoring(p), results=n, contributors=contributors))
    placed = F.transform("contributors", lambda x, i: F.struct((i + 1).alias("place"), x["source_id"].alias("source_id"), x["weight"].alias("weight"), x["recency"].alias("recency"), x["contribution"].alias("contribution")))
    return best.withColumn("breakdown", factors(p)).withColumn("top_contributors", placed).drop("contributors")


#: What the sources of a page's posts count as.
KINDS = {"post": "personal", "author": "personal", "popular": "fallback", "velocity": "fallback", "discovery": "fallback", "trending": "fallback", "pinned": "special", "rotating": "special", "sponsored": "special"}


def audit_records(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """One record for each audited request (request_id, algo_id, user_id): its page's posts in order, and how many were personal, fallback and special.

    pages: (algo_id, user_id, pos, uri, source). A request without a page has an empty list.
    """
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("source"))
    lists = pages.withColumn("kind", kind).groupBy("algo_id", "user_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "uri", "source"))).alias("posts"),
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in dict.fromkeys(KINDS.values())),
    )
    found = requests.join(lists, ["algo_id", "user_id"], "left").withColumn("user", F.substring(hash16(F.col("user_id").cast("string")), 1, 12))
    none = F.array().cast("array<struct<pos:int,uri:string,source:string>>")
    posts = F.coalesce(F.col("posts").cast("array<struct<pos:int,uri:string,source:string>>"), none)
    return found.select("request_id", "algo_id", "user", posts.alias("posts"), *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in dict.fromkeys(KINDS.values())))


def feed_status(candidates: DataFrame, meta: DataFrame, tranches: DataFrame, now: int, ttl: int) -> DataFrame:
    """By feed of meta (algo_id, last_sync) or candidates: posts, tranche sizes, age of the sync, health and a diagnosis."""
    posts = candidates.groupBy("algo_id").agg(F.count("*").alias("posts"))
    sizes = tranches.groupBy("algo_id").pivot("tranche", ["trending", "popular", "velocity", "discovery"]).count()
    both = meta.select("algo_id", "last_sync").join(posts, "algo_id", "full_outer").join(sizes, "algo_id", "left")
    age = F.lit(now) - F.col("last_sync")
    left = F.lit(ttl) - age
    diagnosis = (
        F.when(F.col("posts").isNull() & F.col("last_sync").isNull(), "never synced")
        .when(F.col("posts").isNull(), F.concat(F.lit("no posts; last sync "), age.cast("string"), F.lit(" s ago")))
        .when(left.between(1, 299), F.concat(F.lit("posts expire in "), left.cast("string"), F.lit(" s")))
        .otherwise("healthy")
    )
    return both.select(
        "algo_id", F.coalesce("posts", F.lit(0)).alias("posts"), *(F.coalesce(F.col(t), F.lit(0)).alias(t) for t in ("trending", "popular", "velocity", "discovery")),
        age.alias("sync_age"), (F.coalesce("posts", F.lit(0)) > 0).alias("healthy"), diagnosis.alias("diagnosis"),
    )
