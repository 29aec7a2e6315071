"""The walk by blocks of users against the walk by joins, and that its paths are never dealt out."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from likeloom.operators import blocks, ranker
from likeloom.params import RankParams
from likeloom.plans.catalogue import QUERIES

NOW = 1_706_140_800


@pytest.mark.parametrize("name", ["op_corater_decay", "op_rank_all_users", "op_rank_inverted_lua", "op_rank_by_authors", "op_rank_source_first", "op_score_breakdown"])
def test_no_path_is_dealt_out(spark, sf_dir, name):
    """What stands above the blocks' scorer is narrow: no exchange comes after the paths are made."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("MapInArrow")
    assert below and "Exchange" not in above


def walk(spark, seed):
    rng = random.Random(seed)
    pairs = {(u, s): rng.random() for u in range(-20, 40) for s in rng.sample(range(30), 6)}
    likes = {(s, post): NOW - rng.randrange(90_000) for s in range(30) for post in rng.sample(range(25), 5)}
    posts = {(post % 3 if post % 3 < 2 else None, post) for post in range(25)} | {(1, post) for post in range(0, 25, 6)}
    weights = spark.createDataFrame([(u, s, w) for (u, s), w in pairs.items()], "user_id bigint, source_id bigint, weight double")
    likers = spark.createDataFrame([(post, s, t) for (s, post), t in likes.items()], "post_id bigint, user_id bigint, like_ts bigint")
    scoreable = spark.createDataFrame([(a, post, 1 + post % 4) for a, post in posts], "algo_id int, post_id bigint, liker_count bigint")
    gone = spark.createDataFrame([(u, rng.randrange(40)) for u in range(-20, 40, 2) for _ in range(4)], "user_id bigint, post_id bigint").distinct()
    return weights, likers, scoreable, gone


def rows(df):
    return sorted((tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("more", [{}, {"corater_decay": 0.3}, {"min_overlap": 2, "cap": 0.4, "max_results": 3}, {"max_results": 0, "num_paths_power": 0.0, "popularity_power": 0.0}])
def test_blocks_equal_joins(spark, monkeypatch, more):
    """Negative ids, a null feed, posts in two feeds, users with nothing excluded, excluded posts that nobody leads to; several blocks."""
    monkeypatch.setattr(blocks, "FEW_EDGES", 50)
    p = RankParams(**{"half_life": 30_000.0, "cap": None, **more})
    weights, likers, posts, gone = walk(spark, 3)
    paths = ranker.contributions(weights, likers, posts, gone, NOW, p)
    columns = ["algo_id", "user_id", "post_id", "raw_score", "paths", "liker_count", "score", "rank"]
    want = ranker.cut(ranker.scored(paths, gone, p), p.max_results).select(*columns)
    items = likers.select("post_id", F.col("user_id").alias("source_id"), "like_ts", ranker.decay(F.col("like_ts"), NOW, p.half_life, ranker.DECAY).alias("factor")).join(posts, "post_id")
    found = blocks.walked(weights, items, gone, ranker.scoring(p))
    assert dict(found.dtypes)["algo_id"] == "int"
    assert rows(found.select(*columns)) == rows(want) and want.count() > 100


def test_nothing_to_walk(spark):
    weights, likers, posts, gone = walk(spark, 3)
    items = likers.join(posts, "post_id").select("post_id", F.col("user_id").alias("source_id"), "like_ts", F.lit(1.0).alias("factor"), "algo_id", "liker_count")
    s = blocks.Scoring(boost=0.3, popularity=1.0)
    assert blocks.walked(weights.limit(0), items, gone, s).count() == 0
    assert blocks.walked(weights, items.limit(0), gone, s).count() == 0
    everything = weights.select("user_id").distinct().crossJoin(posts.select("post_id").distinct())
    assert blocks.walked(weights, items, everything, s).count() == 0
