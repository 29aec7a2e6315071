"""What holds only at some size, or in a plan: dense ids, hot posts, lists that fail alone."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from likeloom.operators import colikers, graph, ranker, tranches
from likeloom.params import RankParams, TrancheParams

NOW = 1_706_140_800


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_interned_ids_are_dense_and_ordered(spark, partitions):
    n = 400_000
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        uris = spark.range(0, n, 1, partitions).select(F.concat(F.lit("at://"), F.sha2(F.col("id").cast("string"), 256)).alias("uri"))
        known = spark.createDataFrame([(7, "at://known")], "post_id bigint, uri string")
        found = graph.interned(known, uris.unionByName(known.select("uri")).unionByName(uris.limit(1000)))
        whole = found.agg(F.count("*").alias("n"), F.count_distinct("post_id").alias("ids"), F.count_distinct("uri").alias("uris"), F.min("post_id").alias("first"), F.max("post_id").alias("last")).first()
        assert tuple(whole) == (n + 1, n + 1, n + 1, 7, n + 7)
        spread = found.filter("post_id > 7").sample(0.01, 3).orderBy("post_id").collect()
        assert [r["uri"] for r in spread] == sorted(r["uri"] for r in spread)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def viral(spark, users=400):
    """One post that all users like, one after the other, and a few others."""
    rows = [(u, 0, NOW - 10_000 + u, "20240125") for u in range(users)] + [(u, 1 + u % 5, NOW - 20_000 + u, "20240125") for u in range(users)]
    return spark.createDataFrame(rows, "user_id bigint, post_id bigint, like_ts bigint, like_date string")


def test_a_viral_post_is_cut_before_its_likers_meet(spark):
    window = graph.windowed(viral(spark), NOW, 86_400)
    p = RankParams(window=86_400, half_life=3600.0, max_sources_per_post=10, max_total_sources=50)
    edges = colikers.earlier_likers(graph.user_likes(window, 500), graph.post_likers(window, 10))
    latest = {u for u in range(390, 400)}
    own = edges.filter("post_id = 0").collect()
    assert {(r["user_id"], r["source_id"]) for r in own} == {(u, s) for u in latest for s in latest if s < u}
    assert all(r["n_sources"] == r["user_id"] - 390 for r in own)
    oldest = ranker.first_sources(window.filter("post_id = 0"), window, NOW, p, None).collect()
    assert {(r["user_id"], r["source_id"]) for r in oldest} == {(u, s) for u in range(400) for s in range(10) if s < u}


def test_a_failing_list_leaves_the_others(spark):
    stats = spark.createDataFrame([(0, i, 10 + i, 5, NOW - 3600 * i) for i in range(20)], "algo_id int, post_id bigint, likes bigint, recent bigint, post_time bigint")
    posts = spark.createDataFrame([(i, f"did:{i % 2}") for i in range(20)], "post_id bigint, author_did string")
    put = {}

    def store(name, rows):
        if name == "popular":
            raise OSError("no room")
        put[name] = rows.count()

    failed = tranches.sync(stats, posts, NOW, TrancheParams(), store)
    assert list(failed) == ["popular"] and set(put) == {"trending", "velocity", "discovery"} and put["trending"] > 0
