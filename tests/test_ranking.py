"""The ranker's steps on toy graphs, and against a plain loop over random ones."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from likeloom.operators import colikers, diversity, graph, ranker
from likeloom.params import DAY, AuthorParams, DiversityParams, RankParams, merged, preset, preset_name

NOW = 1_000_000_000


def edges(spark, rows):
    return graph.keyed_by_day(spark.createDataFrame(rows, "user_id string, post_id string, like_ts bigint")).select("user_id", "post_id", "like_ts", "like_date")


def weights_of(spark, rows, window=4 * DAY, user="alice", **changes):
    p = RankParams(window=window, half_life=DAY, cap=None, **changes)
    likes = edges(spark, rows)
    seen = graph.windowed(likes, NOW, p.window)
    own = graph.user_likes(seen.filter(F.col("user_id") == user), p.max_user_likes)
    found = colikers.weights(own, graph.post_likers(seen, p.max_sources_per_post), graph.like_counts(likes), NOW, p)
    return {r["source_id"]: r["weight"] for r in found.collect()}


def test_colikers_liked_earlier_and_recent_ones_count_more(spark):
    rows = [("bob", "p1", NOW - 2 * DAY), ("alice", "p1", NOW - DAY), ("carol", "p2", NOW - 5 * DAY // 2), ("alice", "p2", NOW - DAY)]
    found = weights_of(spark, rows)
    assert set(found) == {"bob", "carol"} and found["bob"] > found["carol"]


@pytest.mark.parametrize("rows", [[("alice", "p", NOW - DAY)], [], [("alice", "p", NOW - 2 * DAY), ("late", "p", NOW - DAY)], [("alice", "p", NOW - DAY), ("tie", "p", NOW - DAY)]])
def test_no_colikers(spark, rows):
    assert weights_of(spark, rows) == {}


def test_window_is_inclusive_and_ends_now(spark):
    rows = [("recent", "p", NOW - DAY), ("old", "p", NOW - 10 * DAY), ("edge", "p", NOW - 2 * DAY), ("alice", "p", NOW - 3600), ("future", "p", NOW + 5)]
    assert set(weights_of(spark, rows, window=2 * DAY)) == {"recent", "edge"}


def test_truncation_comes_before_the_time_filter(spark):
    rows = [("early", "p", NOW - 3 * DAY), ("alice", "p", NOW - 2 * DAY), ("x", "p", NOW - DAY), ("y", "p", NOW - DAY + 1)]
    assert weights_of(spark, rows, max_sources_per_post=2) == {}
    assert set(weights_of(spark, rows, max_sources_per_post=4)) == {"early"}


def test_same_pair_on_two_days_counts_twice_but_likes_once(spark):
    likes = edges(spark, [("bob", "p", NOW - 2 * DAY), ("bob", "p", NOW - 2 * DAY + 5), ("bob", "p", NOW - DAY)])
    assert likes.count() == 2
    assert [r["like_ts"] for r in graph.windowed(likes, NOW, 8 * DAY).collect()] == [NOW - DAY]


def test_author_colikers(spark):
    liked = spark.createDataFrame([("alice", "a", 4), ("alice", "b", 9), ("alice", "c", 1)], "user_id string, author_did string, like_count bigint")
    likers = spark.createDataFrame([("a", "bob", NOW - 5), ("b", "bob", NOW - 5), ("b", "carol", NOW - 5), ("c", "dan", NOW - 5), ("a", "alice", NOW)], "author_did string, user_id string, like_ts bigint")
    found = colikers.author_weights(liked, likers, NOW, AuthorParams())
    assert {r["source_id"]: r["weight"] for r in found.collect()} == {"bob": 5.0, "carol": 3.0}


def test_plain_scorer(spark):
    likers = spark.createDataFrame([("post1", "user_a", 1000), ("post1", "user_b", 900), ("post2", "user_c", 950)], "post_id string, user_id string, like_ts bigint")
    weights = spark.createDataFrame([("user_a", 1.0), ("user_b", 0.5)], "source_id string, weight double")
    (row,) = ranker.score_sources(likers, weights, 1000, 72 * 3600.0, 0).collect()
    assert (row["post_id"], row["matches"]) == ("post1", 2) and row["score"] > 0
    many = spark.createDataFrame([(f"post_{i:02}", "user_a", 900 + i) for i in range(100)], likers.schema)
    top = ranker.score_sources(many, weights, 1000, 100.0, 10).collect()
    assert len(top) == 10 and top[0]["post_id"] == "post_99"


def loop(likes, candidates, counts, lifetime, seen, p, user):
    """The whole walk as plain loops."""
    inside = {}
    for u, post, ts in likes:
        if NOW - p.window <= ts <= NOW:
            inside[u, post] = max(ts, inside.get((u, post), 0))
    liked = sorted(((ts, post) for (u, post), ts in inside.items() if u == user), key=lambda x: (-x[0], x[1]))[: p.max_user_likes]
    by_post = {}
    for (u, post), ts in inside.items():
        by_post.setdefault(post, []).append((ts, u))
    for x in by_post.values():
        x.sort(key=lambda y: (-y[0], y[1]))
    mass = {}
    for ts, post in liked:
        left = [(t, u) for t, u in by_post[post][: p.max_sources_per_post] if t < ts and u != user]
        for t, u in left:
            mass[u] = mass.get(u, 0) + math.exp(-math.log(2) * (NOW - t) / p.half_life) / len(left) / len(liked)
    weight = {u: m / max(1, lifetime.get(u, 1)) for u, m in mass.items()}
    best = dict(sorted(weight.items(), key=lambda x: (-x[1], x[0]))[: p.max_total_sources])
    out = {}
    shown = {post for (u, post) in inside if u == user} | seen
    for algo, post in candidates:
        if post in shown or counts.get(post, 0) < p.min_post_likes:
            continue
        paths = [(best[u], t) for t, u in by_post.get(post, [])[: p.max_likers_per_post] if u in best]
        if paths:
            raw = sum(w * math.exp(-0.693 * (NOW - t) / p.half_life) for w, t in paths)
            out[algo, post] = raw * len(paths) ** p.num_paths_power * (1 / counts[post]) ** (p.popularity_power / 2)
    return out


def test_batch_equals_loops(spark):
    rng = random.Random(4)
    raw = [(rng.randrange(14), rng.randrange(30), NOW - rng.randrange(12 * DAY)) for _ in range(260)]
    likes = spark.createDataFrame(raw, "user_id bigint, post_id bigint, like_ts bigint")
    likes = graph.keyed_by_day(likes)
    rows = [(r["user_id"], r["post_id"], r["like_ts"]) for r in likes.collect()]
    counts, lifetime = {}, {}
    for u, post, _ in rows:
        counts[post] = counts.get(post, 0) + 1
        lifetime[u] = lifetime.get(u, 0) + 1
    candidates = [(post % 2, post) for post in range(30)]
    seen = [(u, rng.randrange(30), NOW - 5) for u in range(14) for _ in range(2)]
    p = RankParams(window=8 * DAY, half_life=2.0 * DAY, cap=None, max_user_likes=6, max_sources_per_post=4, max_total_sources=8, max_likers_per_post=5, min_post_likes=4)
    found = ranker.rank_posts(
        likes,
        spark.createDataFrame(candidates, "algo_id int, post_id bigint"),
        spark.createDataFrame(list(counts.items()), "post_id bigint, liker_count bigint"),
        spark.createDataFrame(list(lifetime.items()), "user_id bigint, like_count bigint"),
        NOW, p, spark.createDataFrame(seen, "user_id bigint, post_id bigint, seen_ts bigint"),
    )
    got = {}
    for r in found.collect():
        got.setdefault(r["user_id"], {})[r["algo_id"], r["post_id"]] = r["score"]
    for user in range(14):
        want = loop(rows, candidates, counts, lifetime, {post for u, post, _ in seen if u == user}, p, user)
        assert got.get(user, {}).keys() == want.keys()
        assert all(math.isclose(got[user][k], v, rel_tol=1e-9) for k, v in want.items())


# ---- diversity, paging, parameters -----------------------------------------------------------------


def ranked(spark, rows):
    return spark.createDataFrame([("u", *r) for r in rows], "user_id string, post_id int, author_did string, score double")


def test_diversity_demotes(spark):
    found = diversity.diversify(ranked(spark, [(1, "a", 1.0), (2, "a", 0.9), (3, "a", 0.8)]), 10, DiversityParams(strength=0.0), ("user_id",))
    assert [round(r["adjusted"], 6) for r in found.orderBy("place").collect()] == [1.0, 0.45, 0.2]


def test_diversity_cap_and_unknown_authors(spark):
    rows = ranked(spark, [(1, "a", 1.0), (2, "a", 0.9), (3, "a", 0.8), (4, "a", 0.7), (5, None, 0.6)])
    assert diversity.diversify(rows, 10, DiversityParams(per_author=2), ("user_id",)).count() == 2
    (stats,) = diversity.diversity_stats(rows, 10, DiversityParams(per_author=2), ("user_id",)).collect()
    assert (stats["unique_authors"], stats["demoted"], stats["removed_by_cap"]) == (1, 1, 2)


def test_diversity_equals_greedy_loop(spark):
    rng = random.Random(9)
    rows = [(i, f"a{rng.randrange(6)}", round(rng.random(), 3)) for i in range(80)]
    p, limit = DiversityParams(per_author=3, factor=0.6, strength=0.2), 12
    taken, want, removed = {}, [], 0
    for post, author, score in sorted(rows, key=lambda r: (-r[2], r[0])):
        if len(want) >= limit:
            break
        r = taken.get(author, 0)
        if r >= p.per_author:
            removed += 1
            continue
        power = p.factor**r
        want.append((post, score * power * (1 - p.strength * (1 - power) if r else 1)))
        taken[author] = r + 1
    found = diversity.diversify(ranked(spark, rows), limit, p, ("user_id",)).orderBy("place").collect()
    want.sort(key=lambda x: (-x[1], x[0]))
    assert [r["post_id"] for r in found] == [x[0] for x in want]
    assert all(math.isclose(r["adjusted"], x[1]) for r, x in zip(found, want, strict=True))
    assert diversity.diversity_stats(ranked(spark, rows), limit, p, ("user_id",)).first()["removed_by_cap"] == removed


def test_diversity_off_passes_all(spark):
    rows = ranked(spark, [(1, "a", 1.0), (2, "a", 0.9)])
    assert [r["adjusted"] for r in diversity.diversify(rows, 1, DiversityParams(enabled=False), ("user_id",)).orderBy("place").collect()] == [1.0, 0.9]


def test_keyset_pages_cover_everything_once(spark):
    rows = ranked(spark, [(i, "a", (i % 4) / 4) for i in range(11)])
    got, last = [], (9.0, -1)
    while page := ranker.page_after(rows, *last, 3, ("user_id",)).orderBy(F.desc("score"), "post_id").collect():
        got += [r["post_id"] for r in page]
        last = page[-1]["score"], page[-1]["post_id"]
    assert sorted(got) == list(range(11)) and len(got) == 11


def test_presets():
    assert preset("DISCOVERY").specificity_power == 1.5 and preset("nonsense") == RankParams() == preset(None)
    assert [preset_name(preset(n)) for n in ("default", "discovery", "stable", "fast")] == ["default", "discovery", "stable", "fast"]
    p = merged(preset("stable"), {"window": 5, "half_life": None, "max_user_likes": 7})
    assert (p.window, p.max_user_likes, p.half_life, p.use_author_affinity) == (604_800, 7, 604_800.0, False)
