"""Views of the like graph: edges (user_id, post_id, like_ts, like_date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import author_of, day_of, day_tranche, retained_days, seeded, top
from ..storage import staged


def keyed_by_day(likes: DataFrame) -> DataFrame:
    """One edge for each user, post and UTC day of its time: the last one written wins, here the latest."""
    return likes.groupBy("user_id", "post_id", day_of(F.col("like_ts")).alias("like_date")).agg(F.max("like_ts").alias("like_ts"))


def retained(likes: DataFrame, now: int, days: int) -> DataFrame:
    """The edges of the last days, today included: a literal list, so that day partitions are pruned."""
    return likes.filter(F.col("like_date").isin(*retained_days(now, days)))


def capped(likes: DataFrame, by: str, n: int) -> DataFrame:
    """The n latest edges of each user (or post) and day."""
    other = "post_id" if by == "user_id" else "user_id"
    return top(likes, n, [by, "like_date"], F.desc("like_ts"), F.col(other))


def windowed(likes: DataFrame, now: int, window: int) -> DataFrame:
    """(user_id, post_id, like_ts): the latest like of each pair in [now - window, now], days merged."""
    inside = likes.filter(F.col("like_ts").between(now - window, now))
    return inside.groupBy("user_id", "post_id").agg(F.max("like_ts").alias("like_ts"))


def user_likes(window: DataFrame, n: int) -> DataFrame:
    """Each user's n latest likes."""
    return top(window, n, ["user_id"], F.desc("like_ts"), F.col("post_id"))


def sampled_likes(window: DataFrame, pool: int, n: int, seed: str) -> DataFrame:
    """n of each user's `pool` latest likes, drawn by a seeded hash; the n latest if the pool is no larger."""
    if pool <= n:
        return user_likes(window, n)
    return top(user_likes(window, pool), n, ["user_id"], seeded(seed, F.col("user_id"), F.col("post_id")))


def post_likers(window: DataFrame, n: int, oldest: bool = False) -> DataFrame:
    """Each post's n latest (or oldest) likers."""
    return top(window, n, ["post_id"], F.col("like_ts") if oldest else F.desc("like_ts"), F.col("user_id"))


def like_counts(likes: DataFrame) -> DataFrame:
    """(user_id, like_count) over all of a user's edges."""
    return likes.groupBy("user_id").agg(F.count("*").alias("like_count"))


def like_counts_by_batch(likes: DataFrame, batch: Column) -> DataFrame:
    """The counter as incremented once for each user and day in a batch, not for each like."""
    return likes.groupBy("user_id").agg(F.count_distinct(batch, F.col("like_date")).alias("like_count"))


def liked_authors(likes: DataFrame, posts: DataFrame, n: int, known: DataFrame | None = None) -> DataFrame:
    """(user_id, author_did, like_count): each user's n most liked authors; users in `known` are left out."""
    edges = likes.join(posts.select("post_id", "author_did").filter("author_did IS NOT NULL"), "post_id")
    edges = edges if known is None else edges.join(known.select("user_id").distinct(), "user_id", "left_anti")
    counts = edges.groupBy("user_id", "author_did").agg(F.count("*").alias("like_count"))
    return top(counts, n, ["user_id"], F.desc("like_count"), F.col("author_did"))


def author_likers(likes: DataFrame, posts: DataFrame) -> DataFrame:
    """(author_did, user_id, like_date, like_ts): edges projected to authors."""
    edges = likes.join(posts.select("post_id", "author_did").filter("author_did IS NOT NULL"), "post_id")
    return edges.groupBy("author_did", "user_id", "like_date").agg(F.max("like_ts").alias("like_ts"))


def bots(likes: DataFrame, threshold: int) -> DataFrame:
    """(user_id, like_count, reason, detected_at) of users with threshold likes or more; detected with their threshold-th."""
    counted = likes.groupBy("user_id").agg(F.count("*").alias("like_count"), F.max("like_ts").alias("detected_at"))
    return counted.filter(F.col("like_count") >= threshold).select("user_id", "like_count", F.lit("threshold_exceeded").alias("reason"), "detected_at")


def without(df: DataFrame, blocked: DataFrame, key: str = "user_id") -> DataFrame:
    return df.join(blocked.select(key).distinct(), key, "left_anti")


def latest_bots(found: DataFrame, n: int) -> DataFrame:
    """The n bots detected last."""
    return found.orderBy(F.desc("detected_at"), "user_id").limit(n)


def tranches_by_age(likes: DataFrame, now: int, days: int) -> DataFrame:
    """Edges with the day tranche d0 (today's) to d7 that the older layout keeps them in."""
    return likes.withColumn("tranche", F.concat(F.lit("d"), day_tranche(F.col("like_ts"), now, days).cast("string")))


def reconciled(old: DataFrame, new: DataFrame, key: str, tolerance: float = 0.1) -> DataFrame:
    """Counts of two layouts side by side by key, with whether they are equal or within the tolerance."""
    a, b = (x.groupBy(key).agg(F.count("*").alias(n)) for x, n in ((old, "old_count"), (new, "new_count")))
    both = a.join(b, key, "full_outer").select(key, *(F.coalesce(n, F.lit(0)).alias(n) for n in ("old_count", "new_count")))
    off = F.abs(F.col("old_count") - F.col("new_count")) / F.greatest("old_count", F.lit(1))
    return both.withColumn("exact", F.col("old_count") == F.col("new_count")).withColumn("close", off <= tolerance)


# ---- dictionary of URIs --------------------------------------------------------------------------


def interned(known: DataFrame, uris: DataFrame) -> DataFrame:
    """known (post_id, uri) with new ids for the uris not in it, dense and in their order after the highest. One writer at a time.

    The new uris are sorted over all partitions and written once, each with its place in its partition:
    the bounds of a range deal come from a sample and differ between two evaluations, so counts and
    numbers are both taken from the copy. Only the partitions' counts meet, one row each.
    """
    fresh = uris.select("uri").filter("uri IS NOT NULL").distinct().join(known.select("uri"), "uri", "left_anti")
    placed = staged(fresh.repartitionByRange("uri").sortWithinPartitions("uri").withColumn("_row", F.monotonically_increasing_id()), "uris")
    placed = placed.select("uri", F.shiftright("_row", 33).alias("_part"), F.col("_row").bitwiseAND((1 << 33) - 1).alias("_at"))
    last = known.agg(F.coalesce(F.max("post_id"), F.lit(0))).first()[0]
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", (before + F.lit(last + 1)).alias("_start"))  # one row a partition
    numbered = placed.join(F.broadcast(starts), "_part").select((F.col("_start") + F.col("_at")).cast("long").alias("post_id"), "uri")
    return known.select("post_id", "uri").unionByName(numbered)


def uris_of(ids: DataFrame, dictionary: DataFrame) -> DataFrame:
    """ids with their uri; unknown ids are left out."""
    return ids.join(dictionary.select("post_id", "uri"), "post_id")


def ids_of(uris: DataFrame, dictionary: DataFrame) -> DataFrame:
    """uris with their post_id; unknown uris are left out."""
    return uris.join(dictionary.select("post_id", "uri"), "uri")


def with_author(posts: DataFrame) -> DataFrame:
    return posts.withColumn("author_did", author_of(F.col("uri")))
