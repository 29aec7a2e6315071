"""Small tables that administrators keep: feeds, special posts, audited users. Each change gives the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def registered(feeds: DataFrame, new: DataFrame) -> DataFrame:
    """feeds (feed_uri, algo_id, active) with new (feed_uri, algo_id) active; a URI and an algo stand in one active row each.

    Rows that lose their feed stay, inactive, for what was written under their URI; doing it twice changes nothing.
    """
    fresh = new.select("feed_uri", "algo_id").distinct()
    kept = feeds.join(fresh.select("feed_uri"), "feed_uri", "left_anti")
    taken = kept.join(fresh.select("algo_id", F.lit(True).alias("_taken")), "algo_id", "left")
    older = taken.select("feed_uri", "algo_id", (F.col("active") & F.col("_taken").isNull()).alias("active"))
    return older.unionByName(fresh.withColumn("active", F.lit(True)))


def deregistered(feeds: DataFrame, feed_uris: DataFrame) -> DataFrame:
    gone = feed_uris.select("feed_uri", F.lit(True).alias("_gone")).distinct()
    return feeds.join(gone, "feed_uri", "left").select("feed_uri", "algo_id", (F.col("active") & F.col("_gone").isNull()).alias("active"))


def replaced(posts: Column, post: Column) -> Column:
    """An array of special posts with one put in place of those of its attribution, at the end."""
    return F.concat(F.filter(posts, lambda x: x["attribution"] != post["attribution"]), F.array(post))


def dropped(posts: Column, attribution: Column) -> Column:
    return F.filter(posts, lambda x: x["attribution"] != attribution)


def with_members(members: DataFrame, more: DataFrame) -> DataFrame:
    return members.unionByName(more.select(*members.columns)).distinct()


def without_members(members: DataFrame, less: DataFrame) -> DataFrame:
    return members.join(less.select(*members.columns).distinct(), members.columns, "left_anti")
