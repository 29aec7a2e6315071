"""Interactions that clients send back, and the provenance that they echo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import from_url_base64, url_base64
from ..schema import PROVENANCE, SEEN_EVENT


def encode_provenance(provenance: Column) -> Column:
    """A struct as base64url JSON, null fields left out."""
    return url_base64(F.to_json(provenance))


def decode_provenance(text: Column) -> Column:
    """The struct of encode_provenance(); null if the text is none."""
    body = from_url_base64(text)
    return F.when(body.rlike(r"^\s*\{"), F.from_json(body, PROVENANCE))


def flattened(sent: DataFrame) -> DataFrame:
    """One row for each interaction of sent (did, sent_at, interactions array<struct<item, uri, event, feedContext, reqId>>); uri stands in for item."""
    each = sent.select("did", "sent_at", F.explode("interactions").alias("x"))
    return each.select("did", "sent_at", F.coalesce("x.item", "x.uri").alias("item"), F.col("x.event").alias("event"), F.col("x.feedContext").alias("feed_context"), F.col("x.reqId").alias("request_id"))


def resolved(rows: DataFrame, active: DataFrame, durable: DataFrame) -> DataFrame:
    """rows (feed_uri) with algo_id: of the active feeds (feed_uri, algo_id), else of all that ever wrote."""
    now = active.select("feed_uri", F.col("algo_id").alias("_now"))
    ever = durable.select("feed_uri", F.col("algo_id").alias("_ever"))
    return rows.join(now, "feed_uri", "left").join(ever, "feed_uri", "left").withColumn("algo_id", F.coalesce("_now", "_ever")).drop("_now", "_ever")


def interaction_rows(interactions: DataFrame) -> DataFrame:
    """The analytics rows of flattened interactions; what is missing is empty."""
    seen = interactions.withColumn("p", decode_provenance(F.col("feed_context")))

    def text(c: str) -> Column:
        return F.coalesce(c, F.lit(""))

    return seen.select(
        "did", text("feed_context").alias("interaction_feed_context"), text("p.feed_uri").alias("feed_uri"), text("p.attribution").alias("attribution"),
        F.col("item").alias("interaction_item"), F.col("event").alias("interaction_event"), text("request_id").alias("interaction_request_id"), F.col("sent_at").alias("occurred"),
    )


def action_rows(rows: DataFrame, active: DataFrame, durable: DataFrame) -> DataFrame:
    """The action log of interaction_rows(): those whose feed is known."""
    known = resolved(rows.filter("feed_uri <> ''"), active, durable).filter("algo_id IS NOT NULL")
    return known.select("algo_id", F.col("did").alias("user_did"), F.col("interaction_event").alias("action_type"), F.col("interaction_item").alias("action_identifier"), F.col("occurred").alias("action_time"), F.lit(1).alias("action_count"))


def seen_posts(interactions: DataFrame, dictionary: DataFrame, now: int, ttl: int = 48 * 3600) -> DataFrame:
    """(user_id, post_id, seen_ts): known posts that were seen, last time within ttl. interactions: (user_id, item, event, ts)."""
    seen = interactions.filter((F.col("event") == SEEN_EVENT) & (F.col("item") != "")).select("user_id", "item", "ts")
    known = seen.join(dictionary.select("post_id", F.col("uri").alias("item")), "item")
    return known.groupBy("user_id", "post_id").agg(F.max("ts").alias("seen_ts")).filter(F.col("seen_ts") > now - ttl)


def tab_separated(df: DataFrame, *columns: str) -> DataFrame:
    """One text column of the rows with tabs between; backslash, tab, newline and return escaped, times to the second."""

    def cell(name: str) -> Column:
        kind = dict(df.dtypes)[name]
        text = F.date_format(name, "yyyy-MM-dd HH:mm:ss") if kind.startswith("timestamp") else F.col(name).cast("string")
        for raw, mark in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(raw), F.lit(mark))
        return F.coalesce(text, F.lit("\\N"))

    return df.select(F.concat_ws("\t", *map(cell, columns)).alias("value"))


def claims(token: Column) -> Column:
    """The DID that a JWT speaks for: its issuer, else its subject. The signature isn't checked."""
    body = from_url_base64(F.split_part(token, F.lit("."), F.lit(2)))
    return F.coalesce(F.get_json_object(body, "$.iss"), F.get_json_object(body, "$.sub"))


def allowed(requests: DataFrame, identities: DataFrame) -> DataFrame:
    """requests (feed_uri) whose feed belongs to an allowed identity (did)."""
    authority = F.regexp_extract("feed_uri", "^at://([^/]+)/", 1)
    return requests.withColumn("_did", authority).join(identities.select(F.col("did").alias("_did")).distinct(), "_did", "left_semi").drop("_did")
