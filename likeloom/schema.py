"""Schemas of the entities, as DDL text, and names fixed by the public protocol."""

from __future__ import annotations

#: Fixed values of the public AT Protocol.
LIKE_COLLECTION = "app.bsky.feed.like"
POST_COLLECTION = "app.bsky.feed.post"
SEEN_EVENT = "app.bsky.feed.defs#interactionSeen"

LIKES = "user_id bigint, post_id bigint, like_ts bigint, like_date string"
LIKE_COLUMNS = ("user_id", "post_id", "like_ts", "like_date")
POSTS = "post_id bigint, uri string, author_did string"
CANDIDATES = "algo_id int, post_id bigint"
SOURCE_POSTS = "algo_id int, uri string, written_at bigint, created_at bigint"
HIDDEN = "algo_id int, uri string, hidden boolean"
SEEN = "user_id bigint, post_id bigint, seen_ts bigint"
FEEDS = "feed_uri string, algo_id int, active boolean"

EVENT = "kind string, did string, time_us bigint, commit struct<collection:string, operation:string, record:struct<subject:struct<uri:string>>>"
EXPORT = "algo_id int, uris array<string>"
INTERACTIONS = "did string, sent_at timestamp, interactions array<struct<item:string, uri:string, event:string, feedContext:string, reqId:string>>"

SPECIAL_LISTS = {
    "pinned": "array<struct<attribution:string, post:string>>",
    "sticky": "array<struct<attribution:string, post:string>>",
    "sponsored": "array<struct<attribution:string, post:string, cpm_cents:int>>",
}
SPECIAL = "algorithm_id int, sponsorship_saturation_rate int, " + ", ".join(f"{k} {v}" for k, v in SPECIAL_LISTS.items())
PROVENANCE = (
    "feed_uri string, algo_id int, depth int, personalized boolean, source string, ranking_type string, fallback_tranche string, total int, personalized_count int, attribution string, "
    "params struct<min_post_likes:int, max_likers_per_post:int, max_total_sources:int, max_algo_checks:int, min_co_likes:int, max_user_likes:int, max_sources_per_post:int, seed_sample_pool:int, corater_decay:int>, "
    "response_time_ms double, is_holdout boolean, in_holdout boolean"
)
LEARNING = "algo_id int, enabled boolean, speed_gate_ms double, interaction_weights map<string, struct<sign:tinyint, multiplier:double>>"
