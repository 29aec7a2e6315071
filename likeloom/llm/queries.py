"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, licenses, mixing, quality, secrets, simhash, suffixes, superkmers, topk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans_text(spans: str) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents: base counts, the base spans' digest and all spans."""
    base = ("assign", "access", "hex")
    found = secrets.scan_secrets(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda x: x["kind"].isin(*base)))
    counts = [F.expr(f"size(filter(base, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of documents and the components that links of two bits make."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked factors and sampling probabilities of documents, and the sample."""
    found = mixing.mixing(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *mixing.MARGINS, "n_tokens", F.round("factor", 6).alias("factor"), F.round("probability", 6).alias("probability"), "sampled")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of pages with its length in code points."""
    return html.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of each fiftieth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of documents, with the weakly supervised verdict."""
    found = quality.quality_report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.COUNTS, "base_failed", "kept", "quality")


def removed(spans: str) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents left when strings of 100 bytes that start earlier are removed."""
    found = suffixes.remove_repeated_strings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_units").alias("n_bytes"), removed("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents left when windows of 20 words that start earlier are removed."""
    found = superkmers.remove_repeated_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_units").alias("n_words"), removed("spans").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and fuzzy notices in documents; score is 1 for an exact phrase, else the best notice's similarity."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base, more = F.col("places.label"), F.col("spans.label")
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.similarity"), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(base))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(base, more)))).alias("labels"),
        score.alias("score"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' token counts with digests of their ids and of their decoding."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: The rules as the SQL has them, written apart from the operator: kind, what stands before a match, the match, the group that must be long enough (1 is the whole match), and its least length.
SECRETS = (
    ("assign", "", r"""(?i:(password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+))""", 3, 6),
    ("access", "", r"AKIA[A-Z0-9]+", 1, 20),
    ("hex", "", r"[0-9a-f]{24,}", 1, 24),
    ("github", "", r"gh[pousr]_[A-Za-z0-9]{36,}", 1, 0),
    ("slack", "", r"xox[abprs]-[A-Za-z0-9-]{10,}", 1, 0),
    ("google", "", r"AIza[0-9A-Za-z_-]{35}", 1, 0),
    ("stripe", "", r"[rs]k_(live|test)_[0-9A-Za-z]{16,}", 1, 0),
    ("npm", "", r"npm_[A-Za-z0-9]{36}", 1, 0),
    ("jwt", r"^|[^A-Za-z0-9_-]", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1, 0),
    ("pem", "", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0),
    ("bearer", "", r"(?i:bearer\x20+[A-Za-z0-9._~+/=-]{16,})", 1, 0),
    ("login", r"^|[^a-z0-9+.-]", r"[a-z][a-z0-9+.-]*://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@", 1, 0),
)


def secrets_sql() -> str:
    """Each rule's matches have their places from the lengths of what stands between them."""
    parts = []
    for rank, (kind, before, match, group, least) in enumerate(SECRETS):
        pattern = f"({before})({match})".replace("\\'", "'").replace("'", "''")
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps, "
            f"regexp_extract_all(t, '{pattern}', 1) AS before, regexp_extract_all(t, '{pattern}', {group + 1}) AS groups FROM d"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
each AS (SELECT doc_id, rank, kind, least, hits, gaps, before, groups, unnest(range(1, len(hits) + 1)) AS i FROM found WHERE len(hits) > 0),
placed AS (
  SELECT doc_id, rank, kind, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) + length(before[i]) AS BIGINT) AS s, length(hits[i]) - length(before[i]) AS n
  FROM each WHERE length(groups[i]) >= least),
spans AS (SELECT doc_id, rank, s, kind || ':' || s || ':' || (s + n) AS span FROM placed)
SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY s, rank), '') AS spans
FROM d LEFT JOIN spans ON d.doc_id = spans.doc_id GROUP BY d.doc_id"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_html": op4_html,
    "op5_topk": op5_topk,
    "op6_quality": op6_quality,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_licenses": op9_licenses,
    "op10_bpe": op10_bpe,
}

def mixing_sql() -> str:
    """A hundred rounds of raking, which is more than it takes; written apart from the operator."""
    margins, powers = ("source", "lang", "topic"), {"source": 0.5, "lang": 0.7, "topic": 0.7}

    def raking(source: str) -> str:
        for m in margins:
            source = f"SELECT * REPLACE (x * to_{m} / sum(x) OVER (PARTITION BY {m}) AS x) FROM ({source})"
        return source

    def often(*marks: str) -> str:
        left = "t"
        for x in marks:
            left = f"replace({left}, '{x}', '')"
        return f"10 * (length(t) - length({left})) > n_tokens"

    tempered = ", ".join(f"pow(sum(x) OVER (PARTITION BY {m}), {powers[m]}) AS p_{m}, count(*) OVER (PARTITION BY {m}) AS n_{m}" for m in margins)
    scaled = ", ".join(f"p_{m} * (sum(x) OVER () / sum(p_{m} / n_{m}) OVER ()) AS to_{m}" for m in margins)
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
rows_ AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN regexp_matches(t, '[Ll][Ii][Cc][Ee][Nn][Ss][Ee]') THEN 'legal' WHEN {often("|")} THEN 'tables'
  WHEN {often("#", "*", "$", "%", "&")} THEN 'markup' WHEN n_tokens >= 500 THEN 'essay' ELSE 'note' END AS topic FROM d),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS x FROM rows_ WHERE n_tokens > 0 GROUP BY ALL),
powers AS (SELECT *, {tempered} FROM cells),
scaled AS (SELECT source, lang, topic, tokens, x, {scaled} FROM powers),
rounds AS (SELECT * FROM (SELECT *, 0 AS r FROM scaled) UNION ALL {raking("SELECT * REPLACE (r + 1 AS r) FROM rounds WHERE r < 100")}),
factors AS (SELECT source, lang, topic, tokens, x / tokens AS factor FROM rounds WHERE r = 100),
sums AS (SELECT *, 0.5 * sum(tokens) OVER () - coalesce(sum(tokens) OVER o, 0) AS want,
  sum(tokens * factor) OVER () - coalesce(sum(tokens * factor) OVER o, 0) AS rest
  FROM factors WINDOW o AS (ORDER BY factor DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
scale AS (SELECT arg_max(want / rest, factor) AS c FROM sums WHERE want / rest * factor < 1),
chances AS (SELECT source, lang, topic, factor, least(1.0, factor * (SELECT c FROM scale)) AS probability FROM factors),
joined AS (SELECT r.doc_id, r.source, r.lang, r.topic, r.n_tokens, coalesce(c.factor, 0.0) AS factor, CASE WHEN n_tokens > 0 THEN c.probability ELSE 0.0 END AS probability
  FROM rows_ r LEFT JOIN chances c USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(factor, 6) AS factor, round(probability, 6) AS probability,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < probability AS sampled
FROM joined"""


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

ORACLE: dict[str, str] = {"op1_secrets": secrets_sql(), "op3_mixing": mixing_sql(), "op5_topk": TOPK_SQL}
