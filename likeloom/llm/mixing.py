"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token counts are summed by cell (source, language, topic). Raking scales the cells, margin by
margin and round by round, until the shares of sources, languages and topics are those asked for, to
TOLERANCE. Shares that no weights of the cells there are can have (a language in one source alone, say)
are come near to: raking ends where a round brings no less than nine tenths of the error before, and
says what is left as `residual`, the largest error of a share. Shares given by value must be met. A
cell's factor is its raked weight by its own tokens. Factors become sampling probabilities with one
scale for all cells, found so that the expected tokens of the sample are the budget; cells that
reach probability 1 are taken whole and the rest is scaled on. A document is in the sample if a
hash of its doc_id is below its cell's probability: the same documents at every run.

Cells are aggregated before anything is shuffled, so a source with a third of all rows is no more
work than another. Raking is windows over the cells, ROUNDS rounds a job, as many jobs as it takes.

Targets: TEMPERATURES ** of the margins' own shares (1 keeps a margin, 0 makes its values equal),
or shares given by value, which add up to 1; values without a share get none, and the other margins'
own shares are those of the cells left.

Topics are a table's column `topic`. For tables without one topic_of() stands in, by marks that a text
of a kind has; it is no model of topics.

Edge cases: null source, language or topic count as the empty string; a null text and a text
without words have no tokens and are never sampled; a null doc_id counts as the empty string in the
hash; rows that share a doc_id and cell are sampled together; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage, unused

MARGINS = ("source", "lang", "topic")
#: Of a margin's share: a large source counts less than its size, languages and topics somewhat less.
TEMPERATURES = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Rounds between two looks at the error.
ROUNDS = 5
#: The largest error of a share at which raking is done, and one that shares given by value may have at most.
TOLERANCE, MOST_ERROR = 1e-10, 1e-6
#: Expected tokens of the sample by all tokens.
BUDGET = 0.5
SEED = "mix"

WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A stand-in for topics, by marks, for tables that have none."""
    text = F.coalesce(text, F.lit(""))

    def often(*marks: str) -> Column:
        left = reduce(lambda t, m: F.replace(t, F.lit(m)), marks, text)
        return 10 * (F.length(text) - F.length(left)) > tokens

    return (
        F.when(text.rlike("[Ll][Ii][Cc][Ee][Nn][Ss][Ee]"), "legal")
        .when(often("|"), "tables")
        .when(often("#", "*", "$", "%", "&"), "markup")
        .when(tokens >= 500, "essay")
        .otherwise("note")
    )


def with_cells(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs, all columns, with tokens and the cell (source, lang, topic), their names after prefix."""

    def margin(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in docs.columns else F.lit("")

    counted = docs.withColumn(f"{prefix}n_tokens", token_count(F.col("text")))
    topic = margin("topic") if "topic" in docs.columns else topic_of(F.col("text"), F.col(f"{prefix}n_tokens"))
    return counted.withColumns({f"{prefix}source": margin("source"), f"{prefix}lang": margin("lang"), f"{prefix}topic": topic})


def checked(targets: dict[str, dict[str, float]] | None) -> dict[str, dict[str, float]]:
    for name, shares in (targets or {}).items():
        if name not in MARGINS:
            raise ValueError(f"{name} is no margin; the margins are {', '.join(MARGINS)}")
        if any(not 0 <= x <= 1 for x in shares.values()) or abs(sum(shares.values()) - 1) > 1e-9:
            raise ValueError(f"the shares of {name} must be between 0 and 1 and add up to 1")
    return targets or {}


def raked(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """cells (MARGINS, tokens; tokens over 0) with factor, raked weight by tokens, and residual, the largest error of a share.

    targets: for a margin, the share of each of its values; a margin without one gets its share to its
    temperature. ValueError where no weights of these cells have the shares given.
    """
    targets = checked(targets)
    shares = {name: F.coalesce(F.create_map(*(F.lit(y) for pair in given.items() for y in pair))[F.col(name)], F.lit(0.0)) for name, given in targets.items()}
    wanted = reduce(lambda a, b: a & b, [share > 0 for share in shares.values()], F.lit(True))
    spread = cells.withColumn("x", F.when(wanted, F.col("tokens").cast("double")).otherwise(0.0))
    for name in MARGINS:
        own = Window.partitionBy(name)
        to = shares[name] if name in targets else F.pow(F.sum("x").over(own), F.lit(TEMPERATURES[name]))
        # One row of each value stands for it when the margin's targets are summed.
        spread = spread.withColumn(f"to_{name}", to).withColumn(f"n_{name}", F.count("*").over(own))
    spread = stage(spread, "cells")
    known = spread.agg(F.sum("x").alias("x"), *(F.sum(F.col(f"to_{n}") / F.col(f"n_{n}")).alias(f"sum_{n}") for n in MARGINS)).first()  # one row
    for name in MARGINS:
        scale = 1.0 if name in targets else known[f"sum_{name}"] or 1.0
        spread = spread.withColumn(f"to_{name}", F.col(f"to_{name}") * F.lit((known["x"] or 0.0) / scale)).drop(f"n_{name}")
    before, error, order = 1.0, dict.fromkeys(MARGINS, 0.0), sorted(MARGINS, key=lambda n: n in targets)  # shares that must be met come last
    while known["x"]:
        for _ in range(ROUNDS):
            for name in order:
                ratio = F.try_divide(F.col(f"to_{name}"), F.sum("x").over(Window.partitionBy(name)))
                spread = spread.withColumn("x", F.col("x") * F.coalesce(ratio, F.lit(0.0)))
        spread = stage(spread, "raked")
        sums = [F.abs(F.sum("x").over(Window.partitionBy(n)) - F.col(f"to_{n}")).alias(n) for n in MARGINS]
        error = {n: x / known["x"] for n, x in spread.select(*sums).agg(*(F.max(n).alias(n) for n in MARGINS)).first().asDict().items()}  # one row
        worst = max(error.values())
        if worst <= TOLERANCE or worst > 0.9**ROUNDS * before:
            break
        before = worst
    unmet = {n: error[n] for n in targets if error[n] > MOST_ERROR} or ({"all": 1.0} if targets and not known["x"] and known["x"] is not None else {})
    if unmet:
        raise ValueError(f"no weights of these cells have the shares given; off by {unmet}")
    return spread.select(*MARGINS, "tokens", (F.col("x") / F.col("tokens")).alias("factor"), F.lit(max(error.values())).alias("residual"))


def calibrated(factors: DataFrame, budget: float = BUDGET) -> DataFrame:
    """factors with probability: the least of 1 and scale * factor, for the scale that makes the expected tokens budget of all."""
    factors = stage(factors, "factors")
    scale, full = 0.0, -1
    while True:
        whole = F.col("factor") * F.lit(scale) >= 1
        row = factors.agg(
            F.sum("tokens").alias("all"),
            F.count_if(whole).alias("full"),
            F.sum(F.when(whole, F.col("tokens"))).alias("whole"),
            F.sum(F.when(~whole, F.col("tokens") * F.col("factor"))).alias("rest"),
        ).first()  # one row
        if row["full"] == full or not row["rest"]:  # a larger scale only adds to the cells taken whole
            break
        full, scale = row["full"], (row["all"] * budget - (row["whole"] or 0)) / row["rest"]
    return factors.withColumn("probability", F.least(F.lit(1.0), F.col("factor") * F.lit(scale)))


def drawn(probability: Column, doc_id: Column, seed: str = SEED) -> Column:
    """True if the document's hash, as a fraction, is below probability."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) < probability


def mixing(docs: DataFrame, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, factor, probability, sampled) of each row."""
    named = docs.select("doc_id", "text", *(m for m in MARGINS if m in docs.columns))
    rows = stage(with_cells(named).select(F.col("doc_id").cast("long").alias("doc_id"), *MARGINS, "n_tokens"), "tokens")
    cells = rows.filter("n_tokens > 0").groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    chances = calibrated(raked(cells, targets=targets), budget).drop("tokens")
    joined = rows.join(chances.drop("residual"), list(MARGINS), "left")
    chance = F.when(F.col("n_tokens") > 0, F.col("probability")).otherwise(0.0)
    return joined.select("doc_id", *MARGINS, "n_tokens", F.coalesce("factor", F.lit(0.0)).alias("factor"), chance.alias("probability")).withColumn("sampled", drawn(F.col("probability"), F.col("doc_id")))


def sample_mix(docs: DataFrame, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The rows of docs, all columns, that mixing() samples."""
    (prefix,) = unused(docs, "_mix_")
    measured = with_cells(docs, prefix)
    names = {f"{prefix}{n}": n for n in MARGINS}
    cells = measured.filter(F.col(f"{prefix}n_tokens") > 0).groupBy(*names).agg(F.sum(f"{prefix}n_tokens").alias("tokens")).withColumnsRenamed(names)
    chances = calibrated(raked(cells, targets=targets), budget).select(*(F.col(n).alias(p) for p, n in names.items()), F.col("probability").alias(f"{prefix}probability"))
    kept = measured.join(chances, list(names)).filter((F.col(f"{prefix}n_tokens") > 0) & drawn(F.col(f"{prefix}probability"), F.col("doc_id")))
    return kept.select(*(F.col(f"`{x}`") for x in docs.columns))
