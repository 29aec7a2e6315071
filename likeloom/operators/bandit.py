"""Beta-Bernoulli bandits over ranking parameters, as aggregations of observations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import seeded_unit
from ..params import SuccessParams

#: The parameters that are learnt, each with the values tried and the one that requests without any get.
SEARCH_SPACE: dict[str, tuple[tuple[int, ...], int]] = {
    "min_post_likes": ((3, 5, 10), 5),
    "max_likers_per_post": ((20, 30, 50), 30),
    "max_total_sources": ((500, 1000, 2000), 1000),
    "max_algo_checks": ((200, 500, 1000), 500),
    "min_co_likes": ((1, 2, 3), 1),
    "max_user_likes": ((200, 500, 1000), 500),
    "max_sources_per_post": ((50, 100, 200), 100),
    "seed_sample_pool": ((0, 500, 1000), 0),
    "corater_decay": ((0, 10, 20), 0),
}


def check_space(space: dict[str, tuple[tuple[int, ...], int]]) -> list[str]:
    """What is wrong with a search space: unknown parameters, no values, a default that isn't among them."""
    found = [f"{n}: not a parameter" for n in space if n not in SEARCH_SPACE]
    found += [f"{n}: no values" for n, (values, _) in space.items() if not values]
    return found + [f"{n}: default {d} is not among the values" for n, (values, d) in space.items() if values and d not in values]


def with_defaults(observations: DataFrame, space: dict[str, tuple[tuple[int, ...], int]] = SEARCH_SPACE) -> DataFrame:
    """Observations whose missing parameters have their defaults."""
    return observations.withColumns({n: F.coalesce(F.col(n) if n in observations.columns else F.lit(None), F.lit(d)).cast("int") for n, (_, d) in space.items()})


def arms(observations: DataFrame, space: dict[str, tuple[tuple[int, ...], int]] = SEARCH_SPACE, every: bool = False) -> DataFrame:
    """(algo_id, param, value, alpha, beta, win_rate): each observation counts for the arm of each of its parameters.

    Holdouts and treatment overrides teach nothing; values outside the space are left out. The prior
    is 1 and 1; with `every`, arms without observations are there with it.
    """
    learnt = observations.filter(~F.col("is_holdout") & ~F.col("is_treatment_override"))
    pairs = F.array(*(F.struct(F.lit(n).alias("param"), F.col(n).cast("int").alias("value")) for n in space))
    each = learnt.select("algo_id", "success", F.explode(pairs).alias("arm")).select("algo_id", "success", "arm.*")
    tried = F.array(*(F.struct(F.lit(n).alias("param"), F.lit(v).alias("value")) for n, (values, _) in space.items() for v in values))
    known = F.map_from_arrays(F.array(*map(F.lit, space)), F.array(*(F.array(*map(F.lit, values)) for values, _ in space.values())))
    counts = each.filter(F.array_contains(F.element_at(known, F.col("param")), F.col("value"))).groupBy("algo_id", "param", "value").agg(F.count_if("success").alias("won"), F.count_if(~F.col("success")).alias("lost"))
    if every:
        grid = observations.select("algo_id").distinct().select("algo_id", F.explode(tried).alias("arm")).select("algo_id", "arm.*")
        counts = grid.join(counts, ["algo_id", "param", "value"], "left").fillna(0, ["won", "lost"])
    alpha, beta = F.col("won") + 1.0, F.col("lost") + 1.0
    return counts.select("algo_id", "param", "value", alpha.alias("alpha"), beta.alias("beta"), (alpha / (alpha + beta)).alias("win_rate"))


def drawn_samples(bandit: DataFrame) -> DataFrame:
    """bandit (…, seed) with sample, a draw from each arm's Beta."""

    @F.pandas_udf("double")
    def draw(seed: pd.Series, key: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([s, k & 0xFFFFFFFF, k >> 32 & 0xFFFFFFFF]).beta(a, b) for s, k, a, b in zip(seed, key, alpha, beta, strict=True)])

    return bandit.withColumn("sample", draw("seed", F.xxhash64("algo_id", "param", "value"), "alpha", "beta"))


def draw_moments(bandit: DataFrame, draws: int) -> DataFrame:
    """(algo_id, param, value, mean, variance) of so many draws of each arm, with what they are expected to be."""
    each = drawn_samples(bandit.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))))
    whole = F.col("alpha") + F.col("beta")
    found = each.groupBy("algo_id", "param", "value", "alpha", "beta").agg(F.avg("sample").alias("mean"), F.var_samp("sample").alias("variance"))
    return found.select("algo_id", "param", "value", "mean", "variance", (F.col("alpha") / whole).alias("expected_mean"), (F.col("alpha") * F.col("beta") / (whole * whole * (whole + 1))).alias("expected_variance"))


def thompson_draw(bandit: DataFrame, seed: int) -> DataFrame:
    """(algo_id, param, value, sample): the arm of each feed and parameter with the highest draw from its Beta; equal draws go to the smaller value.

    An arm's draw depends on the seed and the arm alone, so partitioning doesn't change it.
    """
    sampled = drawn_samples(bandit.withColumn("seed", F.lit(seed)))
    best = sampled.groupBy("algo_id", "param").agg(F.max_by(F.struct("value", "sample"), F.struct("sample", -F.col("value"))).alias("best"))
    return best.select("algo_id", "param", "best.value", "best.sample")


@dataclass(frozen=True)
class Selection:
    """How requests are dealt to parameters; overrides apply to all but holdouts."""

    holdout: float = 0.1
    explore: float = 0.05
    override: tuple[tuple[str, int], ...] = ()
    seed: str = "0"


def selected(requests: DataFrame, drawn: DataFrame, s: Selection = Selection(), space: dict[str, tuple[tuple[int, ...], int]] = SEARCH_SPACE) -> DataFrame:
    """requests (request_id, algo_id) with their parameters and how they were chosen.

    Holdouts get the defaults; a treatment override its values; explorations a random value for each
    parameter; the others the arms drawn for the feed.
    """
    wide = drawn.groupBy("algo_id").pivot("param", list(space)).agg(F.first("value"))
    joined = requests.join(wide, "algo_id", "left")
    held = seeded_unit(f"{s.seed}:holdout", F.col("request_id")) < s.holdout
    exploring = seeded_unit(f"{s.seed}:explore", F.col("request_id")) < s.explore
    override = dict(s.override)
    out = joined.withColumns({"is_holdout": held, "is_treatment_override": ~held & F.lit(bool(override)), "is_exploration": ~held & F.lit(not override) & exploring})
    for name, (values, default) in space.items():
        pick = (F.floor(seeded_unit(f"{s.seed}:{name}", F.col("request_id")) * len(values)) + 1).cast("int")
        random = F.element_at(F.array(*map(F.lit, values)), pick)
        usual = F.lit(override[name]) if name in override else F.when(F.col("is_exploration"), random).otherwise(F.coalesce(F.col(name), F.lit(default)))
        out = out.withColumn(name, F.when(F.col("is_holdout"), default).otherwise(usual).cast("int"))
    return out


def request_success(p: SuccessParams = SuccessParams()) -> Column:
    """Whether a request went well, over (total_posts, personalized_posts, posts_checked, posts_scored, response_time_ms)."""
    share = F.when(F.col("total_posts") > 0, F.col("personalized_posts") / F.col("total_posts")).otherwise(0.0)
    return (share >= p.personalized_share) & (F.col("posts_checked") >= p.min_checked) & (F.col("posts_scored") >= p.min_scored) & (F.col("response_time_ms") <= p.max_ms)


def interaction_success(interactions: DataFrame, weights: DataFrame) -> DataFrame:
    """Interactions that teach something, with success.

    interactions: (algo_id, event, response_time_ms, is_holdout, has_params…); weights: (algo_id,
    enabled, speed_gate_ms, interaction_weights map<event, struct<sign, multiplier>>). A response
    slower than the gate is a failure whatever the event; events without a weight, or of sign 0, teach nothing.
    """
    known = interactions.join(weights.filter("enabled"), "algo_id").filter("has_params AND response_time_ms IS NOT NULL AND NOT coalesce(is_holdout, false)")
    weight = F.element_at("interaction_weights", F.col("event"))
    slow = F.col("response_time_ms") > F.col("speed_gate_ms")
    success = F.when(slow, False).when(weight.isNotNull() & (weight["sign"] != 0), weight["sign"] * weight["multiplier"] > 0)
    return known.withColumn("success", success).filter("success IS NOT NULL").drop("enabled", "speed_gate_ms", "interaction_weights")


def request_time_only(observations: DataFrame, weights: DataFrame) -> DataFrame:
    """Request-time observations of feeds that don't learn from interactions."""
    learning = weights.filter(F.size("interaction_weights") > 0).select("algo_id").distinct()
    return observations.join(learning, "algo_id", "left_anti")


def request_counters(observations: DataFrame) -> DataFrame:
    """By feed: requests, and how many were holdouts, explorations, overrides and taught something."""
    return observations.groupBy("algo_id").agg(
        F.count("*").alias("requests"),
        F.count_if("is_holdout").alias("holdouts"),
        F.count_if("is_exploration").alias("explorations"),
        F.count_if("is_treatment_override").alias("overrides"),
        F.count_if(~F.col("is_holdout") & ~F.col("is_treatment_override")).alias("observations"),
    )


def cleared(bandit: DataFrame, algo_ids: list[int]) -> DataFrame:
    """The arms without those of some feeds."""
    return bandit.filter(~F.col("algo_id").isin(*algo_ids)) if algo_ids else bandit
