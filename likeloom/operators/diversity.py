"""Author diversity as a closed form over windows, for all users at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DiversityParams


def _placed(ranked: DataFrame, p: DiversityParams, by: tuple[str, ...]) -> DataFrame:
    """Rows with an author, each with the posts of its author before it and its place among those under the cap."""
    order = [F.desc("score"), F.col("post_id")]
    known = ranked.filter("author_did IS NOT NULL")
    place = known.withColumn("of_author", F.row_number().over(Window.partitionBy(*by, "author_did").orderBy(*order)) - 1)
    eligible = (F.col("of_author") < p.per_author).cast("int")
    running = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return place.withColumn("eligible", eligible).withColumn("taken", F.sum("eligible").over(running))


def diversify(ranked: DataFrame, limit: int, p: DiversityParams = DiversityParams(), by: tuple[str, ...] = ("algo_id", "user_id")) -> DataFrame:
    """The best `limit` rows with per_author of an author at most, scores demoted by what the author already has; with adjusted score and place.

    ranked: (by…, post_id, author_did, score). Disabled, rows pass as they are.
    """
    if not p.enabled:
        return ranked.withColumn("adjusted", F.col("score")).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "post_id")))
    chosen = _placed(ranked, p, by).filter((F.col("eligible") == 1) & (F.col("taken") <= limit))
    power = F.pow(F.lit(p.factor), F.col("of_author"))
    adjusted = F.col("score") * power * F.when(F.col("of_author") > 0, 1 - p.strength * (1 - power)).otherwise(1.0)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("adjusted"), "post_id"))
    return chosen.drop("eligible", "taken").withColumn("adjusted", adjusted).withColumn("place", place)


def diversity_stats(ranked: DataFrame, limit: int, p: DiversityParams = DiversityParams(), by: tuple[str, ...] = ("algo_id", "user_id")) -> DataFrame:
    """By user: authors shown, posts demoted, and posts that the cap removed before the limit was reached."""
    rows = _placed(ranked, p, by)
    chosen = (F.col("eligible") == 1) & (F.col("taken") <= limit)
    return rows.groupBy(*by).agg(
        F.count_distinct(F.when(chosen, F.col("author_did"))).alias("unique_authors"),
        F.count_if(chosen & (F.col("of_author") > 0)).alias("demoted"),
        F.count_if((F.col("eligible") == 0) & (F.col("taken") < limit)).alias("removed_by_cap"),
    )
