"""Column expressions that the operators share. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DAY


def hash16(text: Column) -> Column:
    """The first 16 hex digits of SHA-256: how identities are kept."""
    return F.substring(F.sha2(text, 256), 1, 16)


def day_of(seconds: Column) -> Column:
    """yyyyMMdd (UTC) of unix seconds, whatever the session's time zone."""
    return F.date_format(F.date_from_unix_date(F.floor(seconds / DAY).cast("int")), "yyyyMMdd")


def unix_seconds(at: Column) -> Column:
    """Unix seconds of a timestamp without time zone, read as UTC whatever the session's time zone."""
    clock = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    return F.unix_date(at.cast("date")).cast("bigint") * DAY + clock


def retained_days(now: int, days: int) -> list[str]:
    """The day keys that a read at `now` covers: today and the days before it, as literals for partition pruning."""
    from datetime import UTC, datetime, timedelta

    today = datetime.fromtimestamp(now, UTC)
    return [(today - timedelta(days=d)).strftime("%Y%m%d") for d in range(days)]


def day_ttl(like_date: Column, now: int, days: int) -> Column:
    """Seconds that a day's edges have left: until `days` days after the day began, 1 at least."""
    start = F.unix_date(F.to_date(like_date, "yyyyMMdd")).cast("bigint") * DAY
    return F.greatest(start + F.lit(days * DAY) - F.lit(now), F.lit(1))


def day_tranche(seconds: Column, now: int, days: int) -> Column:
    """Age in whole days, from 0 to days - 1."""
    return F.least(F.greatest(F.floor((F.lit(now) - seconds) / DAY), F.lit(0)), F.lit(days - 1)).cast("int")


def author_of(uri: Column) -> Column:
    """The DID that a post's URI starts with, null for other URIs."""
    did = F.regexp_extract(uri, "^at://(did:[^/]+)/", 1)
    return F.when(did != "", did)


def decay(seconds: Column, now: int, half_life: float, constant: float) -> Column:
    """exp(-constant * age / half_life)."""
    return F.exp(F.lit(-constant / half_life) * (F.lit(now) - seconds))


def paths_boost(paths: Column, power: float) -> Column:
    return F.pow(F.greatest(paths, F.lit(1)).cast("double"), F.lit(power)) if power > 0 else F.lit(1.0)


def popularity_penalty(likers: Column, power: float) -> Column:
    return F.when(likers > 1, F.pow(1.0 / likers, F.lit(power * 0.5))).otherwise(1.0) if power > 0 else F.lit(1.0)


def specificity(likes: Column, power: float) -> Column:
    return F.pow(100.0 / F.greatest(likes, F.lit(100)), F.lit(power)) if power > 0 else F.lit(1.0)


def top(df: DataFrame, n: int, by: list[str], *order: Column, name: str | None = None) -> DataFrame:
    """The first n rows of each group in an order; the place, from 1, as column `name` if asked for.

    Spark turns the filter into a WindowGroupLimit, so each task sends n rows a group at most.
    """
    ranked = df.withColumn(name or "_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    kept = ranked.filter(F.col(name or "_rank") <= n)
    return kept if name else kept.drop("_rank")


def seeded(seed: str, *columns: Column) -> Column:
    """A reproducible random order."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *(c.cast("string") for c in columns)), 256)


def seeded_unit(seed: str, *columns: Column) -> Column:
    """A reproducible number in [0, 1)."""
    return F.conv(F.substring(seeded(seed, *columns), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def url_base64(text: Column) -> Column:
    """Base64 with the URL alphabet, without padding."""
    return F.rtrim(F.translate(F.regexp_replace(F.base64(text.cast("binary")), "[\r\n]", ""), "+/", "-_"), F.lit("="))


def from_url_base64(text: Column) -> Column:
    """The text of url_base64(), null if it is none."""
    plain = F.translate(text, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    valid = text.rlike("^[A-Za-z0-9_-]+$") & (F.length(text) % 4 != 1)
    return F.when(valid, F.unbase64(F.when(valid, padded)).cast("string"))
