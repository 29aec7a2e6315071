"""Feed assembly: fallback lists, staggering, blending, injection, pages. Orders are columns, never row positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import seeded, seeded_unit, top
from ..params import BlendParams

#: Lists that a fallback page is made of, in their priority.
LISTS = ("popular", "velocity", "discovery")


def quota(limit: int, ratio: float) -> int:
    return int(max(1.0, limit * ratio))


def tranche_page(tranche: DataFrame, limit: int, offset: int, excluded: DataFrame | None = None, n_excluded: int = 0) -> DataFrame:
    """(algo_id, uri, place): a slice of a ranked list (algo_id, uri, rank) less the excluded URIs.

    The slice is longer by up to 50 for what is excluded, and by 10.
    """
    part = tranche.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit + min(n_excluded, 50) + 10))
    left = part if excluded is None else part.join(excluded.select("uri").distinct(), "uri", "left_anti")
    return top(left, limit, ["algo_id"], F.col("rank"), name="place").select("algo_id", "uri", "place")


def random_page(candidates: DataFrame, limit: int, seed: str) -> DataFrame:
    """What a first page takes from an empty list: seeded random candidates."""
    return top(candidates, limit, ["algo_id"], seeded(seed, F.col("uri")), F.col("uri"), name="place").select("algo_id", "uri", "place")


def first_page(tranche: DataFrame, candidates: DataFrame, limit: int, seed: str, excluded: DataFrame | None = None, n_excluded: int = 0) -> DataFrame:
    """(algo_id, uri, place): each feed's first page of a ranked list; feeds whose list gives none get seeded random candidates (algo_id, uri)."""
    page = tranche_page(tranche, limit, 0, excluded, n_excluded)
    without = candidates.join(page.select("algo_id").distinct(), "algo_id", "left_anti")
    return page.unionByName(random_page(without, limit, seed))


def fallback_blend(tranches: DataFrame, limit: int, p: BlendParams = BlendParams(), offset: int = 0, excluded: DataFrame | None = None, n_excluded: int = 0) -> DataFrame:
    """(algo_id, uri, tranche, pos): the lists' shares of a page, a URI in its first list only, in turns.

    tranches: (algo_id, tranche, uri, rank).
    """
    shares = [quota(limit, r) for r in (p.popular, p.velocity, p.discovery)]
    parts = []
    for i, (name, n) in enumerate(zip(LISTS, shares, strict=True)):
        page = tranche_page(tranches.filter(F.col("tranche") == name), n + 5, offset // 3, excluded, n_excluded)
        parts.append(page.select("algo_id", "uri", "place", F.lit(name).alias("tranche"), F.lit(i).alias("priority"), F.lit(n).alias("share")))
    pages = parts[0].unionByName(parts[1]).unionByName(parts[2])
    once = top(pages, 1, ["algo_id", "uri"], F.col("priority"))
    turn = F.row_number().over(Window.partitionBy("algo_id", "tranche").orderBy("place"))
    due = once.withColumn("turn", turn).filter(F.col("turn") <= F.col("share"))
    return top(due, limit, ["algo_id"], F.col("turn"), F.col("priority"), name="pos").select("algo_id", "uri", "tranche", "pos")


def staggered(personal: DataFrame, fallback: DataFrame, factor: float, by: tuple[str, ...] = ("algo_id", "user_id")) -> DataFrame:
    """Both lists (by…, pos, uri, source) as one with new positions from 1.

    factor 0 puts the fallback last, 1 alternates; between, floor(n * factor) of the fallback's posts
    are spread over the personal ones and the rest comes last. Without personal posts the fallback stands alone.
    """
    both = personal.select(*by, "pos", "uri", "source", F.lit(0).alias("late")).unionByName(fallback.select(*by, "pos", "uri", "source", F.lit(1).alias("late")))
    own = Window.partitionBy(*by)
    n_own, n_late = F.count_if(F.col("late") == 0).over(own), F.count_if(F.col("late") == 1).over(own)
    counted = both.withColumns({"n_own": n_own, "n_late": n_late, "i": F.row_number().over(Window.partitionBy(*by, "late").orderBy("pos", "uri"))})
    late, i = F.col("late") == 1, F.col("i")
    if factor >= 1:
        major, minor = i, F.col("late")
    elif factor <= 0:
        major, minor = F.col("late"), i
    else:
        n = F.floor(F.col("n_late") * factor)
        interval = F.greatest(F.floor(F.col("n_own") / (n + 1)), F.lit(2))
        spread = late & (i <= n)
        # A spread post stands before the personal post whose index from 0 is its slot.
        major = F.when(~late, 2 * i - 1).when(spread, 2 * F.least(i * interval, F.col("n_own"))).otherwise(F.lit(1 << 40))
        minor = i
    order = Window.partitionBy(*by).orderBy(major, minor, "late")
    return counted.withColumn("at", F.row_number().over(order)).select(*by, F.col("at").alias("pos"), "uri", "source")


def personal_share(likes: Column, p: BlendParams) -> Column:
    """How much of a user's page is personal: less for users with few likes."""
    return F.when(likes <= p.cold_likes, 1 - p.cold_trending).when(likes <= p.warm_likes, 1 - p.warm_trending).otherwise(p.personalized)


def blended(users: DataFrame, personal: DataFrame, by_author: DataFrame, fallback: DataFrame, limit: int, p: BlendParams = BlendParams()) -> DataFrame:
    """(algo_id, user_id, pos, uri, source): each user's page of `limit` posts.

    users: (algo_id, user_id, like_count); personal and by_author: ranked (algo_id, user_id, rank,
    uri); fallback: lists (algo_id, tranche, uri, rank). Posts by liked authors fill what the personal
    list lacks, from twice as many; the fallback's share stays what it was, short or not, without
    posts the user has on the page.
    """
    by = ("algo_id", "user_id")
    target = F.floor(F.lit(float(limit)) * personal_share(F.col("like_count"), p))
    aims = users.select(*by, target.cast("int").alias("target"))
    first = personal.join(aims, list(by)).filter(F.col("rank") <= F.col("target")).select(*by, F.col("rank").alias("pos"), "uri", F.lit("post").alias("source"))
    have = first.groupBy(*by).agg(F.count("*").alias("have"))
    gaps = aims.join(have, list(by), "left").withColumn("short", F.col("target") - F.coalesce("have", F.lit(0))).filter("short > 0")
    spare = by_author.join(gaps.select(*by, "short"), list(by)).filter(F.col("rank") <= 2 * F.col("short")).join(first.select(*by, "uri"), [*by, "uri"], "left_anti")
    turn = F.row_number().over(Window.partitionBy(*by).orderBy("rank", "uri"))
    fill = spare.withColumn("turn", turn).filter(F.col("turn") <= F.col("short")).select(*by, (F.lit(limit) + F.col("turn")).alias("pos"), "uri", F.lit("author").alias("source"))
    own = first.unionByName(fill)
    rest = _fallback_of(aims.withColumn("n", F.lit(limit) - F.col("target")), own, fallback, p)
    return top(staggered(own, rest, p.stagger), limit, list(by), F.col("pos"))


def _fallback_of(aims: DataFrame, own: DataFrame, tranches: DataFrame, p: BlendParams) -> DataFrame:
    """fallback_blend() for each user's number n of posts, less the user's own."""
    by = ("algo_id", "user_id")
    names = {"popular": (0, p.popular), "velocity": (1, p.velocity), "discovery": (2, p.discovery)}
    table = [F.struct(F.lit(k).alias("tranche"), F.lit(i).alias("priority"), F.greatest(F.floor(F.col("n") * r), F.lit(1)).cast("int").alias("share")) for k, (i, r) in names.items()]
    n_own = own.groupBy(*by).agg(F.count("*").alias("n_own"))
    wants = aims.filter("n > 0").join(n_own, list(by), "left").select(*by, "n", F.coalesce("n_own", F.lit(0)).alias("n_own"), F.explode(F.array(*table)).alias("t")).select(*by, "n", "n_own", "t.*")
    # The lists are cut to what any page can reach before they meet the users.
    reach = F.col("share") + 15 + F.least("n_own", F.lit(50))
    offered = wants.join(tranches.select("algo_id", "tranche", "uri", "rank"), ["algo_id", "tranche"]).filter(F.col("rank") <= reach)
    offered = offered.join(own.select(*by, "uri"), [*by, "uri"], "left_anti")
    offered = offered.withColumn("place", F.row_number().over(Window.partitionBy(*by, "tranche").orderBy("rank"))).filter(F.col("place") <= F.col("share") + 5)
    once = top(offered, 1, [*by, "uri"], F.col("priority"))
    due = once.withColumn("turn", F.row_number().over(Window.partitionBy(*by, "tranche").orderBy("place"))).filter(F.col("turn") <= F.col("share"))
    placed = due.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("turn", "priority")))
    return placed.filter(F.col("pos") <= F.col("n")).select(*by, "pos", "uri", F.col("tranche").alias("source"))


def without_liked(pages: DataFrame, likes: DataFrame, posts: DataFrame, n: int = 2000) -> DataFrame:
    """pages (user_id, uri…) less the posts that the user liked last."""
    last = top(likes.groupBy("user_id", "post_id").agg(F.max("like_ts").alias("like_ts")), n, ["user_id"], F.desc("like_ts"), F.col("post_id"))
    return pages.join(last.join(posts.select("post_id", "uri"), "post_id").select("user_id", "uri"), ["user_id", "uri"], "left_anti")


def special_posts(config: DataFrame) -> DataFrame:
    """The nested config (algorithm_id, sponsorship_saturation_rate, pinned, sticky, sponsored) as rows (algo_id, saturation, kind, place, attribution, uri, cpm_cents)."""

    def rows(kind: str, name: str) -> Column:
        def one(x: Column, place: Column) -> Column:
            cpm = x["cpm_cents"] if kind == "sponsored" else F.lit(None)
            return F.struct(F.lit(kind).alias("kind"), place.alias("place"), x["attribution"].alias("attribution"), x["post"].alias("uri"), cpm.cast("int").alias("cpm_cents"))

        return F.coalesce(F.transform(name, one), F.array())

    each = F.explode(F.concat(rows("pinned", "pinned"), rows("rotating", "sticky"), rows("sponsored", "sponsored")))
    return config.select(F.col("algorithm_id").alias("algo_id"), F.col("sponsorship_saturation_rate").alias("saturation"), each.alias("x")).select("algo_id", "saturation", "x.*")


def injected(base: DataFrame, special: DataFrame, seed: str, first_page: bool = True, shown: DataFrame | None = None) -> DataFrame:
    """(algo_id, pos, uri, source, attribution): the pages (algo_id, pos, uri) with special posts put in.

    Pinned posts lead the first page. Rotating posts, in seeded random order, are up to a tenth of the
    page; sponsored ones, in their order, up to the saturation of every fifth place; both together up
    to a fifth; one at least. They are mixed at random and spread evenly, a place up or down. Posts on
    the page already and attributions in `shown` (algo_id, kind, attribution) are left out.
    """
    kind = F.col("kind")
    fresh = special.join(base.select("algo_id", "uri"), ["algo_id", "uri"], "left_anti")
    fresh = fresh if shown is None else fresh.join(shown.select("algo_id", "kind", "attribution"), ["algo_id", "kind", "attribution"], "left_anti")
    fresh = fresh if first_page else fresh.filter(kind != "pinned")
    sized = fresh.join(base.groupBy("algo_id").agg(F.count("*").alias("size")), "algo_id", "left").fillna(0, ["size"])

    def among(*by: str) -> Window:
        return Window.partitionBy("algo_id", *by)

    pinned, rotating, sponsored = (kind == k for k in ("pinned", "rotating", "sponsored"))
    # A post stands once: pinned before rotating before sponsored, then by place.
    once = sized.withColumn("again", pinned & ((F.row_number().over(among("kind", "uri").orderBy("place")) > 1) | (F.row_number().over(among("kind", "attribution").orderBy("place")) > 1)))
    free = once.withColumn("taken", ~pinned & F.max(pinned & ~F.col("again")).over(among("uri"))).filter("NOT again AND NOT taken")
    share = F.greatest(F.floor(F.col("size") * 0.10), F.lit(1))
    turned = free.withColumn("turn", F.row_number().over(among("kind").orderBy(seeded(seed, F.col("uri")), "place")))
    chosen = turned.withColumn("rotates", rotating & (F.col("turn") <= share))
    open_ = chosen.withColumns({"blocked": F.max("rotates").over(among("uri")), "n_rotating": F.count_if("rotates").over(among())})
    room = F.greatest(F.floor(F.col("size") * 0.20), F.lit(1)) - F.col("n_rotating")
    most = F.least(F.floor(F.floor(F.col("size") / 5) * F.col("saturation") / 100 + 0.5), room)
    paid = open_.withColumn("pays", sponsored & ~F.col("blocked") & (F.row_number().over(among("kind", "blocked").orderBy("place")) <= most))
    kept = paid.filter(pinned | F.col("rotates") | F.col("pays"))
    mixed = kept.withColumn("spread", ~pinned)
    mixed = mixed.withColumns({"i": F.row_number().over(among("spread").orderBy(seeded(f"{seed}:mix", F.col("uri")), "uri")), "m": F.count("*").over(among("spread"))})
    step = F.greatest(F.floor(F.col("size") / (F.col("m") + 1)), F.lit(2))
    jitter = F.when(step > 2, F.floor(seeded_unit(f"{seed}:jitter", F.col("algo_id"), F.col("i")) * 3) - 1).otherwise(0)
    slot = F.least(F.greatest(F.col("i") * step + jitter, F.lit(1)), F.col("size"))
    # Equal slots count once; posts beyond the distinct slots come last.
    slots = F.array_sort(F.collect_set(slot).over(among("spread")))
    placed = mixed.withColumn("slots", slots).withColumn("slot", F.when(F.col("i") <= F.size("slots"), F.get("slots", F.col("i") - 1)))
    extra = placed.select(
        "algo_id", "uri", kind.alias("source"), "attribution",
        F.when(pinned, -1.0).otherwise(F.coalesce(F.col("slot").cast("double"), F.lit(1e12))).alias("major"),
        F.when(pinned, F.col("place")).otherwise(F.col("i")).alias("minor"),
    )
    page = base.select("algo_id", "uri", F.lit("base").alias("source"), F.lit(None).cast("string").alias("attribution"), (F.col("pos") - 0.5).alias("major"), F.lit(0).alias("minor"))
    order = Window.partitionBy("algo_id").orderBy("major", "minor", "uri")
    return page.unionByName(extra).withColumn("pos", F.row_number().over(order)).select("algo_id", "pos", "uri", "source", "attribution")


def injected_counts(pages: DataFrame) -> DataFrame:
    """By feed: pinned, rotating and sponsored posts on the page."""
    return pages.groupBy("algo_id").agg(*(F.count_if(F.col("source") == k).alias(f"n_{k}") for k in ("pinned", "rotating", "sponsored")))


def with_placeholder(pages: DataFrame, users: DataFrame, uri: str) -> DataFrame:
    """pages (algo_id, user_id, pos, uri, source) with one placeholder post for users (algo_id, user_id) who have none."""
    bare = users.select("algo_id", "user_id").distinct().join(pages.select("algo_id", "user_id").distinct(), ["algo_id", "user_id"], "left_anti")
    return pages.unionByName(bare.select("algo_id", "user_id", F.lit(1).alias("pos"), F.lit(uri).alias("uri"), F.lit("placeholder").alias("source")))


def page_slice(pages: DataFrame, offset: int, limit: int) -> DataFrame:
    return pages.filter((F.col("pos") > offset) & (F.col("pos") <= offset + limit))


def compact(uri: Column) -> Column:
    """A post's URI as "did rkey", others as they are."""
    short = F.regexp_replace(uri, "^at://([^/]+)/[^/]+/([^/]+)$", "$1 $2")
    return F.when(uri.rlike("^at://[^/]+/[^/]+/[^/]+$"), short).otherwise(uri)


def expanded(short: Column, collection: str) -> Column:
    return F.when(short.contains(" "), F.concat(F.lit("at://"), F.split_part(short, F.lit(" "), F.lit(1)), F.lit(f"/{collection}/"), F.split_part(short, F.lit(" "), F.lit(2)))).otherwise(short)


def holdout(request_id: Column, rate: float) -> Column:
    """True for the share of requests that get no personal posts, the same at every run."""
    return seeded_unit("holdout", request_id) < rate


def fallback_reason(user: Column, n_recent: Column, failed: Column, held_out: Column, exhausted: Column) -> Column:
    """Why a page has no personal posts, null if it has: n_recent is the user's likes of today and yesterday."""
    return F.when(user.isNull(), "no_auth").when(exhausted, "exhausted").when(held_out, "holdout").when(n_recent == 0, "no_user_data").when(failed, "error")
