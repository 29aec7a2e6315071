"""Parameters of the operators. Times are seconds; `now` is always given to an operator, never read from a clock."""

from __future__ import annotations

from dataclasses import dataclass, replace

HOUR, DAY = 3600, 86400
#: Like edges live this many calendar days, today included.
RETENTION_DAYS = 8
#: The scorers' decay constant; aggregation of co-likers uses the exact logarithm of 2.
DECAY = 0.693


@dataclass(frozen=True)
class RankParams:
    """Knobs of the ranker. cap None: weights aren't capped."""

    max_user_likes: int = 500
    max_sources_per_post: int = 500
    max_total_sources: int = 10_000
    window: int = 168 * HOUR
    half_life: float = 24.0 * HOUR
    specificity_power: float = 1.0
    popularity_power: float = 1.0
    num_paths_power: float = 0.3
    result_ttl: int = 300
    max_algo_checks: int = 500
    max_seen_posts: int = 1000
    use_author_affinity: bool = False
    seed_sample_pool: int = 0
    corater_decay: float = 0.0
    min_post_likes: int = 10
    max_likers_per_post: int = 30
    min_overlap: int = 1
    max_results: int = 500
    cap: float | None = 1e-6
    normalized: bool = True
    seed: str = "0"


#: What the named presets change.
PRESETS: dict[str, dict] = {
    "default": {},
    "discovery": {"max_user_likes": 200, "half_life": 24.0 * HOUR, "specificity_power": 1.5, "popularity_power": 1.5, "max_algo_checks": 300},
    "stable": {"max_user_likes": 1000, "half_life": 168.0 * HOUR, "specificity_power": 0.5, "max_algo_checks": 750},
    "fast": {"max_user_likes": 200, "max_sources_per_post": 50, "max_total_sources": 500, "result_ttl": 600, "max_algo_checks": 200, "max_seen_posts": 500},
}
#: A request can't change these.
FIXED = frozenset({"window"})


def preset(name: str | None) -> RankParams:
    """A preset by name in any case; an unknown name is the default."""
    return RankParams(**PRESETS.get((name or "default").lower(), {}))


def merged(base: RankParams, request: dict) -> RankParams:
    """base with the request's values; None keeps a value, except use_author_affinity, which a request always sets."""
    given = {k: v for k, v in request.items() if v is not None and k not in FIXED}
    return replace(base, **given | {"use_author_affinity": bool(request.get("use_author_affinity", False))})


def preset_name(p: RankParams) -> str:
    """The preset that parameters look like."""
    if p.max_user_likes == 200 and p.specificity_power > 1.4:
        return "discovery"
    if p.max_user_likes == 1000 and p.half_life > 100 * HOUR:
        return "stable"
    return "fast" if p.max_sources_per_post == 50 and p.result_ttl > 500 else "default"


@dataclass(frozen=True)
class AuthorParams:
    """Author co-likers: a coarser walk over authors instead of posts."""

    max_authors: int = 100
    max_sources: int = 300
    max_likers: int = 100
    window: int = 168 * HOUR
    min_likes: int = 2


@dataclass(frozen=True)
class TrancheParams:
    """Fallback lists of a feed. post_time: "today" takes a post's first like of today, else now; "first_like" its first like."""

    trending_half_life: float = 6.0 * HOUR
    trending_limit: int = 1000
    popular_half_life: float = 168.0 * HOUR
    popular_min_likes: int = 10
    popular_limit: int = 500
    velocity_window: int = 6 * HOUR
    velocity_min_likes: int = 5
    velocity_limit: int = 300
    author_half_life: float = 168.0 * HOUR
    author_min_posts: int = 3
    discovery_max_likes: int = 5
    discovery_limit: int = 500
    discovery_half_life: float = 24.0 * HOUR
    retention_days: int = RETENTION_DAYS
    post_time: str = "today"


@dataclass(frozen=True)
class CandidateParams:
    preferred_age: int = 72 * HOUR
    fallback_age: int = 72 * HOUR
    minimum: int = 1000
    limit: int = 40_000
    late: int = HOUR


@dataclass(frozen=True)
class DiversityParams:
    enabled: bool = True
    per_author: int = 3
    factor: float = 0.5
    strength: float = 0.3


@dataclass(frozen=True)
class BlendParams:
    """Shares of a page by source and by how many likes a user has."""

    personalized: float = 0.8
    popular: float = 0.34
    velocity: float = 0.33
    discovery: float = 0.33
    stagger: float = 0.3
    cold_likes: int = 5
    cold_trending: float = 0.8
    warm_likes: int = 20
    warm_trending: float = 0.5


@dataclass(frozen=True)
class SuccessParams:
    """When a request counts as a success."""

    personalized_share: float = 0.6
    min_checked: int = 50
    min_scored: int = 10
    max_ms: float = 500.0
