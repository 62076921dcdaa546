"""Run configuration."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Filters:
    """Closed date range and sites of the history to read."""

    start_date: str
    end_date: str
    site_ids: tuple[int, ...] = (0,)
    min_purchases: int = 0
    sample_fraction: float = 1.0


@dataclass(frozen=True)
class EventLimits:
    """Most recent events kept per user; ``None`` keeps all of them, 0 skips the action."""

    max_purchases: int | None = None
    max_views: int | None = None
    max_searches: int | None = None
    max_watches: int | None = None
    max_home_events: int | None = None
    max_events: int | None = None


@dataclass(frozen=True)
class Sampling:
    """Anchor sampling: the reference date, a fraction of the anchors and an optional cap."""

    ref_date: str
    fraction: float = 0.1
    max_samples: int | None = None
    seed: int = 42


@dataclass(frozen=True)
class Config:
    filters: Filters
    sampling: Sampling
    limits: EventLimits = field(default_factory=EventLimits)
    collect_result_titles: bool = True


# --- fixed values ---------------------------------------------------------------------
COUNT_WINDOWS = (1, 2, 5, 7, 14, 30, 60, 90, 180, 360)
SIMILARITY_WINDOWS = (7, 14, 30, 60, 90, 180, 360)
ZSCORE_WINDOWS = (2, 7, 14, 30, 60, 90, 180, 360)
RATIO_WINDOWS = (30, 60, 90, 180, 360)
WEIGHT_WINDOWS = (2, 7, 30, 90, 180, 360)
WEIGHTS = (0.35, 0.25, 0.2, 0.1, 0.06, 0.04)
# the two alternative weight vectors used when re-deriving weighted counts offline
OFFLINE_WEIGHTS_ROUNDED = (0.1, 0.2, 0.3, 0.25, 0.15, 0.05)
OFFLINE_WEIGHTS = (0.35, 0.25, 0.2, 0.1, 0.05, 0.05)
SPLIT_FRACTIONS = (0.7, 0.1, 0.2)
SEGMENT_MIN_VIEWS = (1, 2, 5, 10)
SEGMENT_WINDOWS = (30, 90, 180, 360)
PROFILE_QUANTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
# --------------------------------------------------------------------------------------
