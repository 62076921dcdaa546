"""Category diversity of a user's past events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rekindle.levels import Level
from rekindle.operators.activity import anchor_keys, timeline
from rekindle.operators.joins import anchor_day


def entropy_name(action: str, level: Level) -> str:
    return f"f_entropy_for_{level.name}_cat_{action}s"


def category_counts(
    anchors: DataFrame,
    events: DataFrame,
    level: Level,
    actions: Sequence[str],
    scope: str = "anchor",
    repeat_anchor_rows: bool = False,
    pool_days: bool = False,
) -> DataFrame:
    """Past events per (user, category, anchor_day), one count column per action.

    ``scope="anchor"`` looks only at categories the user has an anchor in on that day, ``"all"`` at
    every category. With ``repeat_anchor_rows`` an event counts once per anchor row it precedes.
    ``pool_days`` counts per (user, category) what precedes any of the user's anchors, so an
    early anchor sees events after it.
    """
    keys = ["user_id", *level.keys]
    past = events.where(F.col("event_type").isin(list(actions)) & F.col(level.id).isNotNull())
    per_day = past.groupBy(*keys, F.to_date("event_ts").alias("event_day")).agg(
        *[F.count(F.when(F.col("event_type") == a, 1)).alias(f"n_{a}") for a in actions]
    )
    if scope == "anchor":
        sides = keys
    elif scope == "all":
        sides = ["user_id", *level.extra]
    else:
        raise ValueError(f"unknown scope {scope!r}")
    if pool_days and not repeat_anchor_rows:
        days = anchors.groupBy(*sides).agg(F.max(anchor_day()).alias("anchor_day")).withColumn("_rows", F.lit(1))
    else:
        rows = F.count(F.lit(1)) if repeat_anchor_rows else F.first(F.lit(1))
        days = anchors.groupBy(*sides, anchor_day().alias("anchor_day")).agg(rows.alias("_rows"))
    if scope == "all":  # every category of the user has a timeline with all the anchor days
        days = days.join(per_day.select(*keys).distinct(), sides).select(*keys, "anchor_day", "_rows")
    found = timeline(days, per_day, keys, lambda before: [F.sum(f"n_{a}").over(before(None)).alias(f"n_{a}") for a in actions])
    by = keys if pool_days else [*keys, "anchor_day"]
    # a category without earlier events has no counts and does not count as one
    some = found.where(F.coalesce(*[F.col(f"n_{a}") for a in actions]).isNotNull())
    return some.groupBy(*by).agg(*[F.sum(F.col(f"n_{a}") * F.col("_rows")).alias(f"n_{a}") for a in actions])


def user_entropy(counts: DataFrame, level: Level, actions: Sequence[str]) -> DataFrame:
    """Entropy in bits of each user's category shares, from counts alone, per anchor day where the counts have one.

    -sum(p log2 p) equals log2(T) - sum(c log2 c) / T, so one aggregate is enough.
    """
    day = [c for c in counts.columns if c == "anchor_day"]

    def bits(action: str) -> Column:
        n = F.col(f"n_{action}")
        total = F.sum(n)
        spread = F.log2(total) - F.sum(F.when(n > 0, n * F.log2(n)).otherwise(0.0)) / total
        return F.when(total > 0, F.round(F.abs(spread), 4))

    return counts.groupBy("user_id", *level.extra, *day).agg(*[bits(a).alias(entropy_name(a, level)) for a in actions])


def category_entropy(
    anchors: DataFrame,
    events: DataFrame,
    level: Level,
    actions: str | Sequence[str],
    scope: str = "anchor",
    repeat_anchor_rows: bool = False,
    pool_days: bool = False,
) -> DataFrame:
    """Per anchor key the user's category entropy per action before the anchor's day; -1 without past events."""
    actions = [actions] if isinstance(actions, str) else list(actions)
    found = user_entropy(category_counts(anchors, events, level, actions, scope, repeat_anchor_rows, pool_days), level, actions)
    by = ["user_id", *level.extra, *([] if pool_days else ["anchor_day"])]
    return anchor_keys(anchors, level).join(found, by, "left").select(
        "user_id", *level.keys, "event_ts", *[F.coalesce(entropy_name(a, level), F.lit(-1.0)).alias(entropy_name(a, level)) for a in actions]
    )
