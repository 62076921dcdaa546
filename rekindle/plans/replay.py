"""Replay of logged impressions: sample, enrich, score, measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekindle.functions.hashing import stable_unit
from rekindle.operators.filters import clicked_impressions, parse_timestamp
from rekindle.operators.joins import anchor_category_enrich, eligibility_flag
from rekindle.operators.replay import replay_lift, shown_items
from rekindle.operators.topk import take_by_hash


def sample_impressions(
    log: DataFrame, items: DataFrame, placement: int, start: str, end: str,
    fraction: float = 0.1, limit: int | None = None, key: str = "impression_id", site_ids=(0,), seed: int = 42,
) -> DataFrame:
    """Sampled impressions as one row per shown item with its leaf category."""
    kept = clicked_impressions(log, placement, start, end, site_ids)
    kept = kept.where(stable_unit(key, seed=seed) < fraction)
    if limit:
        kept = take_by_hash(kept, [key], limit, seed=seed)
    rows = shown_items(kept.select("user_id", key, "shown_at", "items", "clicks", "amt7", "amt30"))
    return rows.join(items.select("item_id", "leaf_id"), "item_id")


def replay_anchors(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Impression rows as anchors: event time parsed, category names added."""
    timed = rows.withColumn("event_ts", parse_timestamp(F.col("shown_at"))).drop("shown_at")
    return anchor_category_enrich(timed, categories)


def measure(scored: DataFrame, purchases: DataFrame, pred: str = "pred") -> DataFrame:
    """Lift of suppression over the rows whose user bought in the leaf before."""
    return replay_lift(eligibility_flag(scored, purchases), pred)
