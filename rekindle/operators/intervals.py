"""View-to-purchase interval features.

All three families look, per anchor, only at what happened before the anchor's day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekindle.levels import Level
from rekindle.operators.activity import anchor_keys
from rekindle.operators.asof import activity_days, moments, prior_purchase
from rekindle.operators.joins import anchor_day, attach, salted_join


def first_view_names(level: Level) -> dict[str, str]:
    return {s: f"f_{s}_time_since_first_view_after_purchase_in_{level.name}_cat" for s in ("min", "max", "mean")}


def between_names(level: Level) -> dict[str, str]:
    counts = {f"{s}_count": f"f_{s}_num_views_between_purchases_in_{level.name}_cat" for s in ("min", "max", "mean")}
    rates = {f"{s}_rate": f"f_{s}_views_between_purchases_per_days_in_{level.name}_cat" for s in ("min", "max", "mean")}
    return counts | rates


def since_names(level: Level) -> dict[str, str]:
    return {
        "views": f"f_num_views_since_last_purchase_in_{level.name}_cat",
        "gap": f"f_time_from_last_view_to_last_purchase_in_{level.name}_cat",
    }


def _days(anchors: DataFrame, level: Level) -> DataFrame:
    return (
        anchors.where(F.col(level.id).isNotNull())
        .select("user_id", *level.keys, anchor_day().alias("anchor_day"))
        .distinct()
    )


def day_gaps_by_day(anchors: DataFrame, days: DataFrame, level: Level) -> DataFrame:
    """First-view lags and views since the last purchase, keyed by (user, category, anchor_day).

    ``days`` comes from :func:`activity_days`: at most one row per calendar day and key.
    """
    keys = ["user_id", *level.keys]
    lag, since = first_view_names(level), since_names(level)
    known = days.where(F.col("purchase_day").isNotNull())
    # a view day answers a purchase when no other view day lies between them
    first = F.col("last_view_day").isNull() | (F.col("last_view_day") <= F.col("purchase_day"))
    known = known.withColumn("lag", F.when(first, F.datediff("day", "purchase_day")))
    joined = _days(anchors, level).join(known.hint("merge"), keys).where(F.col("day") < F.col("anchor_day"))
    # one answered view day at most per purchase day
    per_purchase = joined.groupBy(*keys, "anchor_day", "purchase_day").agg(
        F.sum("views").alias("views"), F.max("day").alias("last_day"), F.max("lag").alias("lag")
    )
    latest = F.max(F.struct("purchase_day", "views", "last_day")).alias("x")
    found = per_purchase.groupBy(*keys, "anchor_day").agg(
        latest, F.min("lag").alias(lag["min"]), F.max("lag").alias(lag["max"]), F.avg("lag").alias(lag["mean"])
    )
    return found.select(
        *keys, "anchor_day", *lag.values(), F.col("x.views").alias(since["views"]), F.datediff("x.last_day", "x.purchase_day").alias(since["gap"])
    )


def views_between_by_day(anchors: DataFrame, timeline: DataFrame, level: Level) -> DataFrame:
    """Keyed by (user, category, anchor_day); ``timeline`` comes from :func:`moments`."""
    keys = ["user_id", *level.keys]
    assigned = prior_purchase(timeline, level)
    per_day = assigned.groupBy(*keys, "purchase_ts", F.to_date("view_ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    # purchases of one hot (user, category) are spread over salts; anchors are few and narrow
    joined = salted_join(per_day, _days(anchors, level), keys, ["purchase_ts"])
    joined = joined.where(F.col("day") < F.col("anchor_day"))
    per_purchase = joined.groupBy(*keys, "anchor_day", "_salt", "purchase_ts").agg(
        F.sum("n").alias("views"), F.datediff(F.max("day"), F.to_date("purchase_ts")).alias("gap")
    )
    rate = F.when(F.col("gap") > 0, F.col("views") / F.col("gap")).otherwise(0.0)
    stat = {
        "min_count": F.min("views"), "max_count": F.max("views"), "mean_count": F.avg("views"),
        "min_rate": F.min(rate), "max_rate": F.max(rate), "mean_rate": F.avg(rate),
    }
    return per_purchase.groupBy(*keys, "anchor_day").agg(*[stat[k].alias(v) for k, v in between_names(level).items()])


def first_view_fills(level: Level) -> dict[str, object]:
    n = first_view_names(level)
    return {n["min"]: -1, n["max"]: -1, n["mean"]: -1.0}


def between_fills(level: Level) -> dict[str, object]:
    return {v: 0.0 if "mean" in k or "rate" in k else 0 for k, v in between_names(level).items()}


def since_fills(level: Level) -> dict[str, object]:
    n = since_names(level)
    return {n["views"]: 0, n["gap"]: -1}


def first_view_lag(anchors: DataFrame, purchases: DataFrame, views: DataFrame, level: Level) -> DataFrame:
    """Min, max and mean days from a purchase to the first view on a later day; -1 without any.

    A view answers only its closest purchase.
    """
    days = activity_days(moments(purchases, views, level), level)
    found = day_gaps_by_day(anchors, days, level).select("user_id", *level.keys, "anchor_day", *first_view_names(level).values())
    return attach(anchor_keys(anchors, level), found, level, first_view_fills(level)).drop("anchor_day")


def views_between_purchases(anchors: DataFrame, purchases: DataFrame, views: DataFrame, level: Level) -> DataFrame:
    """Per purchase interval the views and the views per day; min, max and mean of each."""
    found = views_between_by_day(anchors, moments(purchases, views, level), level)
    return attach(anchor_keys(anchors, level), found, level, between_fills(level)).drop("anchor_day")


def views_since_last_purchase(anchors: DataFrame, purchases: DataFrame, views: DataFrame, level: Level) -> DataFrame:
    """Views after the latest viewed-after purchase, and the longest gap in days to that purchase."""
    days = activity_days(moments(purchases, views, level), level)
    found = day_gaps_by_day(anchors, days, level).select("user_id", *level.keys, "anchor_day", *since_names(level).values())
    return attach(anchor_keys(anchors, level), found, level, since_fills(level)).drop("anchor_day")
