"""As-of joins of views to earlier purchases without pairing them up.

Both event kinds become one timeline of *moments*, one row per (user, category,
timestamp). The timeline is cut into time buckets. The last purchase of every bucket is
carried forward over the (few) buckets of a key, and only inside a bucket are rows put
in order. A key that holds a third of all events is thus sorted by many tasks, one per
bucket, and no view is ever paired with every purchase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rekindle.levels import Level

BUCKET_SECONDS = 3600


def moments(purchases: DataFrame, views: DataFrame, level: Level) -> DataFrame:
    """Distinct (user, category, ts) with flags for a purchase and a view at that time."""
    def side(df: DataFrame, bought: int, viewed: int) -> DataFrame:
        cols = ["user_id", *level.keys, F.col("event_ts").alias("ts")]
        return df.where(F.col(level.id).isNotNull()).select(
            *cols, F.lit(bought).alias("bought"), F.lit(viewed).alias("viewed")
        )

    both = side(purchases, 1, 0).unionByName(side(views, 0, 1))
    return both.groupBy("user_id", *level.keys, "ts").agg(
        F.max("bought").alias("bought"), F.max("viewed").alias("viewed")
    )


def _earlier(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def prior_purchase(timeline: DataFrame, level: Level, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Each distinct view time with the latest purchase time strictly before it."""
    keys = ["user_id", *level.keys]
    bucket = F.floor(F.unix_timestamp("ts") / bucket_seconds).alias("bucket")
    rows = timeline.select("*", bucket)
    bought_at = F.when(F.col("bought") == 1, F.col("ts"))
    buckets = rows.groupBy(*keys, "bucket").agg(F.max(bought_at).alias("_last"), F.max("viewed").alias("_viewed"))
    carried = F.last("_last", ignorenulls=True).over(_earlier(keys, "bucket"))
    carry = buckets.withColumn("_carried", carried).where(F.col("_viewed") == 1).drop("_last", "_viewed")
    joined = rows.join(carry.hint("merge"), [*keys, "bucket"])
    inside = F.last(bought_at, ignorenulls=True).over(_earlier([*keys, "bucket"], "ts"))
    return (
        joined.withColumn("purchase_ts", F.coalesce(inside, F.col("_carried")))
        .where((F.col("viewed") == 1) & F.col("purchase_ts").isNotNull())
        .select(*keys, F.col("ts").alias("view_ts"), "purchase_ts")
    )


def activity_days(timeline: DataFrame, level: Level) -> DataFrame:
    """View days of each (user, category).

    ``views`` distinct view times, ``purchase_day`` the latest earlier day with a purchase,
    ``last_view_day`` the previous view day. At most one row per calendar day is ordered.
    """
    keys = ["user_id", *level.keys]
    days = timeline.groupBy(*keys, F.to_date("ts").alias("day")).agg(
        F.sum("viewed").alias("views"), F.max("bought").alias("bought"), F.max(F.when(F.col("bought") == 1, F.col("ts"))).alias("_last_purchase")
    )
    w = _earlier(keys, "day")

    def latest(value: Column) -> Column:
        return F.last(value, ignorenulls=True).over(w)

    return (
        days.select(
            *keys,
            "day",
            "views",
            latest(F.when(F.col("bought") == 1, F.col("day"))).alias("purchase_day"),
            latest(F.col("_last_purchase")).alias("purchase_ts"),
            latest(F.when(F.col("views") > 0, F.col("day"))).alias("last_view_day"),
        )
        .where(F.col("views") > 0)
    )


def nearest_prior_purchase(purchases: DataFrame, views: DataFrame, level: Level) -> DataFrame:
    """Each distinct view time with the latest purchase on an earlier day, and the gap in days."""
    keys = ["user_id", *level.keys]
    days = activity_days(moments(purchases, views, level), level)
    days = days.where(F.col("purchase_day").isNotNull()).select(*keys, "day", "purchase_ts")
    seen = views.select(*keys, F.col("event_ts").alias("view_ts")).distinct().withColumn("day", F.to_date("view_ts"))
    return seen.join(days, [*keys, "day"]).select(
        *keys, "view_ts", "purchase_ts", F.datediff("view_ts", "purchase_ts").alias("days_diff")
    )


def between_purchases(purchases: DataFrame, views: DataFrame, level: Level) -> DataFrame:
    """Each distinct view time with the purchase p for which p < view <= next purchase."""
    found = prior_purchase(moments(purchases, views, level), level)
    return found.withColumn("days_diff", F.datediff("view_ts", "purchase_ts"))


def next_purchase(purchases: DataFrame, level: Level, bucket_seconds: int = 30 * 86400) -> DataFrame:
    """Distinct purchase times with the next one of the same (user, category), null for the last.

    The lead over a bucket's rows, then the first purchase of the next bucket that has one.
    """
    keys = ["user_id", *level.keys]
    bucket = F.floor(F.unix_timestamp("event_ts") / bucket_seconds).alias("bucket")
    times = purchases.select(*keys, F.col("event_ts").alias("purchase_ts"), bucket).distinct()
    firsts = times.groupBy(*keys, "bucket").agg(F.min("purchase_ts").alias("_first"))
    following = firsts.withColumn("_next", F.lead("_first", 1).over(Window.partitionBy(*keys).orderBy("bucket"))).drop("_first")
    inside = F.lead("purchase_ts", 1).over(Window.partitionBy(*keys, "bucket").orderBy("purchase_ts"))
    return times.join(following, [*keys, "bucket"]).select(
        *keys, "purchase_ts", F.coalesce(inside, F.col("_next")).alias("next_purchase_ts")
    )
