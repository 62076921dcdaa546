"""Anchor sampling, labels, cohorts and splits. All sampling is by key hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rekindle.config import SPLIT_FRACTIONS, Config
from rekindle.functions.hashing import stable_unit
from rekindle.operators.filters import before_reference, history_range
from rekindle.operators.topk import take_by_hash


def sample_anchors(purchases: DataFrame, config: Config) -> DataFrame:
    """A hash sample of the distinct (user, leaf) bought before the reference date."""
    f, s = config.filters, config.sampling
    past = before_reference(purchases, "event_date", f.start_date, s.ref_date, f.site_ids)
    pairs = past.select("user_id", "leaf_id").distinct()
    pairs = pairs.where(stable_unit("user_id", "leaf_id", seed=s.seed) < s.fraction)
    if s.max_samples:
        pairs = take_by_hash(pairs, ["user_id", "leaf_id"], s.max_samples, seed=s.seed)
    return pairs.withColumn("event_ts", F.lit(s.ref_date).cast("timestamp"))


def label_repurchases(anchors: DataFrame, purchases: DataFrame, config: Config) -> DataFrame:
    """Count purchases of the anchor's leaf after the reference date up to the end date.

    Purchases are reduced to daily counts; only on an anchor's own day is the time of day
    needed, and there purchases and anchors are put in order together instead of paired.
    """
    f, s = config.filters, config.sampling
    keys = ["user_id", "leaf_id"]
    later = history_range(purchases, "event_date", s.ref_date, f.end_date, f.site_ids)
    later = later.where(F.col("event_date") > F.lit(s.ref_date).cast("date"))
    later = later.select(*keys, "event_ts", F.to_date("event_ts").alias("day"))
    base = anchors.select(*keys, "event_ts").distinct().withColumn("anchor_day", F.to_date("event_ts"))

    per_day = later.groupBy(*keys, "day").agg(F.count(F.lit(1)).alias("n"))
    days = base.select(*keys, "anchor_day").distinct()
    after = days.join(per_day, keys).where(F.col("day") > F.col("anchor_day"))
    after = after.groupBy(*keys, "anchor_day").agg(F.sum("n").alias("_after"))

    # one row per distinct time of day: the purchases at that time, and whether an anchor asks there
    bought = later.select(*keys, F.col("day").alias("anchor_day"), "event_ts", F.lit(1).alias("n"), F.lit(0).alias("asked"))
    asking = base.select(*keys, "anchor_day", "event_ts", F.lit(0).alias("n"), F.lit(1).alias("asked"))
    at = bought.join(days, [*keys, "anchor_day"], "left_semi").unionByName(asking)
    at = at.groupBy(*keys, "anchor_day", "event_ts").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    following = Window.partitionBy(*keys, "anchor_day").orderBy(F.col("event_ts").desc()).rowsBetween(Window.unboundedPreceding, -1)
    same = at.withColumn("_same", F.sum("n").over(following)).where(F.col("asked") == 1).select(*keys, "event_ts", "_same")

    joined = base.join(after, [*keys, "anchor_day"], "left").join(same, [*keys, "event_ts"], "left")
    total = F.coalesce("_after", F.lit(0)) + F.coalesce("_same", F.lit(0))
    return joined.select(*keys, "event_ts", total.cast("bigint").alias("num_repurchases"), (total > 0).cast("int").alias("label"))


def sample_data(purchases: DataFrame, config: Config) -> DataFrame:
    """Sampled anchors with their repurchase label."""
    return label_repurchases(sample_anchors(purchases, config), purchases, config)


def label_reinterest(rows: DataFrame, views: DataFrame, ref_date: str, label: str = "reinterest_label") -> DataFrame:
    """1 when the user views the leaf after the reference date, else 0; other nulls stay."""
    seen = views.where(F.col("event_ts") > F.lit(ref_date).cast("timestamp")).select("user_id", "leaf_id").distinct()
    joined = rows.join(seen.withColumn(label, F.lit(1)).hint("merge"), ["user_id", "leaf_id"], "left")
    return joined.withColumn(label, F.coalesce(F.col(label), F.lit(0)))


def category_priors(purchases: DataFrame, config: Config) -> DataFrame:
    """Mean purchases per repeat buyer of each leaf."""
    f, s = config.filters, config.sampling
    past = before_reference(purchases, "event_date", f.start_date, s.ref_date, f.site_ids)
    per_user = past.groupBy("user_id", "leaf_id").agg(F.count("event_ts").alias("num_purchases"))
    repeat = per_user.where(F.col("num_purchases") > 1)
    return repeat.groupBy("leaf_id").agg(F.avg("num_purchases").alias("exp_num_repurchases"))


def select_cohort(purchases: DataFrame, config: Config) -> DataFrame:
    """A hash sample of the users with enough purchases in the date range."""
    f = config.filters
    counts = history_range(purchases, "event_date", f.start_date, f.end_date, f.site_ids)
    counts = counts.groupBy("user_id").agg(F.count("event_date").alias("n"))
    users = counts.where(F.col("n") >= f.min_purchases).select("user_id")
    return users.where(stable_unit("user_id", seed=config.sampling.seed) < f.sample_fraction)


def with_split(
    df: DataFrame, keys: Sequence[str], fractions: Sequence[float] = SPLIT_FRACTIONS, seed: int = 42, column: str = "split"
) -> DataFrame:
    """Assign each row to train, validation or test by its key hash."""
    total = sum(fractions)
    train, valid = fractions[0] / total, (fractions[0] + fractions[1]) / total
    u = stable_unit(*keys, seed=seed)
    return df.withColumn(column, F.when(u < train, "train").when(u < valid, "validation").otherwise("test"))


def hash_split(df: DataFrame, keys: Sequence[str], fractions: Sequence[float] = SPLIT_FRACTIONS, seed: int = 42) -> tuple[DataFrame, ...]:
    """Three disjoint frames that together hold every row."""
    tagged = with_split(df, keys, fractions, seed, "_split")
    return tuple(tagged.where(F.col("_split") == part).drop("_split") for part in ("train", "validation", "test"))


def downsample_majority(df: DataFrame, keys: Sequence[str], label: str = "label", seed: int = 123) -> DataFrame:
    """Keep as many rows of the larger class as the smaller class has; ``keys`` identify a row."""
    two = df.where(F.col(label).isin(0, 1))
    sizes = two.agg(*[F.count(F.when(F.col(label) == v, 1)).alias(f"_{v}") for v in (0, 1)])
    limits = sizes.select(F.explode(F.array(F.lit(0), F.lit(1))).alias(label), F.least("_0", "_1").alias("_limit"))
    return take_by_hash(two, keys, limits, within=[label], seed=seed)
