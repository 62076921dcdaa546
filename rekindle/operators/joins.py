"""Joins of events with cohorts, dimensions, returns and features.

No broadcast hints: Catalyst broadcasts a side when its size, known from the files
or measured at run time by adaptive execution, is under
``spark.sql.autoBroadcastJoinThreshold``; a larger side is shuffled and adaptive
execution splits hot keys of the other one. Sides that grow with the users are the
exception: a stored frame of mostly equal values is a small file and yet large in memory,
so these joins ask for a merge and nothing of them passes through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rekindle.functions.hashing import salt
from rekindle.levels import Level
from rekindle.operators.filters import active_categories, lowercase_strings
from rekindle.operators.topk import first_per_key


def salted_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], salt_cols: Sequence[str], salts: int = 8, how: str = "inner"
) -> DataFrame:
    """Join in which every key of ``big`` is spread over ``salts`` tasks.

    ``small`` is repeated once per salt. The result keeps the ``_salt`` column so a
    following partial aggregate can use the same partitioning.
    """
    left = big.withColumn("_salt", salt(salts, *salt_cols))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*keys, "_salt"], how)


def cohort_semi_join(events: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """Events of the cohort's users."""
    return events.join(users.select(key), key, "left_semi")


def item_dimension(items: DataFrame, events: DataFrame, start_date: str, keys: Sequence[str] = ("item_id",)) -> DataFrame:
    """Item rows that the events need, one per key, lower-cased."""
    needed = events.select("item_id").distinct()
    kept = items.where(F.col("end_date") >= F.lit(start_date).cast("date")).join(needed, "item_id", "left_semi")
    order = [F.col("end_date").desc(), F.col("title"), F.col("leaf_id")]
    return lowercase_strings(first_per_key(kept, list(keys), order))


def category_dimension(categories: DataFrame) -> DataFrame:
    """Active categories, one row per (site, leaf)."""
    cols = ["site_id", "leaf_id", "leaf_name", "mid_id", "mid_name", "top_id", "top_name"]
    order = [F.col(c) for c in cols[2:]]
    return first_per_key(active_categories(categories).select(*cols), ["site_id", "leaf_id"], order)


def category_enrich(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Add category names and parents on (site, leaf); unknown categories drop out."""
    return df.join(category_dimension(categories), ["site_id", "leaf_id"])


def anchor_category_enrich(anchors: DataFrame, categories: DataFrame, site_id: int = 0) -> DataFrame:
    """As :func:`category_enrich` for anchors, which carry no site."""
    dim = category_dimension(categories).where(F.col("site_id") == site_id).drop("site_id")
    return anchors.join(dim, "leaf_id")


def item_enrich(
    df: DataFrame, items: DataFrame, categories: DataFrame, attributes: DataFrame, start_date: str
) -> DataFrame:
    """Item facts, category names and the attribute map (left)."""
    facts = item_dimension(items, df, start_date).select("item_id", "title", "site_id", "leaf_id")
    named = category_enrich(df.join(facts, "item_id"), categories)
    return named.join(attributes, "item_id", "left")


def exclude_returned(purchases: DataFrame, returns: DataFrame) -> DataFrame:
    """Purchases without a matching return on (item, transaction)."""
    return purchases.join(returns.select("item_id", "txn_id"), ["item_id", "txn_id"], "left_anti")


def active_users_only(anchors: DataFrame, views: DataFrame, ref_date: str) -> DataFrame:
    """Anchors of users with any view after the reference date."""
    seen = views.where(F.col("event_ts") > F.lit(ref_date).cast("timestamp")).select("user_id").distinct()
    return anchors.join(seen, "user_id", "left_semi")


def eligibility_flag(rows: DataFrame, purchases: DataFrame, flag: str = "apply_filter") -> DataFrame:
    """1 where the user bought in the leaf before, else 0."""
    bought = purchases.select("user_id", "leaf_id").distinct().withColumn(flag, F.lit(1))
    joined = rows.join(bought, ["user_id", "leaf_id"], "left")
    return joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(0)))


def anchor_day() -> Column:
    return F.to_date("event_ts")


def attach(anchors: DataFrame, features: DataFrame, level: Level | None, fills: Mapping[str, object]) -> DataFrame:
    """Left-join day-keyed features to the anchors and fill the gaps.

    ``features`` is keyed by (user, category id of ``level``, anchor_day), or by (user,
    anchor_day) when ``level`` is None. Every anchor row is kept.
    """
    keys = ["user_id", *(level.keys if level else []), "anchor_day"]
    base = anchors if "anchor_day" in anchors.columns else anchors.withColumn("anchor_day", anchor_day())
    added = [c for c in features.columns if c not in keys]
    joined = base.join(features.hint("merge"), keys, "left").select(*base.columns, *added)
    return joined.fillna({c: v for c, v in fills.items() if c in added})


def merge_stats(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], suffixes=("_0", "_1")) -> DataFrame:
    """Two summary tables side by side on ``key``, with right minus left per column."""
    a = left.select(key, *[F.col(c).alias(f"{c}{suffixes[0]}") for c in columns])
    b = right.select(key, *[F.col(c).alias(f"{c}{suffixes[1]}") for c in columns])
    diff = [(F.col(f"{c}{suffixes[1]}") - F.col(f"{c}{suffixes[0]}")).alias(f"diff_{c}") for c in columns]
    return a.join(b, key).select("*", *diff)
