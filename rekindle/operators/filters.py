"""Projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def history_range(df: DataFrame, date_col: str, start: str, end: str, site_ids: Sequence[int] = ()) -> DataFrame:
    """Closed date range and, when sites are given, a site list."""
    kept = df.where((F.col(date_col) >= F.lit(start).cast("date")) & (F.col(date_col) <= F.lit(end).cast("date")))
    return kept.where(F.col("site_id").isin(list(site_ids))) if site_ids else kept


def before_reference(df: DataFrame, date_col: str, start: str, ref_date: str, site_ids: Sequence[int] = ()) -> DataFrame:
    """Half-open history: from ``start`` up to but not including the reference date."""
    kept = df.where((F.col(date_col) >= F.lit(start).cast("date")) & (F.col(date_col) < F.lit(ref_date).cast("date")))
    return kept.where(F.col("site_id").isin(list(site_ids))) if site_ids else kept


def lowercase_strings(df: DataFrame) -> DataFrame:
    """Lower every top-level string column."""
    return df.select(
        [
            F.lower(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows that lack a must-have column."""
    return df.dropna(subset=list(columns))


def nonempty_search(df: DataFrame, query: str = "query", attributes: str = "query_attrs") -> DataFrame:
    """Keep searches with a query text or attribute filters."""
    return df.where((F.coalesce(F.col(query), F.lit("")) != "") | (F.coalesce(F.col(attributes), F.lit("")) != ""))


def human_sessions(df: DataFrame, flag: str = "is_bot") -> DataFrame:
    return df.where(F.col(flag) == 0)


def clicked_impressions(
    df: DataFrame, placement: int, start: str, end: str, site_ids: Sequence[int] = (), human_flag: str = "00"
) -> DataFrame:
    """Human impressions of one placement, without a secondary id, that got a click."""
    kept = df.where(
        F.col("dt").between(start, end)
        & (F.col("bot_flag") == human_flag)
        & (F.length("secondary_id") == 0)
        & (F.col("placement") == placement)
        & (F.size("clicks") > 0)
    )
    return kept.where(F.col("site_id").isin(list(site_ids))) if site_ids else kept


def active_categories(categories: DataFrame) -> DataFrame:
    """Categories that are their own redirect target."""
    return categories.where(F.col("leaf_id") == F.col("redirect_leaf_id"))


def allowed_attributes(attrs: DataFrame, namespaces: Sequence[str], blocked: Iterable[str]) -> DataFrame:
    """Keep valid namespaces and drop block-listed attribute names."""
    return attrs.where(F.col("namespace").isin(list(namespaces)) & ~F.col("attr_name").isin(list(blocked)))


def with_amount(df: DataFrame, event_type: str) -> DataFrame:
    """Tag the action and compute amount = price x quantity."""
    return df.withColumn("event_type", F.lit(event_type)).withColumn("amount", F.col("price") * F.col("qty"))


def feature_projection(df: DataFrame, keys: Sequence[str], labels: Sequence[str] = ()) -> DataFrame:
    """Feature columns (prefix ``f_``) with the keys and labels."""
    features = [c for c in df.columns if c.startswith("f_")]
    return df.select(*keys, *features, *labels)


def active_in_leaf(df: DataFrame, column: str = "f_num_purchases_from_leaf_cat_in_last_360_days") -> DataFrame:
    """Anchors with at least one purchase in the leaf over the longest window."""
    return df.where(F.col(column) > 0)


def prefix_columns(df: DataFrame, columns: Sequence[str], prefix: str = "f_") -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in columns if not c.startswith(prefix)})


def parse_timestamp(text: Column, pattern: str = "yyyy/MM/dd HH:mm:ss") -> Column:
    return F.to_timestamp(text, pattern)
