"""From the feature matrix to balanced training and evaluation frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rekindle.config import Config
from rekindle.operators.filters import active_in_leaf, feature_projection
from rekindle.operators.joins import active_users_only
from rekindle.operators.labels import downsample_majority, hash_split, label_reinterest

KEYS = ("user_id", "leaf_id", "event_ts")


def prepare(
    matrix: DataFrame, views: DataFrame, config: Config, labels: Sequence[str] = ("label", "num_repurchases"), active_column: str | None = None
) -> DataFrame:
    """Active users, re-interest label, missing features as -1, anchors with purchases in the leaf."""
    ref = config.sampling.ref_date
    rows = label_reinterest(active_users_only(matrix, views, ref), views, ref)
    rows = feature_projection(rows, KEYS, [*labels, "reinterest_label"])
    rows = rows.fillna(-1, subset=[c for c in rows.columns if c.startswith("f_")])
    return active_in_leaf(rows, active_column) if active_column else active_in_leaf(rows)


def train_eval(rows: DataFrame, label: str = "reinterest_label", seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Balanced train, validation and test frames."""
    train, validation, test = hash_split(rows, KEYS, seed=seed)
    return downsample_majority(train, list(KEYS), label), validation, test
