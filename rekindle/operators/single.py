"""Boosted trees on every feature by itself, all features at once.

A model of one feature gives all rows of a bin the same score, so the labels of each (feature,
bin) are all that boosting needs: one aggregate over the training rows, whatever the number of
features and rounds. The rounds then run on at most ``bins`` rows per feature, in one group each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekindle.operators.distribution import unpivot_features
from rekindle.operators.metrics import metric_columns
from rekindle.session import cut_lineage


@dataclass(frozen=True)
class BoostParams:
    """Rounds, tree depth, step and the smallest hessian of a leaf; at most ``bins`` bins with a value, and one for missing ones."""

    trees: int = 100
    depth: int = 4
    learning_rate: float = 0.1
    bins: int = 64
    min_hessian: float = 1e-6
    ridge: float = 1.0


def cut_points(long: DataFrame, bins: int) -> DataFrame:
    """(feature, cuts): ascending upper ends of the bins, from (feature, value, n).

    A feature with at most ``bins`` values has a bin for each; others are cut at quantiles of their rows.
    """
    known = long.where(F.col("value").isNotNull())
    sizes = known.groupBy("feature").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("rows"))
    tagged = known.join(sizes, "feature")
    few = tagged.where(F.col("different") <= bins).groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("cuts"))
    # a value stands for its rows: it repeats in proportion to its count, once at least
    times = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(100.0 * bins) / F.col("rows"))).cast("int")
    spread = tagged.where(F.col("different") > bins).select("feature", "value", F.explode(F.array_repeat(F.lit(0), times)))
    shares = [i / bins for i in range(1, bins + 1)]
    many = spread.groupBy("feature").agg(F.array_distinct(F.percentile_approx("value", shares, 10_000)).alias("cuts"))
    return few.unionByName(many)


def bin_counts(long: DataFrame, cuts: DataFrame) -> DataFrame:
    """(feature, bin, pos, neg) from (feature, value, pos, neg): bin 0 holds missing values, bin k the values up to the k-th cut."""
    # the cut points are a row per feature: adaptive execution broadcasts them by their size
    joined = long.join(cuts, "feature")
    last = F.size("cuts")
    place = F.size(F.filter("cuts", lambda c: c < F.col("value"))) + 1
    number = F.when(F.col("value").isNull(), 0).otherwise(F.least(place, last))
    return joined.withColumn("bin", number).groupBy("feature", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def labelled_values(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, value, pos, neg, n): the labels of each distinct value; NaN counts as missing."""
    long = unpivot_features(df, features, [label]).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    pos, neg = F.count(F.when(F.col(label) == 1, 1)), F.count(F.when(F.col(label) == 0, 1))
    return long.groupBy("feature", "value").agg(pos.alias("pos"), neg.alias("neg"), F.count(F.lit(1)).alias("n"))


def grow(pos: np.ndarray, neg: np.ndarray, params: BoostParams) -> tuple[np.ndarray, tuple[int, float]]:
    """The log-odds of each bin after all rounds, and the first tree's first split (bins left of it, gain)."""
    total = pos + neg
    prior = np.log((pos.sum() + 0.5) / (neg.sum() + 0.5))
    score = np.full(len(pos), prior)
    root = (0, 0.0)
    for k in range(params.trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = pos - total * p, total * p * (1 - p)
        g, h = (np.concatenate([[0.0], np.cumsum(x)]) for x in (gradient, hessian))
        worth = lambda a, b, g=g, h=h: (g[b] - g[a]) ** 2 / (h[b] - h[a] + params.ridge)
        leaves, spans = [(0, len(pos))], []
        for level in range(params.depth):
            spans = []
            for a, b in leaves:
                cut = np.arange(a + 1, b)
                gain = worth(a, cut) + worth(cut, b) - worth(a, b) if len(cut) else np.zeros(0)
                gain = np.where((h[cut] - h[a] >= params.min_hessian) & (h[b] - h[cut] >= params.min_hessian), gain, 0.0)
                best = int(np.argmax(gain)) if len(cut) else 0
                if len(cut) and gain[best] > 1e-12:
                    spans += [(a, a + 1 + best), (a + 1 + best, b)]
                    if k == level == 0:
                        root = a + 1 + best, float(gain[best])
                else:
                    spans.append((a, b))
            leaves = spans
        for a, b in leaves:
            score[a:b] += params.learning_rate * (g[b] - g[a]) / (h[b] - h[a] + params.ridge)
    return score, root


def fit(train: DataFrame, features: Sequence[str], label: str, params: BoostParams = BoostParams()) -> tuple[DataFrame, DataFrame]:
    """(feature, cuts) and (feature, bin, pos, neg, score, root_bin, root_gain) of the models of all features."""
    values = cut_lineage(labelled_values(train, features, label))
    cuts = cut_lineage(cut_points(values, params.bins))

    def boost(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        score, (left, gain) = grow(rows.pos.to_numpy(float), rows.neg.to_numpy(float), params)
        root = int(rows.bin.iloc[left]) if left else -1
        return rows.assign(score=score, root_bin=root, root_gain=gain)

    schema = "feature string, bin int, pos bigint, neg bigint, score double, root_bin int, root_gain double"
    return cuts, bin_counts(values, cuts).groupBy("feature").applyInPandas(boost, schema)  # at most `bins` + 1 rows each


def single_feature_models(
    train: DataFrame, evaluation: DataFrame, features: Sequence[str], label: str, params: BoostParams = BoostParams()
) -> DataFrame:
    """Metrics on ``evaluation`` of a model per single feature: confusion counts, the headline rates and ``feature``.

    A bin without training rows predicts as the nearest one below it that has some, else above it. Features
    without any known value in training have no model.
    """
    cuts, bins = fit(train, features, label, params)
    bins = cut_lineage(bins)
    seen = bin_counts(labelled_values(evaluation, features, label), cuts)
    known = bins.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("bin", "score"))).alias("known"))  # a row per bin
    below = F.filter("known", lambda b: b["bin"] <= F.col("bin"))
    score = F.coalesce(F.get(below, F.size(below) - 1)["score"], F.get("known", F.lit(0))["score"])
    hit = seen.join(known, "feature").withColumn("pred", (score > 0).cast("int"))

    def total(side: str, pred: int):
        return F.coalesce(F.sum(F.when(F.col("pred") == pred, F.col(side))), F.lit(0))

    counts = hit.groupBy("feature").agg(total("pos", 1).alias("tp"), total("neg", 1).alias("fp"), total("pos", 0).alias("fn"), total("neg", 0).alias("tn"))
    return counts.select(*metric_columns(), "feature")
