"""Feature distributions: profiles, quantiles, group means, t-test, correlation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rekindle.config import PROFILE_QUANTILES
from rekindle.functions.special import student_two_sided
from rekindle.operators.distribution import exact_quantiles, unpivot_features


def _percent(condition: Column, total: Column) -> Column:
    return F.when(total > 0, F.count(F.when(condition, 1)) / total * 100).otherwise(0.0)


def feature_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature the shares of positive, zero, -1 and other negative values, and mean/std of positives."""
    v, total = F.col("value"), F.count(F.lit(1))
    positive = F.when(v > 0, v)
    return unpivot_features(df, features).groupBy("feature").agg(
        _percent(v > 0, total).alias("pct_positive"),
        _percent(v == 0, total).alias("pct_zero"),
        _percent(v == -1, total).alias("pct_minus_one"),
        _percent((v < 0) & (v != -1), total).alias("pct_other_negative"),
        F.avg(positive).alias("mean_positive"),
        F.stddev_samp(positive).alias("std_positive"),
    )


def feature_profile_na(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """As :func:`feature_profile` over non-null values, with the share of nulls."""
    v, known, rows = F.col("value"), F.count("value"), F.count(F.lit(1))
    return unpivot_features(df, features).groupBy("feature").agg(
        _percent(v == -1, known).alias("pct_minus_one"),
        _percent(v == 0, known).alias("pct_zero"),
        _percent(v > 0, known).alias("pct_positive"),
        _percent(v.isNull(), rows).alias("pct_null"),
        F.avg(F.when(v > 0, v)).alias("mean_positive"),
    )


def feature_quantiles(
    df: DataFrame, features: Sequence[str], by: Sequence[str] = (), shares: Sequence[float] = PROFILE_QUANTILES
) -> DataFrame:
    """Shares, mean, std and exact quantiles per feature, optionally per group (label, outcome)."""
    long = unpivot_features(df, features, by)
    keys = [*by, "feature"]
    v, known = F.col("value"), F.count("value")
    basic = long.groupBy(*keys).agg(
        _percent(v == -1, known).alias("pct_minus_one"),
        _percent(v == 0, known).alias("pct_zero"),
        _percent(v > 0, known).alias("pct_positive"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
    )
    return basic.join(exact_quantiles(long, keys, shares), keys, "left")


OUTCOMES: Mapping[tuple[int, int], str] = {(1, 1): "TP", (1, 0): "FN", (0, 1): "FP", (0, 0): "TN"}


def outcome(label: str, pred: str) -> Column:
    """TP, FN, FP or TN."""
    expr = F.lit(None).cast("string")
    for (y, p), name in OUTCOMES.items():
        expr = F.when((F.col(label) == y) & (F.col(pred) == p), name).otherwise(expr)
    return expr


def outcome_quantile_gap(
    df: DataFrame, features: Sequence[str], label: str, pred: str, pair: tuple[str, str] = ("FN", "TN"), shares: Sequence[float] = PROFILE_QUANTILES
) -> DataFrame:
    """:func:`feature_quantiles` of two outcomes side by side, first minus second."""
    tagged = df.withColumn("outcome", outcome(label, pred)).where(F.col("outcome").isin(list(pair)))
    stats = feature_quantiles(tagged, features, ["outcome"], shares)
    columns = [c for c in stats.columns if c not in ("outcome", "feature")]

    def of(name: str, c: str) -> Column:
        return F.max(F.when(F.col("outcome") == name, F.col(c)))

    # at most two rows per feature
    sides = stats.groupBy("feature").agg(*[of(n, c).alias(f"{c}_{n.lower()}") for n in pair for c in columns])
    a, b = (n.lower() for n in pair)
    return sides.select("*", *[(F.col(f"{c}_{a}") - F.col(f"{c}_{b}")).alias(f"diff_{c}") for c in columns])


def group_mean_gap(df: DataFrame, features: Sequence[str], group: str, where: Column | None = None) -> DataFrame:
    """Mean and std of values above -1 for group 0 and 1, their difference and guarded ratio."""
    rows = df if where is None else df.where(where)
    long = unpivot_features(rows, features, [group]).where(F.col("value") > -1)

    def of(g: int) -> Column:
        return F.when(F.col(group) == g, F.col("value"))

    stats = long.groupBy("feature").agg(
        F.avg(of(0)).alias("mean_0"), F.stddev_samp(of(0)).alias("std_0"),
        F.avg(of(1)).alias("mean_1"), F.stddev_samp(of(1)).alias("std_1"),
    )
    return stats.select(
        "*",
        (F.col("mean_1") - F.col("mean_0")).alias("difference"),
        (F.col("mean_1") / (F.col("mean_0") + F.lit(1e-10))).alias("ratio"),
    )


def outcome_group_stats(df: DataFrame, features: Sequence[str], label: str, pred: str) -> DataFrame:
    """Mean and std of values above -1 per outcome, 3 places."""
    tagged = df.withColumn("outcome", outcome(label, pred))
    long = unpivot_features(tagged, features, ["outcome"]).where((F.col("value") > -1) & F.col("outcome").isNotNull())
    return long.groupBy("outcome", "feature").agg(
        F.round(F.avg("value"), 3).alias("mean"), F.round(F.stddev_samp("value"), 3).alias("std")
    )


def t_test(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """Two-sample t statistic with pooled variance, group 0 minus group 1, and its degrees of freedom."""
    long = unpivot_features(df, features, [group])

    def of(g: int) -> Column:
        return F.when(F.col(group) == g, F.col("value"))

    s = long.groupBy("feature").agg(
        *[f(of(g)).alias(f"{n}{g}") for g in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    )
    freedom = F.col("n0") + F.col("n1") - 2
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / freedom
    scale = F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1")))
    t = F.when(scale > 0, (F.col("m0") - F.col("m1")) / scale)
    return s.select("feature", t.alias("t_statistic"), freedom.alias("degrees_of_freedom"))


def t_test_p_values(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """:func:`t_test` with the two-sided p-value."""
    return t_test(df, features, group).withColumn("p_value", student_two_sided(F.col("t_statistic"), F.col("degrees_of_freedom")))


def label_correlation(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Pearson correlation of each feature with the label."""
    wide = df.agg(*[F.corr(F.col(f).cast("double"), F.col(label).cast("double")).alias(f) for f in features])
    return wide.unpivot([], list(features), "feature", "correlation")


def ratio_stats(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """Mean and std of derived ratio columns by group."""
    long = unpivot_features(df, columns, [group])
    return long.groupBy(group, "feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
