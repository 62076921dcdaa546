"""Binary classification metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rekindle.config import SEGMENT_MIN_VIEWS, SEGMENT_WINDOWS
from rekindle.levels import LEAF
from rekindle.operators.activity import count_name
from rekindle.operators.distribution import running_totals, unpivot_features, value_counts

METRICS = ("accuracy", "roc_auc", "precision_micro", "recall_micro", "precision_macro", "recall_macro")


def confusion(label: str, pred: str, inside: Column | None = None) -> dict[str, Column]:
    """Conditional counts tp, fp, fn, tn."""
    def cell(y: int, p: int) -> Column:
        hit = (F.col(label) == y) & (F.col(pred) == p)
        return F.count(F.when(hit if inside is None else hit & inside, 1))

    return {"tp": cell(1, 1), "fp": cell(0, 1), "fn": cell(1, 0), "tn": cell(0, 0)}


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _rates() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    tpr, tnr = tp / F.when(tp + fn > 0, tp + fn), tn / F.when(tn + fp > 0, tn + fp)
    accuracy = (tp + tn) / F.when(tp + fp + fn + tn > 0, tp + fp + fn + tn)
    return {
        "accuracy": accuracy,
        "roc_auc": (tpr + tnr) / 2,  # area under the three-point curve of hard predictions
        "precision_micro": accuracy,
        "recall_micro": accuracy,
        "precision_macro": (_share(tp, tp + fp) + _share(tn, tn + fn)) / 2,
        "recall_macro": (_share(tp, tp + fn) + _share(tn, tn + fp)) / 2,
    }


def binary_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row: confusion counts and the six headline metrics. AUC is null when a class is missing."""
    counts = df.agg(*[c.alias(k) for k, c in confusion(label, pred).items()])
    return counts.select(*metric_columns())


def metric_columns() -> list[Column]:
    """The confusion counts and the headline metrics, from columns tp, fp, fn and tn."""
    return [*map(F.col, ("tp", "fp", "fn", "tn")), *[c.alias(k) for k, c in _rates().items()]]


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    counts = df.agg(*[c.alias(k) for k, c in confusion(label, pred).items()])
    rows = counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(v).alias("class"), F.col(hit).alias("hit"), (F.col(hit) + F.col(extra)).alias("claimed"), (F.col(hit) + F.col(missed)).alias("support"))
                    for v, hit, extra, missed in ((0, "tn", "fn", "fp"), (1, "tp", "fp", "fn"))
                ]
            )
        )
    )
    precision, recall = _share(F.col("hit"), F.col("claimed")), _share(F.col("hit"), F.col("support"))
    f1 = F.when(F.col("hit") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return rows.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def metric_rows(metrics: DataFrame) -> DataFrame:
    """The one-row metrics as (metric, value)."""
    return metrics.unpivot([], list(METRICS), "metric", "value")


def compare_metrics(baseline: DataFrame, new: DataFrame) -> DataFrame:
    """Baseline against new per metric: difference and percent change, 3 places."""
    a = metric_rows(baseline).withColumnRenamed("value", "b")
    b = metric_rows(new).withColumnRenamed("value", "n")
    diff = F.col("n") - F.col("b")
    change = F.when(F.col("b") != 0, diff / F.col("b") * 100).otherwise(F.lit(float("inf")))
    return a.join(b, "metric").select(
        "metric",
        F.round("b", 3).alias("baseline"),
        F.round("n", 3).alias("new"),
        F.round(diff, 3).alias("absolute_difference"),
        F.round(change, 3).alias("percent_change"),
    )


def segment_metrics(
    df: DataFrame,
    label: str,
    pred: str,
    min_views: Sequence[int] = SEGMENT_MIN_VIEWS,
    windows: Sequence[int] = SEGMENT_WINDOWS,
    column=lambda days: count_name("view", LEAF, days),
) -> DataFrame:
    """Metrics of all rows and of each activity segment (at least v views in the last d days).

    One pass: every segment is a set of conditional counts. Empty segments are left out.
    """
    segments: list[tuple[str, str, Column]] = [("All", "All", F.lit(True))]
    segments += [(str(d), str(v), F.col(column(d)) >= v) for v in min_views for d in windows]
    aggs, rows = [], []
    for i, (days, views, inside) in enumerate(segments):
        cells = confusion(label, pred, inside)
        aggs += [c.alias(f"{k}_{i}") for k, c in cells.items()]
        aggs.append(F.count(F.when(inside, 1)).alias(f"n_{i}"))
        rows.append(
            F.struct(
                F.lit(days).alias("days"), F.lit(views).alias("views"), F.col(f"n_{i}").alias("observations"),
                *[F.col(f"{k}_{i}").alias(k) for k in cells], F.col("n_0").alias("all"),
            )
        )
    long = df.agg(*aggs).select(F.inline(F.array(*rows))).where(F.col("observations") > 0)
    rates = _rates()
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return long.select(
        "days", "views", "observations",
        rates["roc_auc"].alias("roc_auc"), rates["accuracy"].alias("accuracy"),
        _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"),
        (tp + fn).alias("class_1_count"), tp.alias("correct_predictions"), (tp + fp).alias("positive_predictions"),
        (F.col("observations") / F.col("all") * 100).alias("percent_of_observations"),
    )


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _class_counts(label: str) -> dict[str, Column]:
    return {
        "pos": F.count(F.when(F.col(label) == 1, 1)),
        "neg": F.count(F.when(F.col(label) == 0, 1)),
    }


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """One point per distinct score, highest first: (threshold, fpr, tpr), with the start point at infinity."""
    long = df.select(F.col(score).cast("double").alias("value"), label)
    counts = value_counts(long, [], "value", _class_counts(label))
    points = running_totals(counts, [], "value", ["pos", "neg"], descending=True)
    totals = long.agg(*[c.alias(f"all_{k}") for k, c in _class_counts(label).items()])
    start = totals.select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    # one row of totals, attached by a constant key
    keyed = points.withColumn("_k", F.lit(0)).join(totals.withColumn("_k", F.lit(0)), "_k")
    return keyed.select(
        F.col("value").alias("threshold"),
        (F.col("cum_neg") / F.col("all_neg")).alias("fpr"),
        (F.col("cum_pos") / F.col("all_pos")).alias("tpr"),
    ).unionByName(start)


def roc_area(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve; tied scores count half."""
    return feature_auc(df.select(F.col(score).alias("score"), label), ["score"], label).select(F.col("auc").alias("roc_auc"))


def feature_auc(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """AUC of every feature used alone as a score; a value near 0 or 1 points to leakage.

    A positive beats each negative with a smaller value and half of the equal ones.
    """
    long = unpivot_features(df, features, [label])
    counts = value_counts(long, ["feature"], "value", _class_counts(label))
    ranked = running_totals(counts, ["feature"], "value", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    return ranked.groupBy("feature").agg((wins / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def prediction_check(scored: DataFrame, future: DataFrame, pred: str = "pred") -> DataFrame:
    """Add ``correct``: the category comes up in the user's future exactly when predicted."""
    later = future.select("user_id", "leaf_id").distinct().withColumn("_later", F.lit(1))
    joined = scored.join(later, ["user_id", "leaf_id"], "left")
    came = F.col("_later").isNotNull()
    right = (came & (F.col(pred) == 1)) | (~came & (F.col(pred) == 0))
    return joined.withColumn("correct", right).drop("_later")
