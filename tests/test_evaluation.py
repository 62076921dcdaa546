import contextlib
import io
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rekindle.operators import distribution as dist
from rekindle.operators import metrics, profiles
from rekindle.operators.replay import replay_lift

rng = np.random.default_rng(5)
SHAPES = {
    "normal": rng.normal(size=3000),
    "spike": np.where(rng.random(3000) < 0.5, -1.0, np.round(rng.exponential(3, 3000), 1)),
    "constant": np.full(50, 4.0),
    "one": np.array([2.5]),
    "heavy": np.exp(rng.normal(size=2000) * 4),
}


def long_frame(spark):
    rows = [(k, float(v)) for k, values in SHAPES.items() for v in values]
    return spark.createDataFrame(rows, "feature string, value double")


@pytest.mark.parametrize("bound", [dist.ROWS_PER_BUCKET, 300])
def test_quantiles_are_exact(spark, bound):
    shares = (0.0, 0.05, 0.25, 0.5, 0.9, 0.95, 1.0)
    got = {r.feature: list(r[1:]) for r in dist.exact_quantiles(long_frame(spark), ["feature"], shares, rows_per_bucket=bound).collect()}
    for k, v in SHAPES.items():
        assert got[k] == pytest.approx([np.quantile(v, p) for p in shares])
    whole = dist.exact_quantiles(long_frame(spark), [], (0.5,)).first()
    assert whole.p50 == pytest.approx(np.quantile(np.concatenate(list(SHAPES.values())), 0.5))


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    counts = dist.value_counts(long_frame(spark), ["feature"])
    rows = dist.running_totals(counts, ["feature"], "value", ["n"], descending, rows_per_bucket=400).collect()
    for k, v in SHAPES.items():
        values, n = np.unique(v, return_counts=True)
        want = dict(zip(values, n[::-1].cumsum()[::-1] if descending else n.cumsum()))
        assert {r.value: r.cum_n for r in rows if r.feature == k} == want


def test_buckets_are_bounded_and_grow_in_number(spark):
    """A column with one popular range, a continuous one and many copies of few values."""
    g = np.random.default_rng(8)
    columns = {"peak": np.concatenate([g.normal(size=4000) * 1e-9, g.normal(size=200) * 1e9]), "even": g.random(3000), "few": g.integers(0, 5, 20_000).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, values in columns.items() for v in values], "feature string, value double").repartition(6)
    numbers = []
    for bound in (2000, 250):
        rows = dist.range_buckets(dist.value_counts(df, ["feature"]), ["feature"], "value", bound).collect()
        sizes = {}
        for r in rows:
            sizes[tuple(r._bucket)] = sizes.get(tuple(r._bucket), 0) + 1
        assert len(rows) == 7205 and max(sizes.values()) <= bound
        numbers.append(len(sizes))
        ordered = sorted(rows, key=lambda r: (r.feature, r.value))
        assert [r._bucket for r in ordered] == sorted(r._bucket for r in rows)
    assert numbers[1] > 3 * numbers[0]


@pytest.mark.parametrize("own", [False, True])
def test_divergence_matches_numpy(spark, own):
    a, b = rng.normal(size=800), rng.normal(1, 2, size=600)
    rows = [("x", 0, float(v)) for v in a] + [("x", 1, float(v)) for v in b] + [("flat", y, 3.0) for y in (0, 1, 1)]
    out = {r.feature: r for r in dist.divergence(spark.createDataFrame(rows, "feature string, label int, value double"), "label", own_edges=own).collect()}
    span = (min(a.min(), b.min()), max(a.max(), b.max()))
    h = [np.histogram(v, bins=50, range=None if own else span, density=True)[0] for v in (a, b)]
    p, q = (x / x.sum() for x in h)
    m = (p + q) / 2

    def kl(x):
        return sum(xi * np.log(xi / mi) for xi, mi in zip(x, m) if xi > 0)

    assert out["x"].js_divergence == pytest.approx((kl(p) + kl(q)) / 2, abs=1e-3)
    assert out["x"].overlap == pytest.approx(np.minimum(*h).sum(), rel=1e-2)
    assert out["flat"].js_divergence == pytest.approx(0, abs=1e-12)


def test_auc_counts_pairs(spark):
    rows = [(int(rng.random() < 0.4), float(v)) for v in np.round(rng.normal(size=300), 1)]
    df = spark.createDataFrame(rows, "label int, score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.roc_area(df, "label", "score").first().roc_auc == pytest.approx(want)
    points = sorted((r.fpr, r.tpr) for r in metrics.roc_curve(df, "label", "score").collect())
    assert points[0] == (0, 0) and points[-1] == (1, 1)
    assert np.trapezoid([p[1] for p in points], [p[0] for p in points]) == pytest.approx(want)


def test_metrics_with_an_empty_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 0)], "label int, pred int")
    m = metrics.binary_metrics(df, "label", "pred").first()
    assert (m.tp, m.fp, m.fn, m.tn) == (0, 1, 0, 2) and m.accuracy == pytest.approx(2 / 3) and m.roc_auc is None
    report = {r["class"]: r for r in metrics.classification_report(df, "label", "pred").collect()}
    assert report[1].precision == 0 and report[1].recall == 0 and report[1].f1 == 0 and report[0].support == 3


def test_compare_with_zero_baseline(spark):
    base = spark.createDataFrame([(0.0, 0.5, 0.5, 0.5, 0.5, 0.5)], ", ".join(f"{m} double" for m in metrics.METRICS))
    new = spark.createDataFrame([(0.1, 0.6, 0.5, 0.5, 0.5, 0.5)], base.schema)
    got = {r.metric: r for r in metrics.compare_metrics(base, new).collect()}
    assert got["accuracy"].percent_change == float("inf") and got["roc_auc"].percent_change == pytest.approx(20)


def test_empty_segments_are_left_out(spark):
    df = spark.createDataFrame([(1, 1, 3), (0, 0, 0)], "label int, pred int, v int")
    rows = metrics.segment_metrics(df, "label", "pred", (1, 5), (30,), column=lambda d: "v").collect()
    assert {(r.days, r.views, r.observations) for r in rows} == {("All", "All", 2), ("30", "1", 1)}


def test_t_test_against_a_worked_example(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0, 10.0]
    df = spark.createDataFrame([(0, v) for v in a] + [(1, v) for v in b], "g int, x double")
    r = profiles.t_test_p_values(df, ["x"], "g").first()
    pooled = (3 * np.var(a, ddof=1) + 4 * np.var(b, ddof=1)) / 7
    assert r.t_statistic == pytest.approx((np.mean(a) - np.mean(b)) / np.sqrt(pooled * (1 / 4 + 1 / 5)))
    assert r.degrees_of_freedom == 7 and 0.05 < r.p_value < 0.1


def test_replay_with_nothing_eligible(spark):
    df = spark.createDataFrame([(1, 1, 1, 5.0)], "pred int, clicked int, n int, amount_7d double").withColumn("apply_filter", F.lit(0))
    r = replay_lift(df).first()
    assert r.total_items == 1 and r.eligible_items == 0 and r.ctr is None and r.click_lift_pct is None


def test_divergence_moves_bins_and_not_values(spark):
    """Values are binned where they are read: no exchange deals rows out by value."""
    df = spark.createDataFrame([("x", i % 2, float(i)) for i in range(100)], "feature string, label int, value double")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        dist.divergence(df, "label").explain()
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", out.getvalue())
    assert keys and not any("value#" in k for k in keys)
