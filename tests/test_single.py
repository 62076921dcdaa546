"""Boosted models of single features against boosting row by row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rekindle.operators import single

PARAMS = single.BoostParams(trees=6, depth=2, learning_rate=0.5, bins=16)


def by_rows(train, test, cuts, params):
    """The same trees on plain rows of (value, label): no histograms."""

    def place(v):
        return 0 if v is None else min(sum(c < v for c in cuts) + 1, len(cuts))

    rows = [(place(v), y) for v, y in train if y in (0, 1)]
    pos = sum(y for _, y in rows)
    score = {b: math.log((pos + 0.5) / (len(rows) - pos + 0.5)) for b, _ in rows}
    order = sorted(score)
    for _ in range(params.trees):
        p = {b: 1 / (1 + math.exp(-s)) for b, s in score.items()}

        def sums(bins):
            mine = [(y - p[b], p[b] * (1 - p[b])) for b, y in rows if b in bins]  # noqa: B023
            return sum(g for g, _ in mine), sum(h for _, h in mine)

        def worth(bins):
            g, h = sums(bins)
            return g * g / (h + params.ridge)

        leaves = [order]
        for _ in range(params.depth):
            nxt = []
            for leaf in leaves:
                options = [(worth(leaf[:k]) + worth(leaf[k:]) - worth(leaf), -k) for k in range(1, len(leaf))]
                gain, k = max(options, default=(0, 0))
                nxt += [leaf[:-k], leaf[-k:]] if gain > 1e-12 else [leaf]
            leaves = nxt
        for leaf in leaves:
            g, h = sums(leaf)
            for b in leaf:
                score[b] += params.learning_rate * g / (h + params.ridge)
    cells = dict.fromkeys(("tp", "fp", "fn", "tn"), 0)
    for v, y in test:
        if y in (0, 1):
            b = place(v)
            known = [k for k in order if k <= b] or order[:1]
            cells[("tn", "fn", "fp", "tp")[y + 2 * (score[known[-1]] > 0)]] += 1
    return cells


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(6)
    rows = []
    for k in range(900):
        y = rng.choice([0, 1, 1])
        few = rng.choice([None, 0, 1, 2]) if rng.random() < 0.3 else float(y * 3 + rng.randrange(4))
        wide = rng.gauss(y, 1.0) if rng.random() < 0.95 else float("nan")
        rows.append((k, few, wide, 7.0, None, y if rng.random() < 0.98 else None))
    df = spark.createDataFrame([(k, None if a is None else float(a), *r) for k, a, *r in rows], "k int, few double, wide double, flat double, none double, y int")
    return rows, df.where("k < 600"), df.where("k >= 600")


def test_metrics_equal_boosting_by_rows(spark, data):
    rows, train, test = data
    features = ["few", "wide", "flat", "none"]
    cuts = {r.feature: r.cuts for r in single.fit(train, features, "y", PARAMS)[0].collect()}
    assert cuts["few"] == sorted({float(r[1]) for r in rows[:600] if r[1] is not None}) and cuts["flat"] == [7.0]
    assert 12 <= len(cuts["wide"]) <= 16 and "none" not in cuts
    got = {r.feature: r.asDict() for r in single.single_feature_models(train, test, features, "y", PARAMS).collect()}
    assert set(got) == {"few", "wide", "flat"}
    for i, f in ((1, "few"), (2, "wide"), (3, "flat")):
        clean = [(None if r[i] is None or r[i] != r[i] else float(r[i]), r[5]) for r in rows]
        want = by_rows(clean[:600], clean[600:], cuts[f], PARAMS)
        assert {k: got[f][k] for k in want} == want, f
        assert got[f]["accuracy"] == pytest.approx((want["tp"] + want["tn"]) / sum(want.values()))


def test_the_number_of_jobs_does_not_depend_on_the_features(spark, data):
    _, train, test = data

    def jobs(features):
        context = spark.sparkContext
        group = f"single-{len(features)}"
        context.setJobGroup(group, group)
        wide = train.select("y", *[(F.col("wide") * (k + 1)).alias(f) for k, f in enumerate(features)])
        other = test.select("y", *[(F.col("wide") * (k + 1)).alias(f) for k, f in enumerate(features)])
        assert single.single_feature_models(wide, other, features, "y", PARAMS).count() == len(features)
        count = len(context.statusTracker().getJobIdsForGroup(group))
        context.setLocalProperty("spark.jobGroup.id", None)
        return count

    assert abs(jobs([f"f{k}" for k in range(12)]) - jobs(["f0"])) <= 2  # adaptive execution may add a broadcast


def test_bins_without_rows_in_training(spark):
    train = spark.createDataFrame([(float(k), k % 2) for k in (1, 3, 5, 7)] * 5 + [(2.0, None)], "x double, y int")
    test = spark.createDataFrame([(-9.0, 1), (2.0, 0), (99.0, 1), (None, 0)], "x double, y int")
    out = single.single_feature_models(train, test, ["x"], "y", PARAMS).first()
    assert out.tp + out.fp + out.fn + out.tn == 4 and np.isclose(out.accuracy, (out.tp + out.tn) / 4)
    assert single.single_feature_models(train.limit(0), test, ["x"], "y").count() == 0
