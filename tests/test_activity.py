from collections import Counter, defaultdict
from datetime import datetime, timedelta
from math import log2
from statistics import mean, stdev, variance

import pytest
from pyspark.sql import functions as F

from frames import anchor, event, frames, random_history
from rekindle.levels import ANY, LEAF, MID, all_levels
from rekindle.operators import activity as act
from rekindle.operators.entropy import category_entropy, entropy_name

WINDOWS = (1, 2, 5, 7, 14)


def age(a, e):
    return (a.date() - e.date()).days


def test_window_edges(spark):
    day = [event(1, 5, "view", w) for w in ("2024-01-20T00:00:01", "2024-01-19T23:59:59", "2024-01-13T00:00:00", "2024-01-12T23:59:59")]
    events, anchors = frames(spark, day, [anchor(1, 5, "2024-01-20T00:00:00"), anchor(1, 6, "2024-01-20T00:00:00"), anchor(2, 5, "2024-01-20T00:00:00")])
    for ref in (None, "2024-01-20"):
        out = {(r.user_id, r.leaf_id): r for r in act.count_windows(anchors, events, LEAF, "view", [1, 7, 8], ref_date=ref).collect()}
        hit = out[1, 5].asDict()
        assert [hit[act.count_name("view", LEAF, n)] for n in (1, 7, 8)] == [1, 2, 3]
        for empty in (out[1, 6], out[2, 5]):
            assert [empty.asDict()[act.count_name("view", LEAF, n)] for n in (1, 7, 8)] == [0, 0, 0]


def test_single_event_has_no_variance(spark):
    events, anchors = frames(spark, [event(1, 5, "purchase", "2024-01-15", 7.5)], [anchor(1, 5, "2024-01-20"), anchor(1, 9, "2024-01-20")])
    out = {r.leaf_id: r.asDict() for r in act.amount_stats(anchors, events, LEAF, "purchase", [7]).collect()}
    stats = ("sum", "mean", "max", "min", "var")
    assert [out[5][act.amount_name(s, LEAF, 7)] for s in stats] == [7.5, 7.5, 7.5, 7.5, -1.0]
    assert [out[9][act.amount_name(s, LEAF, 7)] for s in stats] == [0.0, 0.0, -1.0, -1.0, -1.0]


def test_ratio_and_share_sentinels(spark):
    events, anchors = frames(
        spark,
        [event(1, 5, "view", "2024-01-19"), event(1, 6, "purchase", "2024-01-19"), event(1, 7, "view", "2024-01-19"), event(1, 7, "purchase", "2024-01-19")],
        [anchor(1, leaf, "2024-01-20") for leaf in (5, 6, 7, 8)] + [anchor(2, 5, "2024-01-20")],
    )
    ratios = {(r[0], r[1]): r[3] for r in act.action_ratios(anchors, events, LEAF, ("view", "purchase"), [7]).collect()}
    assert ratios == {(1, 5): -1.0, (1, 6): 0.0, (1, 7): 1.0, (1, 8): -1.0, (2, 5): -1.0}
    shares = {(r[0], r[1]): r[3] for r in act.normalised_counts(anchors, events, LEAF, "view", [7]).collect()}
    assert shares == {(1, 5): 0.5, (1, 6): 0.0, (1, 7): 0.5, (1, 8): 0.0, (2, 5): -1.0}


def test_equal_population_scores_zero(spark):
    events, anchors = frames(spark, [event(u, 5, "view", "2024-01-19") for u in (1, 2)], [anchor(u, 5, "2024-01-20") for u in (1, 2)] + [anchor(3, 8, "2024-01-20")])
    assert {r[3] for r in act.count_zscores(anchors, events, LEAF, "view", [7]).collect()} == {0.0}


@pytest.mark.parametrize("seed", [1, 2])
def test_one_pass_equals_pair_by_pair(spark, seed):
    history = random_history(seed)
    starts = [anchor(e[0], e[1], e[5]) for e in history if e[4] == "click"]
    events, anchors = frames(spark, history, starts)
    spec = act.ActivitySpec({"view": WINDOWS, "purchase": WINDOWS}, ("view",), {"purchase": (7,)})
    for level, pos in ((LEAF, 1), (MID, 2)):
        keys = {(a[0], a[pos], a[4]) for a in starts}
        got = {(r.user_id, r[level.id], r.event_ts): r.asDict() for r in act.activity(anchors, events, level, spec).collect()}
        assert set(got) == keys
        for (user, cat, when), row in got.items():
            mine = [e for e in history if e[0] == user and e[pos] == cat and age(when, e[5]) > 0]
            for kind in ("view", "purchase"):
                counts = [sum(e[4] == kind and age(when, e[5]) <= n for e in mine) for n in WINDOWS]
                assert [row[act.count_name(kind, level, n)] for n in WINDOWS] == counts
                assert counts == sorted(counts)
            ages = [age(when, e[5]) for e in mine if e[4] == "view"]
            assert row[act.recency_name("view", level)] == (min(ages) if ages else -1)
            paid = [e[6] for e in mine if e[4] == "purchase" and age(when, e[5]) <= 7]
            want = [sum(paid), mean(paid), max(paid), min(paid)] if paid else [0, 0, -1, -1]
            want.append(variance(paid) if len(paid) > 1 else -1)
            assert [row[act.amount_name(s, level, 7)] for s in ("sum", "mean", "max", "min", "var")] == pytest.approx(want, abs=1e-9)


def test_reference_date_plan_equals_general_plan(spark):
    history = random_history(3)
    starts = [anchor(u, c, "2024-01-20") for u, c in {(e[0], e[1]) for e in history}]
    events, anchors = frames(spark, history, starts)
    spec = act.ActivitySpec({"view": WINDOWS}, ("purchase",), {"purchase": (7, 14)})
    for level in (LEAF, MID):
        a = act.activity(anchors, events, level, spec)
        b = act.activity(anchors, events, level, spec, ref_date="2024-01-20")
        rounded = [[F.round(c, 9).alias(c) if t == "double" else c for c, t in a.dtypes]] * 2
        assert sorted(a.select(*rounded[0]).collect()) == sorted(b.select(*rounded[1]).collect())
    long = act.level_activity(anchors, events, ANY, spec, ref_date="2024-01-20")
    days = act.level_activity(anchors, events, ANY, spec)
    cols = [F.round(c, 9).alias(c) if t == "double" else c for c, t in long.dtypes]
    # the general plan has no row for anchors whose events lie outside every window
    some = sum(F.col(act.count_name("view", ANY, n)) for n in WINDOWS) > 0
    assert sorted(long.where(some).select(*cols).collect()) == sorted(days.where(some).select(*cols).collect())


def test_scores_match_plain_statistics(spark):
    history = random_history(4)
    starts = [anchor(e[0], e[1], e[5]) for e in history if e[4] == "click"]
    events, anchors = frames(spark, history, starts)
    counts = {(r[0], r[1], r[2]): r[3] for r in act.count_windows(anchors, events, LEAF, "view", [7]).collect()}
    by_cat = defaultdict(list)
    for (_, cat, _), n in counts.items():
        by_cat[cat].append(n)
    for r in act.count_zscores(anchors, events, LEAF, "view", [7]).collect():
        pop = by_cat[r[1]]
        dev = stdev(pop) if len(pop) > 1 else 0
        assert r[3] == pytest.approx((counts[r[0], r[1], r[2]] - mean(pop)) / dev if dev else 0, abs=1e-9)


@pytest.mark.parametrize("repeat", [False, True])
def test_entropy(spark, repeat):
    history = random_history(5)
    starts = sorted({anchor(e[0], e[1], datetime(2024, 1, 10) + timedelta(days=e[1] % 3)) for e in history if e[4] == "click"})
    events, anchors = frames(spark, history, starts)
    got = {r[0]: r[3] for r in category_entropy(anchors, events, MID, "view", repeat_anchor_rows=repeat, pool_days=True).collect()}
    for user in {a[0] for a in starts}:
        counts = Counter()
        for e in history:
            if e[0] == user and e[4] == "view":
                hits = sum(a[0] == user and a[2] == e[2] and age(a[4], e[5]) > 0 for a in starts)
                counts[e[2]] += hits if repeat else min(hits, 1)
        total = sum(counts.values())
        want = round(abs(-sum(n / total * log2(n / total) for n in counts.values() if n)), 4) if total else -1
        assert got[user] == pytest.approx(want, abs=1e-9)
        assert want <= log2(max(len(counts), 1)) + 1e-9
    long = category_entropy(all_levels(anchors), all_levels(events), ANY, ["view", "purchase"], repeat_anchor_rows=repeat, pool_days=True)
    for r in long.where(F.col("level") == "mid").collect():
        assert r[entropy_name("view", ANY)] == got[r.user_id]


def test_entropy_sees_no_later_event(spark):
    history = random_history(6)
    starts = sorted({anchor(e[0], e[1], datetime(2024, 1, 8) + timedelta(days=3 * (e[1] % 3))) for e in history if e[4] == "click"})
    events, anchors = frames(spark, history, starts)
    rows = category_entropy(anchors, events, MID, "view").collect()
    assert {(r[0], r[1], r[2]) for r in rows} == {(a[0], a[2], a[4]) for a in starts}
    for user, _, when, value in rows:
        mine = {a[2] for a in starts if a[0] == user and a[4].date() == when.date()}
        counts = Counter(e[2] for e in history if e[0] == user and e[4] == "view" and e[2] in mine and age(when, e[5]) > 0)
        total = sum(counts.values())
        want = round(abs(-sum(n / total * log2(n / total) for n in counts.values())), 4) if total else -1
        assert value == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("ref", [None, "2024-01-20"])
def test_variance_does_not_cancel(spark, ref):
    """Large amounts that differ little, in one leaf, over leaves, over days and next to small ones."""
    base = 1e8
    history = [event(1, 5, "purchase", "2024-01-15", base + k) for k in range(3)]
    history += [event(2, 5 + k, "purchase", "2024-01-15", base + k) for k in range(3)]
    history += [event(3, 5, "purchase", f"2024-01-{14 + k}", base + k) for k in range(3)]
    history += [event(4, 5, "purchase", "2024-01-15", 1e-3 * k) for k in range(3)] + [event(4, 6, "purchase", "2024-01-16", base + k) for k in range(3)]
    history += [event(1, 5, "purchase", "2023-12-01", 1.0), event(5, 5, "purchase", "2024-01-15", base)]
    events, anchors = frames(spark, history, [anchor(u, 5, "2024-01-20") for u in range(1, 6)])
    for level in (LEAF, MID, ANY):
        out = act.level_activity(anchors, events, level, act.ActivitySpec(amounts={"purchase": (7, 60)}), ref)
        name = act.amount_name("var", level, 7)
        got = {(r.user_id, *([r.level] if level == ANY else [])): r.asDict() for r in out.collect()}
        for tag in ([()] if level != ANY else [("leaf",), ("mid",), ("top",)]):
            leaf = level == LEAF or tag == ("leaf",)
            assert got[1, *tag][name] == 1.0
            assert got[2, *tag][name] == (-1.0 if leaf else 1.0)
            assert got[3, *tag][name] == 1.0
            amounts = [1e-3 * k for k in range(3)] + ([] if leaf else [base + k for k in range(3)])
            assert got[4, *tag][name] == pytest.approx(variance(amounts), rel=1e-12)
            assert got[5, *tag][name] == -1.0
            longer = got[1, *tag][act.amount_name("var", level, 60)]
            assert longer == pytest.approx(variance([base, base + 1, base + 2, 1.0]), rel=1e-12)


def test_population_deviation_does_not_cancel(spark):
    rows = [(u, 5, datetime(2024, 1, 20), 10**8 + u, 1 + u % 2) for u in range(3)]
    df = spark.createDataFrame(rows, "user_id bigint, leaf_id bigint, event_ts timestamp, n bigint, times bigint")
    assert act.population_stats(df, LEAF, ["n"]).first()._dev_0 == 1.0
    weighted = act.population_stats(df, LEAF, ["n"], "times").first()
    assert weighted._dev_0 == pytest.approx(stdev([0, 1, 1, 2])) and weighted._mean_0 == 10**8 + 1


def test_a_user_with_many_days(spark):
    """3,000 days of events and anchors of one key: one timeline of 6,000 rows."""
    start = datetime(2015, 1, 1)
    history = [event(1, 5, "view" if d % 3 else "purchase", start + timedelta(days=d, hours=5), float(d % 11)) for d in range(3000)]
    events, anchors = frames(spark, history, [anchor(1, 5, start + timedelta(days=d, hours=1)) for d in range(0, 3000, 2)])
    spec = act.ActivitySpec({"view": (7, 30)}, ("purchase",), {"purchase": (30,)})
    got = {r.event_ts: r.asDict() for r in act.activity(anchors, events, LEAF, spec).collect()}
    assert len(got) == 1500
    for d in (0, 2, 4, 100, 1500, 2998):
        r = got[start + timedelta(days=d, hours=1)]
        earlier = range(d)
        assert [r[act.count_name("view", LEAF, n)] for n in (7, 30)] == [sum(k % 3 > 0 for k in earlier if d - k <= n) for n in (7, 30)]
        bought = [k for k in earlier if k % 3 == 0]
        assert r[act.recency_name("purchase", LEAF)] == (d - max(bought) if bought else -1)
        near = [float(k % 11) for k in bought if d - k <= 30]
        assert r[act.amount_name("var", LEAF, 30)] == pytest.approx(variance(near) if len(near) > 1 else -1.0)
