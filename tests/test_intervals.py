from collections import defaultdict

import pytest

from frames import anchor, event, frames, random_history
from pyspark.sql import functions as F
from rekindle.levels import LEAF, MID
from rekindle.operators import asof, intervals


def gap(later, earlier):
    return (later.date() - earlier.date()).days


def split(events):
    return events.where(F.col("event_type") == "purchase"), events.where(F.col("event_type") == "view")


def times(history, kind, user, pos, cat):
    return sorted({e[5] for e in history if e[0] == user and e[pos] == cat and e[4] == kind})


def brute_first(p, v, when):
    first = {}
    for t in p:
        later = [x for x in v if gap(x, t) > 0]
        if later:
            d = gap(min(later), t)
            first[min(later)] = min(d, first.get(min(later), d))
    lags = [d for x, d in first.items() if gap(when, x) > 0]
    return (min(lags), max(lags), sum(lags) / len(lags)) if lags else (-1, -1, -1.0)


def brute_between(p, v, when):
    groups = defaultdict(list)
    for x in v:
        before = [t for t in p if t < x]
        if before and gap(when, x) > 0:
            groups[max(before)].append(gap(x, max(before)))
    counts = [len(g) for g in groups.values()]
    rates = [len(g) / max(g) if max(g) > 0 else 0 for g in groups.values()]
    return [f(z) if z else 0 for z in (counts, rates) for f in (min, max, lambda q: sum(q) / len(q))]


def brute_since(p, v, when):
    near = {}
    for x in v:
        before = [t for t in p if gap(x, t) > 0]
        if before and gap(when, x) > 0:
            near[x] = max(before)
    if not near:
        return 0, -1
    last = max(near.values())
    mine = [x for x, t in near.items() if t == last]
    return len(mine), max(gap(x, last) for x in mine)


@pytest.mark.parametrize("seed", [11, 12, 13])
@pytest.mark.parametrize("level, pos", [(LEAF, 1), (MID, 2)])
def test_families_match_pairing_everything(spark, seed, level, pos):
    history = random_history(seed, users=4, leaves=11, n=400)
    starts = [anchor(e[0], e[1], e[5]) for e in history if e[4] == "click"] + [anchor(99, 3, "2024-01-20")]
    events, anchors = frames(spark, history, starts)
    purchases, views = split(events)
    first = {tuple(r[:3]): tuple(r[3:]) for r in intervals.first_view_lag(anchors, purchases, views, level).collect()}
    between = {tuple(r[:3]): list(r[3:]) for r in intervals.views_between_purchases(anchors, purchases, views, level).collect()}
    since = {tuple(r[:3]): tuple(r[3:]) for r in intervals.views_since_last_purchase(anchors, purchases, views, level).collect()}
    keys = {(a[0], a[pos], a[4]) for a in starts}
    assert set(first) == set(between) == set(since) == keys
    for user, cat, when in keys:
        p, v = times(history, "purchase", user, pos, cat), times(history, "view", user, pos, cat)
        assert first[user, cat, when] == pytest.approx(brute_first(p, v, when))
        assert between[user, cat, when] == pytest.approx(brute_between(p, v, when))
        assert since[user, cat, when] == brute_since(p, v, when)


@pytest.mark.parametrize("bucket", [600, 3600, 86400 * 7])
def test_as_of_is_the_same_for_every_bucket_width(spark, bucket):
    history = random_history(21, n=600)
    events, _ = frames(spark, history, [])
    purchases, views = split(events)
    line = asof.moments(purchases, views, LEAF)
    got = {(r.user_id, r.leaf_id, r.view_ts): r.purchase_ts for r in asof.prior_purchase(line, LEAF, bucket).collect()}
    want = {}
    for user, cat in {(e[0], e[1]) for e in history}:
        p = times(history, "purchase", user, 1, cat)
        for x in times(history, "view", user, 1, cat):
            if any(t < x for t in p):
                want[user, cat, x] = max(t for t in p if t < x)
    assert got == want


def test_interval_edges(spark):
    """A view at a purchase's own time belongs to the earlier purchase; one before all purchases to none."""
    history = [
        event(1, 5, "view", "2024-01-01T10:00"),
        event(1, 5, "purchase", "2024-01-02T10:00"),
        event(1, 5, "view", "2024-01-04T10:00"),
        event(1, 5, "purchase", "2024-01-04T10:00"),
        event(1, 5, "view", "2024-01-04T12:00"),
    ]
    events, _ = frames(spark, history, [])
    purchases, views = split(events)
    got = {str(r.view_ts): str(r.purchase_ts) for r in asof.between_purchases(purchases, views, LEAF).collect()}
    assert got == {"2024-01-04 10:00:00": "2024-01-02 10:00:00", "2024-01-04 12:00:00": "2024-01-04 10:00:00"}
    nearest = {str(r.view_ts): str(r.purchase_ts) for r in asof.nearest_prior_purchase(purchases, views, LEAF).collect()}
    assert nearest == {"2024-01-04 10:00:00": "2024-01-02 10:00:00", "2024-01-04 12:00:00": "2024-01-02 10:00:00"}
    following = {str(r.purchase_ts): r.next_purchase_ts and str(r.next_purchase_ts) for r in asof.next_purchase(purchases, LEAF, 3600).collect()}
    assert following == {"2024-01-02 10:00:00": "2024-01-04 10:00:00", "2024-01-04 10:00:00": None}
