import math
import re
from collections import Counter

import numpy as np
import pytest

from frames import ts
from rekindle.operators.similarity import MEASURES, STATS, similarity_name, title_similarity

ANCHORS = "user_id bigint, item_id bigint, title string, event_ts timestamp"
EVENTS = "user_id bigint, title string, event_type string, event_ts timestamp"
TITLES = ["red ring", "Red, red hat!", "blue ring", "", "?!", "green old chair", "ring", "RED RING", None, "hat of a red king"]


def tokens(t, granularity):
    words = re.sub(r"\W+", " " if granularity == "word" else "", t).lower()
    return words.split() if granularity == "word" else list(words)


def pair(a, b, granularity):
    x, y = Counter(tokens(a, granularity)), Counter(tokens(b, granularity))
    if not x or not y:
        return 0.0, 0.0
    dot = sum(n * y[t] for t, n in x.items())
    norm = math.sqrt(sum(n * n for n in x.values())) * math.sqrt(sum(n * n for n in y.values()))
    return dot / norm, len(x.keys() & y.keys()) / len(x.keys() | y.keys())


@pytest.mark.parametrize("granularity", ["word", "char"])
@pytest.mark.parametrize("ref", [None, "2024-01-20"])
def test_statistics_match_all_pairs(spark, granularity, ref):
    days = ["2024-01-20", "2024-01-19T05:00", "2024-01-14", "2024-01-13", "2024-01-12", "2024-01-06", "2024-01-05"]
    events = [(u, TITLES[(i * 3 + u) % len(TITLES)], "view", ts(days[(i * u) % len(days)])) for u in (1, 2) for i in range(40)]
    anchors = [(u, i, t, ts("2024-01-20")) for u in (1, 2, 3) for i, t in enumerate(TITLES)]
    got = title_similarity(
        spark.createDataFrame(anchors, ANCHORS), spark.createDataFrame(events, EVENTS), "view", [7, 14], granularity=granularity, ref_date=ref
    )
    rows = {(r.user_id, r.item_id): r.asDict() for r in got.collect()}
    assert len(rows) == len(anchors)
    for u, i, title, when in anchors:
        for n in (7, 14):
            seen = [e[1] for e in events if e[0] == u and e[1] is not None and 1 <= (when.date() - e[3].date()).days <= n]
            for k, m in enumerate(MEASURES):
                named = {s: rows[u, i][similarity_name(s, "title", "view", m, n)] for s in STATS}
                if not title or not seen:
                    assert set(named.values()) == {None}
                    continue
                v = np.array([pair(title, t, granularity)[k] for t in seen])
                want = {
                    "max": v.max(), "min": v.min(), "mean": v.mean(), "var": v.var(), "p25": np.percentile(v, 25), "p50": np.percentile(v, 50),
                    "p75": np.percentile(v, 75), "scoreratio": v.max() / v.min() if v.min() > 0 else 0, "poisson": v.mean() * math.exp(-v.mean()),
                }
                assert named == pytest.approx(want, abs=1e-9)
                assert 0 <= named["min"] <= named["p50"] <= named["max"] <= 1 + 1e-12
