"""Small frames for the tests."""

import random
from datetime import datetime, timedelta

EVENTS = "user_id bigint, leaf_id bigint, mid_id bigint, top_id bigint, event_type string, event_ts timestamp, amount double, item_id bigint"
ANCHORS = "user_id bigint, leaf_id bigint, mid_id bigint, top_id bigint, event_ts timestamp"


def ts(text):
    return datetime.fromisoformat(text)


def event(user, leaf, kind, when, amount=1.0):
    return (user, leaf, leaf // 10, leaf // 50, kind, ts(when) if isinstance(when, str) else when, amount, leaf)


def anchor(user, leaf, when):
    return (user, leaf, leaf // 10, leaf // 50, ts(when) if isinstance(when, str) else when)


def random_history(seed, users=6, leaves=12, days=25, n=500, hot=0.35):
    """Random events on a coarse clock, so that timestamps collide; one user is hot."""
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for _ in range(n):
        user = 1 if rng.random() < hot else rng.randint(1, users)
        leaf = 3 if rng.random() < hot else rng.randrange(leaves)
        when = start + timedelta(days=rng.randrange(days), hours=rng.choice([0, 6, 6, 7, 23]), minutes=rng.choice([0, 0, 30]))
        rows.append(event(user, leaf, rng.choice(["view", "view", "purchase", "click"]), when, round(rng.random() * 50, 2)))
    return rows


def frames(spark, events, anchors):
    return spark.createDataFrame(events, EVENTS), spark.createDataFrame(anchors, ANCHORS)
