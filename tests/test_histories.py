"""Histories nested in chunks of a fixed size."""

import json
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rekindle.config import Config, EventLimits, Filters, Sampling
from rekindle.plans import histories as h


@pytest.fixture(scope="module")
def history():
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(1, k, start + timedelta(days=rng.randrange(40), hours=rng.choice([0, 1, 23])), "view") for k in range(700)]
    rows += [(2, k, start, rng.choice(["view", "home"])) for k in range(30)] + [(3, None, start, "view"), (4, 1, None, "view")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id bigint, item_id bigint, event_ts timestamp, event_type string").repartition(5)


@pytest.mark.parametrize("latest_first", [True, False])
def test_chunks_follow_one_order(spark, history, latest_first):
    rows = [r for r in history if r[2] is not None]
    got = defaultdict(dict)
    for r in h.chunks(frame(spark, rows), ["item_id", "event_ts", "event_type"], [F.col("event_type"), F.col("item_id")], 50, "events", latest_first).collect():
        got[r.user_id][r.chunk] = [tuple(e) for e in r.events]
    for user in (1, 2, 3):
        mine = [r[1:] for r in rows if r[0] == user]
        mine.sort(key=lambda r: ((-1 if latest_first else 1) * r[1].timestamp(), r[2], r[0] or 0))
        assert sorted(got[user]) == list(range(-(-len(mine) // 50)))
        assert [e for k in sorted(got[user]) for e in got[user][k]] == mine
        assert all(len(e) == 50 for k, e in got[user].items() if k < len(got[user]) - 1)


def test_json_chunks_of_users_in_every_history(spark, history):
    rows = [r for r in history if r[2] is not None]
    short = [r for r in rows if r[0] == 1 and r[1] < 60]
    anchors = spark.createDataFrame([(u,) for u in (1, 1, 2, 9)], "user_id bigint")
    out = h.history_json(anchors, {"long": frame(spark, rows), "short": frame(spark, short)}, chunk=50).collect()
    assert {r.user_id for r in out} == {1} and len(out) == 2 * 14
    by_chunk = {r.chunk: r for r in out}
    assert [len(json.loads(by_chunk[k].long)) for k in range(14)] == [50] * 14
    assert [by_chunk[k].short and len(json.loads(by_chunk[k].short)) for k in range(14)] == [50, 10, *[None] * 12]


def test_every_history_switched_off(spark):
    config = Config(Filters("2024-01-01", "2024-01-31"), Sampling("2024-01-20"), EventLimits(0, 0, 0, 0, 0, 5))
    purchases = spark.createDataFrame([], "user_id bigint, event_date date, site_id int")
    with pytest.raises(ValueError, match="switched off"):
        h.timeline_events(h.Tables(purchases=purchases), config)
