import pytest
from pyspark.sql import functions as F

from frames import ANCHORS, anchor, event, frames, ts
from rekindle.config import Config, EventLimits, Filters, Sampling
from rekindle.functions.hashing import stable_hash
from rekindle.operators import labels, topk

CONFIG = Config(Filters("2024-01-01", "2024-01-31"), Sampling("2024-01-20", 1.0, None), EventLimits())


def purchases(spark, rows):
    events, _ = frames(spark, rows, [])
    return events.withColumns({"event_date": F.to_date("event_ts"), "site_id": F.lit(0)})


def test_reference_day_is_neither_history_nor_label(spark):
    rows = purchases(spark, [event(1, 5, "purchase", "2024-01-20T00:00"), event(1, 5, "purchase", "2024-01-20T18:00"), event(1, 6, "purchase", "2024-01-19T23:59"),
                             event(1, 6, "purchase", "2024-01-21T00:00"), event(1, 6, "purchase", "2024-02-01T00:00")])
    sample = labels.sample_data(rows, CONFIG).collect()
    assert [(r.leaf_id, r.num_repurchases, r.label) for r in sample] == [(6, 1, 1)]


def test_label_uses_the_time_of_day(spark):
    rows = purchases(spark, [event(1, 5, "purchase", "2024-01-22T10:00"), event(1, 5, "purchase", "2024-01-22T12:00"), event(1, 5, "purchase", "2024-01-23T01:00")])
    anchors = spark.createDataFrame([anchor(1, 5, t) for t in ("2024-01-22T10:00", "2024-01-22T09:59", "2024-01-23T01:00")], ANCHORS)
    got = {str(r.event_ts): r.num_repurchases for r in labels.label_repurchases(anchors, rows, CONFIG).collect()}
    assert got == {"2024-01-22 10:00:00": 2, "2024-01-22 09:59:00": 3, "2024-01-23 01:00:00": 0}


def test_reinterest_label_leaves_other_nulls_alone(spark):
    rows = spark.createDataFrame([(1, 5, None), (1, 6, 2.0)], "user_id bigint, leaf_id bigint, f_x double")
    views = spark.createDataFrame([(1, 5, ts("2024-01-21"))], "user_id bigint, leaf_id bigint, event_ts timestamp")
    got = {r.leaf_id: (r.f_x, r.reinterest_label) for r in labels.label_reinterest(rows, views, "2024-01-20").collect()}
    assert got == {5: (None, 1), 6: (2.0, 0)}


@pytest.mark.parametrize("limit", [0, 1, 137, 999, 1000, 5000])
def test_cap_is_exact(spark, limit):
    df = spark.range(1000).withColumnRenamed("id", "k")
    got = sorted(r.k for r in topk.take_by_hash(df, ["k"], limit, buckets=16).collect())
    want = df.orderBy(stable_hash("k"), "k").limit(limit)
    assert got == sorted(r.k for r in want.collect())


def test_split_partitions_the_rows(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    parts = [{r.k for r in p.collect()} for p in labels.hash_split(df, ["k"])]
    assert sum(map(len, parts)) == 3000 and len(set().union(*parts)) == 3000
    assert [len(p) / 3000 for p in parts] == pytest.approx([0.7, 0.1, 0.2], abs=0.03)


@pytest.mark.parametrize("ones", [0, 30, 700])
def test_downsample_balances(spark, ones):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") < ones).cast("int").alias("label"))
    got = {r.label: r["count"] for r in labels.downsample_majority(df, ["k"]).groupBy("label").count().collect()}
    smaller = min(ones, 1000 - ones)
    assert got == ({0: smaller, 1: smaller} if smaller else {})


def test_topk_keeps_k_rows_of_a_hot_user(spark):
    hot = spark.range(5000).select(F.lit(1).alias("user_id"), (F.col("id") % 700).alias("item_id"), F.timestamp_seconds(F.col("id") % 1900).alias("event_ts"))
    cold = spark.range(3).select(F.lit(2).alias("user_id"), F.col("id").alias("item_id"), F.timestamp_seconds("id").alias("event_ts"))
    both = hot.unionByName(cold)
    want = both.orderBy(F.col("event_ts").desc(), F.col("item_id").desc()).where("user_id = 1").limit(50).select("item_id", "event_ts").collect()
    for out in (
        topk.recent_topk(both, 50, tie=["item_id"]),
        topk.cohort_recent_topk(both, both, 50, tie=["item_id"]),
    ):
        rows = out.collect()
        assert sorted((r.item_id, r.event_ts) for r in rows if r.user_id == 1) == sorted((r.item_id, r.event_ts) for r in want)
        assert sum(r.user_id == 2 for r in rows) == 3
        assert set(out.columns) == {"user_id", "item_id", "event_ts"}
    assert topk.cohort_recent_topk(both, cold, 50, tie=["item_id"]).count() == 3
    assert topk.recent_topk(both, None).count() == 5003


def test_history_limit():
    assert topk.history_limit(None, None) is None
    assert topk.history_limit(5, None) == 5 and topk.history_limit(None, 7) == 7 and topk.history_limit(5, 3) == 3
    assert topk.history_limit(5, 3, parity=True) == 2


def test_shortest_value_tie_break(spark):
    rows = [(1, "c", "bb"), (1, "c", "aa"), (1, "c", "ccc"), (2, "c", None), (2, "c", "z")]
    got = topk.shortest_value(spark.createDataFrame(rows, "item_id int, attr_name string, attr_value string"), ["item_id", "attr_name"])
    assert {(r.item_id, r.attr_value) for r in got.collect()} == {(1, "aa"), (2, "z")}
