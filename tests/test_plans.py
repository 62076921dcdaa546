"""Matrix contents and plan shapes."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from frames import anchor, event, frames, random_history
from rekindle.config import Config, EventLimits, Filters, Sampling
from rekindle.levels import ANY, LEAF, LEVELS, MID
from rekindle.operators import activity as act
from rekindle.operators import intervals
from rekindle.operators.entropy import category_counts
from rekindle.operators.joins import attach
from rekindle.operators.similarity import category_similarity
from rekindle.plans import features as feat
from rekindle.plans.histories import Tables, user_timeline
from rekindle.session import cut_lineage
from rekindle.sources.supplied import Supplied

SMALL = feat.FeatureGrid(
    count_windows=(2, 7), amount_windows=(7,), similarity_windows=(7,), zscore_windows=(7,), norm_windows=(2, 7), ratio_windows=(7,),
    weight_windows=(2, 7), weights=(0.6, 0.4),
)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def named(df):
    for lv in LEVELS:
        df = df.withColumn(lv.label, F.concat(F.lit(f"{lv.name} thing "), F.col(lv.id)))
    return df


def test_registry_names_are_unique_and_sized():
    assert len(feat.registry(feat.BASE_GRID)) == len(set(feat.registry(feat.BASE_GRID))) == 990
    assert len(set(feat.registry(feat.WATCH_GRID))) == 1491


@pytest.mark.parametrize("ref", [None, "2024-01-20"])
def test_matrix_holds_the_registry_and_every_anchor(spark, ref):
    history = random_history(31)
    starts = [anchor(u, c, "2024-01-20") for u, c in {(e[0], e[1]) for e in history}] + [anchor(77, 5, "2024-01-20")]
    events, anchors = frames(spark, history, starts)
    matrix = feat.feature_matrix(named(anchors), named(events), SMALL, ref).cache()
    assert {c for c in matrix.columns if c.startswith("f_")} == set(feat.registry(SMALL))
    assert matrix.count() == len(starts)
    # spot check two families against their own functions
    for name, single in (
        (act.count_name("view", LEAF, 7), act.count_windows(anchors, events, LEAF, "view", [7])),
        (intervals.since_names(LEAF)["views"], intervals.views_since_last_purchase(
            anchors, events.where("event_type = 'purchase'"), events.where("event_type = 'view'"), LEAF)),
    ):
        assert {(r.user_id, r.leaf_id): r[name] for r in matrix.collect()} == {(r.user_id, r.leaf_id): r[name] for r in single.collect()}
    lookup = feat.level_names(named(events).select(*[c for lv in LEVELS for c in (lv.id, lv.label)]))
    by_id = feat.feature_matrix(anchors, events, SMALL, ref, lookup)
    cols = [F.round(c, 9).alias(c) if t == "double" else c for c, t in by_id.dtypes]
    assert sorted(map(str, by_id.select(*cols).collect())) == sorted(map(str, matrix.select(*cols).collect()))


def test_needs_are_closed_and_small():
    names = [act.norm_name("view", LEAF, 7), act.weighted_name("purchase", MID), act.ratio_name("view", "purchase", LEAF, 30), act.recency_name("view", MID)]
    needs = feat.Needs(feat.BASE_GRID, names)
    assert needs.levels() == (LEAF, MID)
    assert needs.spec() == act.ActivitySpec({"purchase": (2, 7, 30, 90, 180, 360), "view": (7, 30)}, ("view",), {})
    assert needs.columns(MID) == [(act.weighted_name("purchase", ANY), names[1]), (act.recency_name("view", ANY), names[3])]
    with pytest.raises(ValueError, match="f_unheard_of"):
        feat.Needs(feat.BASE_GRID, ["f_unheard_of"])


@pytest.mark.parametrize("ref", [None, "2024-01-20"])
def test_named_columns_equal_those_of_the_matrix(spark, ref):
    history = random_history(35, n=250)
    starts = [anchor(u, c, "2024-01-20") for u, c in {(e[0], e[1]) for e in history}]
    events, anchors = frames(spark, history, starts)
    names = sorted(feat.registry(SMALL))
    whole = {(r.user_id, r.leaf_id): r.asDict() for r in feat.feature_matrix(named(anchors), named(events), SMALL, ref).collect()}
    for part in (names[::9], [n for n in names if "sim_in_last" in n][::11], [act.zscore_name("view", LEAF, 7)], [n for n in names if "between" in n][:1]):
        out = feat.feature_matrix(named(anchors), named(events), SMALL, ref, columns=part)
        assert [c for c in out.columns if c.startswith("f_")] and {c for c in out.columns if c.startswith("f_")} == set(part)
        rows = {(r.user_id, r.leaf_id): r.asDict() for r in out.collect()}
        assert rows.keys() == whole.keys()
        for key, r in rows.items():
            assert {c: r[c] for c in part} == pytest.approx({c: whole[key][c] for c in part}, nan_ok=True)


def test_named_plan_holds_only_what_is_asked(spark, supplied):
    names = [act.count_name("view", LEAF, n) for n in (1, 7)] + [act.norm_name("view", LEAF, 7)]
    spark.conf.set("spark.sql.debug.maxToStringFields", "5000")
    plan = plan_of(feat.feature_matrix(reference_anchors(supplied), supplied.actions(), feat.BASE_GRID, "2024-01-20", columns=names))
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "n_view_7" in plan and re.search(r"event_type#\d+ = view", plan)
    assert not re.search(r"n_view_(2|5|14|30|60|90|180|360)\b|purchase_|last_view|_sim_|entropy|top_cat", plan)


def test_shares_are_shares(spark):
    history = random_history(32)
    events, anchors = frames(spark, history, [anchor(e[0], e[1], e[5]) for e in history if e[4] == "click"])
    bad = act.normalised_counts(anchors, events, LEAF, "view", [7]).where("NOT (f_norm_num_views_from_leaf_cat_in_last_7_days BETWEEN 0 AND 1 OR f_norm_num_views_from_leaf_cat_in_last_7_days = -1)")
    assert bad.count() == 0


@pytest.fixture(scope="module")
def supplied(spark):
    return Supplied(spark, "/root/testdata/sf0.001")


def reference_anchors(t):
    return t.purchases().select("user_id", "leaf_id", "mid_id", "top_id").distinct().withColumn("event_ts", F.lit("2024-01-20").cast("timestamp"))


def test_count_grid_plan(spark, supplied):
    """All windows, levels and actions in a handful of shuffles, without Python or pair joins."""
    grid = feat.counts_only((1, 2, 5, 7, 14), ("purchase", "view"))
    plan = plan_of(feat.feature_matrix(reference_anchors(supplied), supplied.actions(), grid, "2024-01-20"))
    assert not re.search(r"Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert plan.count("Exchange hashpartitioning") <= 12
    wide = feat.counts_only((1, 2, 5, 7, 14, 21, 28), ("purchase", "view", "click"))
    more = plan_of(feat.feature_matrix(reference_anchors(supplied), supplied.actions(), wide, "2024-01-20"))
    assert more.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning")


def test_date_range_reaches_the_scan(spark, supplied):
    spec = act.ActivitySpec(counts={"view": (7,)})
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        act.level_activity(reference_anchors(supplied), supplied.actions(), LEAF, spec, "2024-01-20").explain("formatted")
    pushed, columns = next(m for m in re.findall(r"PushedFilters: (.*)\nReadSchema: (.*)", out.getvalue()) if "event_type,view" in m[0])
    assert "GreaterThanOrEqual(ts,2024-01-13" in pushed and "LessThan(ts,2024-01-20" in pushed
    assert "value" not in columns


def test_events_are_combined_before_the_shuffle(spark, supplied):
    plan = plan_of(act.level_activity(reference_anchors(supplied), supplied.actions(), LEAF, act.ActivitySpec(counts={"view": (7,)}), "2024-01-20"))
    assert "partial_count" in plan and plan.count("Exchange hashpartitioning") <= 4


@pytest.mark.parametrize("build", [
    lambda a, e: act.level_activity(a, e, LEAF, act.ActivitySpec({"view": (7, 14)}, ("view",), {"purchase": (7,)})),
    lambda a, e: act.user_totals(a, e, {"view": (7, 14)}),
    lambda a, e: category_counts(a, e, LEAF, ["view"]),
])
def test_many_days_pair_no_days(spark, supplied, build):
    """Windows over many anchor days are range frames; the one join only drops keys without anchors."""
    anchors = supplied.actions().where("event_type = 'click'").select("user_id", "leaf_id", "mid_id", "top_id", "event_ts")
    plan = plan_of(build(anchors, supplied.actions()))
    assert "RangeFrame" in plan
    assert not re.search(r"Join.*Inner|CartesianProduct|BroadcastNestedLoopJoin|Python", plan)


def test_interval_plan_has_no_pair_join(spark, supplied):
    e = supplied.actions()
    out = intervals.views_between_purchases(reference_anchors(supplied), e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), LEAF)
    assert not re.search(r"Python|CartesianProduct|BroadcastNestedLoopJoin", plan_of(out))


def test_unbounded_nesting_is_refused(spark):
    config = Config(Filters("2024-01-01", "2024-01-31"), Sampling("2024-01-20"), EventLimits(max_views=None, max_events=None))
    with pytest.raises(ValueError):
        user_timeline(Tables(), config)


def test_stored_features_are_not_broadcast(spark):
    """A stored frame of equal values is a small file; its size in memory grows with the users."""
    history = random_history(41, n=60)
    _, anchors = frames(spark, history, [anchor(e[0], e[1], "2024-01-20") for e in history])
    stored = cut_lineage(anchors.select("user_id", "leaf_id", F.to_date("event_ts").alias("anchor_day"), F.lit(-1.0).alias("f_x")).distinct())
    assert "Broadcast" not in plan_of(attach(cut_lineage(anchors), stored, LEAF, {}))


def test_families_by_category_read_the_anchors_own_events(spark, monkeypatch):
    read = []
    monkeypatch.setattr(feat, "moments", lambda bought, viewed, level, whole=feat.moments: read.extend((bought, viewed)) or whole(bought, viewed, level))
    history = [event(u, c, k, f"2024-01-0{d}") for u in (1, 2) for c in (3, 70) for k in ("purchase", "view") for d in (1, 2)]
    events, anchors = frames(spark, history, [anchor(1, 3, "2024-01-20")])
    assert feat.feature_matrix(named(anchors), named(events), SMALL, "2024-01-20").count() == 1
    assert {(r.user_id, r.level, r.any_id) for df in read for r in df.collect()} == {(1, "leaf", 3), (1, "mid", 0), (1, "top", 0)}


def test_similarity_percentiles_come_from_ranks(spark):
    history = random_history(43, n=60)
    events, anchors = frames(spark, history, [anchor(e[0], e[1], "2024-01-20") for e in history])
    plan = plan_of(category_similarity(named(anchors), named(events), LEAF, "view", [7, 14]))
    assert "percentile" not in plan and "Window" in plan


def test_wide_rows_are_grouped_as_one_value(spark):
    events, anchors = frames(spark, random_history(3), [anchor(u, leaf, "2024-01-20 00:00:00") for u in (1, 2) for leaf in (3, 5)])
    plan = feat.feature_matrix(named(anchors), named(events), SMALL, ref_date="2024-01-20")._jdf.queryExecution().optimizedPlan().toString()
    grouped = next(line for line in plan.splitlines() if "Aggregate [_of_user_id" in line)
    assert re.findall(r"THEN (\w+)#", grouped) == ["_features"] * 3


def test_rounding_of_whole_and_odd_numbers(spark):
    import math

    from queries.common import rounded

    values = [None, 0.0, -0.0, -1.0, 7.0, 1e300, -1e22, math.inf, -math.inf, math.nan, 0.1234565, -0.1234565, 2.0000004, 1 / 3, 5e-7, -4e-7]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = df.select((F.round("x", 6) + F.lit(0.0)).alias("x")).collect()
    assert list(map(repr, rounded(df).collect())) == list(map(repr, want))


def test_year_events_come_from_lines_stored_once(spark):
    from queries.joins import year_events

    lines = spark.createDataFrame([(1, 10.0, 57, "1997-12-01", "1997-12-05", 2, 30.0), (2, 5.0, 8, "1997-11-01", None, 1, 25.0)], "o_custkey long, l_extendedprice double, l_partkey long, d string, s string, l_linenumber int, l_quantity double")
    lines = lines.select("o_custkey", "l_extendedprice", "l_partkey", F.to_timestamp("d").alias("o_orderdate"), F.to_timestamp("s").alias("l_shipdate"), "l_linenumber", "l_quantity")
    got = sorted((r.user_id, r.event_type, str(r.event_ts), r.leaf_id, r.mid_id, r.top_id, r.amount) for r in year_events(lines).collect())
    assert got == [
        (1, "purchase", "1997-12-01 00:00:00", 57, 5, 1, 10.0), (1, "view", "1997-12-05 00:00:00", 57, 5, 1, 10.0), (1, "watch", "1997-12-07 00:00:00", 57, 5, 1, 10.0),
        (2, "purchase", "1997-11-01 00:00:00", 8, 0, 0, 5.0), (2, "view", "None", 8, 0, 0, 5.0),
    ]
