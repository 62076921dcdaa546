"""Sampling, labels, cohorts, splits, top-k, windows and set operations."""

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from queries.common import ACTIONS, CONFIG, END, ORDER_CONFIG, ORDER_LINES, REF, START, WITH_REF, query, ref_anchors, sql_hash, sql_rounded, sql_unit
from rekindle.levels import LEAF, MID
from rekindle.operators import asof, labels, topk
from rekindle.operators.attributes import item_attributes
from rekindle.operators.joins import active_users_only

PAIRS = f"""pairs AS (SELECT DISTINCT user_id, leaf_id FROM actions WHERE event_type = 'purchase' AND CAST(event_ts AS DATE) >= DATE '{START}' AND CAST(event_ts AS DATE) < DATE '{REF}')"""
SAMPLE = f"""{PAIRS}, sample AS (SELECT user_id, leaf_id, TIMESTAMP '{REF}' AS event_ts FROM pairs WHERE {sql_unit('user_id', 'leaf_id')} < 0.5
  ORDER BY {sql_hash('user_id', 'leaf_id')}, user_id, leaf_id LIMIT 800)"""
LABELLED = f"""SELECT s.user_id, s.leaf_id, s.event_ts, COUNT(e.event_ts) AS num_repurchases, CASE WHEN COUNT(e.event_ts) > 0 THEN 1 ELSE 0 END AS label
  FROM SOURCE s LEFT JOIN actions e ON e.user_id = s.user_id AND e.leaf_id = s.leaf_id AND e.event_type = 'purchase' AND e.event_ts > s.event_ts
    AND CAST(e.event_ts AS DATE) > DATE '{REF}' AND CAST(e.event_ts AS DATE) <= DATE '{END}' GROUP BY ALL"""


def _purchases(t):
    return t.purchases().withColumn("site_id", F.lit(0))


@query("l1_anchor_sample", f"WITH {ACTIONS}, {SAMPLE} SELECT * FROM sample")
def _(t):
    return labels.sample_anchors(_purchases(t), CONFIG)


@query("l2_repurchase_label", f"{WITH_REF} {LABELLED.replace('SOURCE', 'anchors')}")
def _(t):
    return labels.label_repurchases(ref_anchors(t).select("user_id", "leaf_id", "event_ts"), _purchases(t), CONFIG)


@query("l3_sample_data", f"WITH {ACTIONS}, {SAMPLE} {LABELLED.replace('SOURCE', 'sample')}")
def _(t):
    return labels.sample_data(_purchases(t), CONFIG)


@query(
    "l4_reinterest_label",
    f"""{WITH_REF} SELECT a.user_id, a.leaf_id, a.event_ts, CASE WHEN EXISTS (SELECT 1 FROM actions e WHERE e.user_id = a.user_id AND e.leaf_id = a.leaf_id
      AND e.event_type = 'view' AND e.event_ts > TIMESTAMP '{REF}') THEN 1 ELSE 0 END AS reinterest_label FROM anchors a""",
)
def _(t):
    return labels.label_reinterest(ref_anchors(t).select("user_id", "leaf_id", "event_ts"), t.views(), REF)


@query(
    "l5_category_prior",
    sql_rounded(
        f"""WITH {ORDER_LINES} SELECT leaf_id, AVG(n) AS exp_num_repurchases FROM (SELECT user_id, leaf_id, COUNT(event_ts) AS n FROM lines
          WHERE event_date >= DATE '1997-01-01' AND event_date < DATE '2000-01-01' AND site_id IN (0) GROUP BY ALL) WHERE n > 1 GROUP BY leaf_id""",
        ["exp_num_repurchases"],
    ),
)
def _(t):
    return labels.category_priors(t.order_lines(), ORDER_CONFIG)


@query(
    "l6_cohort_select",
    f"""WITH {ORDER_LINES} SELECT user_id FROM lines WHERE event_date BETWEEN DATE '1997-01-01' AND DATE '2001-12-31' AND site_id IN (0)
      AND {sql_unit('user_id')} < 0.5 GROUP BY user_id HAVING COUNT(*) >= 3""",
)
def _(t):
    half = replace(ORDER_CONFIG, filters=replace(ORDER_CONFIG.filters, sample_fraction=0.5))
    return labels.select_cohort(t.order_lines(), half)


@query(
    "l7_random_split",
    f"""{WITH_REF} SELECT user_id, leaf_id, CASE WHEN {sql_unit('user_id', 'leaf_id')} < 0.7 THEN 'train' WHEN {sql_unit('user_id', 'leaf_id')} < 0.8 THEN 'validation' ELSE 'test' END AS split FROM anchors""",
)
def _(t):
    return labels.with_split(ref_anchors(t).select("user_id", "leaf_id"), ["user_id", "leaf_id"])


@query(
    "l8_majority_downsample",
    f"""SELECT doc_id, quality FROM labels QUALIFY ROW_NUMBER() OVER (PARTITION BY quality ORDER BY {sql_hash('doc_id', seed=123)}, doc_id)
      <= (SELECT LEAST(SUM(quality), COUNT(*) - SUM(quality)) FROM labels)""",
)
def _(t):
    return labels.downsample_majority(t.table("labels").select("doc_id", "quality"), ["doc_id"], "quality")


def _recent(k):
    return f"SELECT user_id, event_id, event_ts FROM events_v QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_ts DESC, event_id DESC) <= {k}"


EVENTS = "WITH events_v AS (SELECT user_id, event_id, ts AS event_ts FROM events)"


@query("k1_recent_topk", f"{EVENTS} {_recent(10)}")
def _(t):
    events = t.actions().select("user_id", "event_id", "event_ts")
    return topk.recent_topk(events, topk.history_limit(25, 10), tie=["event_id"])


@query("k1_recent_topk_one_less", f"{EVENTS} {_recent(9)}")
def _(t):
    events = t.actions().select("user_id", "event_id", "event_ts")
    return topk.recent_topk(events, topk.history_limit(None, 10, parity=True), tie=["event_id"])


ATTRS = """attrs AS (SELECT p_partkey AS item_id, ns, n AS attr_name, v AS attr_value FROM part,
  LATERAL (VALUES ('DF', 'Brand', p_brand), ('DF', 'Type', p_type), ('DF', 'Type', p_name), ('DF', 'Size', CAST(p_size AS VARCHAR)),
                  ('DF', 'UPC', CAST(p_partkey AS VARCHAR)), ('XX', 'Note', p_name)) x(ns, n, v)),
best AS (SELECT item_id, ns, attr_name, attr_value FROM attrs QUALIFY ROW_NUMBER() OVER (PARTITION BY item_id, attr_name ORDER BY length(attr_value), attr_value) = 1)"""


@query("k2_shortest_value", f"WITH {ATTRS} SELECT item_id, attr_name, attr_value FROM best")
def _(t):
    return topk.shortest_value(t.item_attrs(), ["item_id", "attr_name"])


@query("k3_drop_duplicates_key", "SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1)")
def _(t):
    orders = t.table("orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return topk.first_per_key(orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")])


@query("k4_distinct", f"WITH {ACTIONS} SELECT DISTINCT user_id, mid_id, event_type FROM actions")
def _(t):
    return t.actions().select("user_id", "mid_id", "event_type").distinct()


@query("k5_limit", f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {sql_hash('o_orderkey')}, o_orderkey LIMIT 500")
def _(t):
    return topk.take_by_hash(t.table("orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 500)


@query(
    "k6_importance_topn",
    sql_rounded(
        "SELECT p_brand AS feature, AVG(p_retailprice) AS importance FROM part GROUP BY p_brand ORDER BY ROUND(importance, 6) DESC, feature LIMIT 20", ["importance"]
    ),
)
def _(t):
    from rekindle.operators.model import top_features

    scores = t.table("part").groupBy(F.col("p_brand").alias("feature")).agg(F.round(F.avg("p_retailprice"), 6).alias("importance"))
    return top_features(scores, 20)


@query("w1_row_number", "SELECT * FROM (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_extendedprice, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_suppkey) AS INTEGER) AS rn FROM lineitem) WHERE rn <= 2")
def _(t):
    li = t.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), "l_partkey", "l_linenumber", "l_suppkey")
    return li.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2)


@query("w2_rank", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc())
    ranked = t.table("orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("rk", F.rank().over(w))
    return ranked.where(F.col("rk") == 1).drop("rk")


@query(
    "w3_lead",
    f"""WITH {ACTIONS} SELECT user_id, mid_id, event_ts AS purchase_ts, LEAD(event_ts) OVER (PARTITION BY user_id, mid_id ORDER BY event_ts) AS next_purchase_ts
      FROM (SELECT DISTINCT user_id, mid_id, event_ts FROM actions WHERE event_type = 'purchase')""",
)
def _(t):
    return asof.next_purchase(t.purchases(), MID)


@query(
    "t1_union_by_name_padded",
    f"""WITH {ACTIONS} SELECT user_id, event_ts, amount, NULL::BIGINT AS item_id FROM actions WHERE event_type = 'purchase'
      UNION ALL SELECT user_id, event_ts, NULL::DOUBLE AS amount, item_id FROM actions WHERE event_type = 'view'""",
)
def _(t):
    return t.purchases().select("user_id", "event_ts", "amount").unionByName(t.views().select("user_id", "event_ts", "item_id"), allowMissingColumns=True)


@query("t2_union_all", f"WITH {ACTIONS} SELECT user_id, leaf_id, event_ts, event_type FROM actions WHERE event_type = 'purchase' UNION ALL SELECT user_id, leaf_id, event_ts, event_type FROM actions WHERE event_type = 'view'")
def _(t):
    cols = ["user_id", "leaf_id", "event_ts", "event_type"]
    return t.purchases().select(*cols).unionByName(t.views().select(*cols))


@query("v13_attribute_map", f"WITH {ATTRS} SELECT item_id, string_agg(lower(attr_name) || '=' || lower(attr_value), ';' ORDER BY attr_name) AS attributes FROM best WHERE ns = 'DF' AND attr_name <> 'UPC' GROUP BY item_id")
def _(t):
    maps = item_attributes(t.item_attrs(), t.items())
    joined = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return maps.select("item_id", joined.alias("attributes"))


@query(
    "j14_inactive_user_filter",
    f"{WITH_REF} SELECT user_id, leaf_id, event_ts FROM anchors WHERE user_id IN (SELECT user_id FROM actions WHERE event_type = 'view' AND event_ts > TIMESTAMP '{REF}')",
)
def _(t):
    return active_users_only(ref_anchors(t).select("user_id", "leaf_id", "event_ts"), t.views(), REF)


@query(
    "j11_nearest_prior_asof",
    f"""WITH {ACTIONS}, v AS (SELECT DISTINCT user_id, leaf_id, event_ts AS view_ts FROM actions WHERE event_type = 'view')
      SELECT *, CAST(date_diff('day', CAST(purchase_ts AS DATE), CAST(view_ts AS DATE)) AS INTEGER) AS days_diff
      FROM (SELECT v.user_id, v.leaf_id, v.view_ts, MAX(p.event_ts) AS purchase_ts FROM v JOIN actions p ON p.user_id = v.user_id AND p.leaf_id = v.leaf_id AND p.event_type = 'purchase' AND CAST(p.event_ts AS DATE) < CAST(v.view_ts AS DATE)
      GROUP BY ALL)""",
)
def _(t):
    return asof.nearest_prior_purchase(t.purchases(), t.views(), LEAF)


@query(
    "j12_between_consecutive_join",
    f"""WITH {ACTIONS}, p AS (SELECT user_id, mid_id, event_ts AS purchase_ts, COALESCE(LEAD(event_ts) OVER (PARTITION BY user_id, mid_id ORDER BY event_ts), TIMESTAMP '9999-12-31') AS nxt
        FROM (SELECT DISTINCT user_id, mid_id, event_ts FROM actions WHERE event_type = 'purchase')),
      v AS (SELECT DISTINCT user_id, mid_id, event_ts AS view_ts FROM actions WHERE event_type = 'view')
      SELECT v.user_id, v.mid_id, v.view_ts, p.purchase_ts, CAST(date_diff('day', CAST(p.purchase_ts AS DATE), CAST(v.view_ts AS DATE)) AS INTEGER) AS days_diff
      FROM v JOIN p ON p.user_id = v.user_id AND p.mid_id = v.mid_id AND v.view_ts > p.purchase_ts AND v.view_ts <= p.nxt""",
)
def _(t):
    return asof.between_purchases(t.purchases(), t.views(), MID)
