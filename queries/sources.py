"""Sources, sinks, projections and filters."""

from pyspark.sql import functions as F

from queries.common import (
    ACTIONS, CATEGORIES, ITEMS, ORDER_LINES, REF, WITH_REF, query, ref_anchors, sql_hash, sql_rounded, sql_unit,
)
from rekindle.levels import LEAF
from rekindle.operators import filters as flt
from rekindle.operators.activity import count_windows
from rekindle.operators.joins import category_dimension
from rekindle.session import shared_folder
from rekindle.sources import catalog


@query(
    "a1_catalog_scan",
    "SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_quantity > 40",
)
def _(t):
    where = (F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp")) & (F.col("l_quantity") > 40)
    return catalog.catalog_scan(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity", "l_shipdate"], where)


@query("a2_save_table", "SELECT o_custkey, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) + 0.0 AS spent FROM orders GROUP BY o_custkey")
def _(t):
    totals = t.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return catalog.save_table(totals, "customer_totals")


@query("a3_parquet_sink", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def _(t):
    return catalog.write_parquet(t.table("orders").select("o_orderkey", "o_custkey", "o_orderdate"), shared_folder(t.spark), 5000)


@query(
    "a4_parquet_matrix_io",
    f"""{WITH_REF} SELECT a.user_id, a.leaf_id, a.event_ts,
      COUNT(CASE WHEN date_diff('day', CAST(e.event_ts AS DATE), DATE '{REF}') BETWEEN 1 AND 14 THEN 1 END) AS f_num_views_from_leaf_cat_in_last_14_days
      FROM anchors a LEFT JOIN actions e ON e.user_id = a.user_id AND e.leaf_id = a.leaf_id AND e.event_type = 'view'
      GROUP BY ALL""",
)
def _(t):
    matrix = count_windows(ref_anchors(t), t.actions(), LEAF, "view", [14], ref_date=REF)
    path = shared_folder(t.spark)
    catalog.save_matrix(matrix, path)
    return catalog.load_matrix(t.spark, path)


@query(
    "a5_csv_extract",
    f"""{WITH_REF}, {ITEMS}, picked AS (
      SELECT user_id, leaf_id FROM anchors WHERE {sql_unit('user_id', 'leaf_id')} < 0.3
      ORDER BY {sql_hash('user_id', 'leaf_id')}, user_id, leaf_id LIMIT 300)
      SELECT 'event' AS part, e.event_id, e.user_id, NULL AS leaf_id, e.item_id, e.event_type, i.image_url FROM actions e JOIN items i USING (item_id)
      WHERE e.user_id IN (SELECT user_id FROM picked)
      UNION ALL SELECT 'row', NULL, user_id, leaf_id, NULL, NULL, NULL FROM picked""",
)
def _(t):
    events = t.actions().select("event_id", "user_id", "item_id", "event_type")
    rows = ref_anchors(t).select("user_id", "leaf_id")
    picked, mine = catalog.demo_extract(rows, events, t.items(), 0.3, 300, ["user_id", "leaf_id"])
    both = mine.withColumn("part", F.lit("event")).unionByName(picked.withColumn("part", F.lit("row")), allowMissingColumns=True)
    return catalog.write_csv(both.select("part", "event_id", "user_id", "leaf_id", "item_id", "event_type", "image_url"), shared_folder(t.spark))


@query(
    "b1_history_range_filter",
    f"WITH {ORDER_LINES} SELECT user_id, item_id, txn_id, line, event_date FROM lines WHERE event_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' AND site_id IN (0)",
)
def _(t):
    kept = flt.history_range(t.order_lines(), "event_date", "1998-01-01", "1999-12-31", [0])
    return kept.select("user_id", "item_id", "txn_id", "line", "event_date")


@query(
    "b2_half_open_history",
    f"WITH {ORDER_LINES} SELECT user_id, item_id, txn_id, line, event_date FROM lines WHERE event_date >= DATE '1998-01-01' AND event_date < DATE '1999-12-31' AND site_id IN (0, 3)",
)
def _(t):
    kept = flt.before_reference(t.order_lines(), "event_date", "1998-01-01", "1999-12-31", [0, 3])
    return kept.select("user_id", "item_id", "txn_id", "line", "event_date")


@query("b3_lowercase_strings", "SELECT p_partkey, lower(p_name) AS p_name, lower(p_brand) AS p_brand, lower(p_type) AS p_type, p_size FROM part")
def _(t):
    return flt.lowercase_strings(t.table("part").drop("p_retailprice"))


SEARCHES = f"""searches AS (
  SELECT e.user_id, e.leaf_id, 0 AS site_id, CAST(e.event_ts AS DATE) AS session_date, e.event_id AS session_id, 1 AS seq, e.event_ts,
    CASE WHEN e.amount > 15 THEN p_name ELSE '' END AS query, CASE WHEN e.amount < 30 THEN p_brand END AS query_attrs,
    concat_ws(',', e.item_id, e.item_id + 1, e.item_id + 2) AS result_items
  FROM actions e JOIN part ON p_partkey = e.item_id WHERE e.event_type = 'click')"""


@query("b4_required_not_null", f"WITH {ACTIONS}, {SEARCHES} SELECT session_id, query, query_attrs FROM searches WHERE query IS NOT NULL AND query_attrs IS NOT NULL")
def _(t):
    return flt.required(t.search_log(), ["query", "query_attrs"]).select("session_id", "query", "query_attrs")


@query(
    "b5_nonempty_search_filter",
    f"WITH {ACTIONS}, {SEARCHES} SELECT session_id, user_id, query, query_attrs FROM searches WHERE (query_attrs IS NOT NULL AND query_attrs <> '') OR (query IS NOT NULL AND query <> '')",
)
def _(t):
    return flt.nonempty_search(t.search_log()).select("session_id", "user_id", "query", "query_attrs")


@query("b6_bot_filter", f"WITH {ACTIONS} SELECT user_id, item_id, event_ts FROM actions WHERE event_type = 'error' AND CAST(amount > 90 AS INT) = 0")
def _(t):
    return flt.human_sessions(t.watch_log()).select("user_id", "item_id", "event_ts")


@query(
    "b6_clicked_impressions",
    """SELECT o_orderkey AS impression_id, o_custkey AS user_id, COUNT(*) AS n_clicks FROM orders JOIN lineitem ON l_orderkey = o_orderkey
       WHERE l_returnflag = 'R' AND o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'P' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'
       GROUP BY ALL""",
)
def _(t):
    kept = flt.clicked_impressions(t.rec_log(), 8, "19980101", "19991231", [0])
    return kept.select("impression_id", "user_id", F.size("clicks").cast("bigint").alias("n_clicks"))


@query("b7_active_category_map", f"WITH {CATEGORIES} SELECT * FROM active")
def _(t):
    return category_dimension(t.categories())


@query(
    "b8_blocklist_filter",
    """SELECT p_partkey AS item_id, n AS attr_name, v AS attr_value FROM part,
       LATERAL (VALUES ('brand', p_brand), ('type', p_type), ('type', p_name), ('size', CAST(p_size AS VARCHAR))) x(n, v)""",
)
def _(t):
    attrs = t.item_attrs().withColumn("namespace", F.lower("namespace")).withColumn("attr_name", F.lower("attr_name"))
    return flt.allowed_attributes(attrs, ["df"], ["upc"]).select("item_id", "attr_name", "attr_value")


@query(
    "b9_event_tag_and_amount",
    sql_rounded(f"WITH {ORDER_LINES} SELECT user_id, item_id, txn_id, line, 'purchase' AS event_type, price * qty AS amount FROM lines", ["amount"]),
)
def _(t):
    return flt.with_amount(t.order_lines(), "purchase").select("user_id", "item_id", "txn_id", "line", "event_type", "amount")


@query(
    "b10_feature_projection",
    f"""{WITH_REF} SELECT a.user_id, a.leaf_id, a.event_ts,
      COUNT(CASE WHEN date_diff('day', CAST(e.event_ts AS DATE), DATE '{REF}') BETWEEN 1 AND 7 THEN 1 END) AS f_num_views_from_leaf_cat_in_last_7_days
      FROM anchors a LEFT JOIN actions e ON e.user_id = a.user_id AND e.leaf_id = a.leaf_id AND e.event_type = 'view' GROUP BY ALL""",
)
def _(t):
    counts = count_windows(ref_anchors(t), t.actions(), LEAF, "view", [7]).withColumn("debug", F.lit(1))
    return flt.feature_projection(counts, ["user_id", "leaf_id", "event_ts"])


@query(
    "b12_active_leaf_filter",
    f"""{WITH_REF} SELECT a.user_id, a.leaf_id, a.event_ts, COUNT(*) AS f_num_purchases_from_leaf_cat_in_last_7_days
      FROM anchors a JOIN actions e ON e.user_id = a.user_id AND e.leaf_id = a.leaf_id AND e.event_type = 'purchase'
       AND date_diff('day', CAST(e.event_ts AS DATE), DATE '{REF}') BETWEEN 1 AND 7 GROUP BY ALL""",
)
def _(t):
    counts = count_windows(ref_anchors(t), t.actions(), LEAF, "purchase", [7])
    return flt.active_in_leaf(counts, "f_num_purchases_from_leaf_cat_in_last_7_days")


@query(
    "b13_user_subset",
    f"""WITH chosen AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY {sql_hash('user_id')}, user_id LIMIT 100)
      SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM chosen)""",
)
def _(t):
    return catalog.user_subset(t.table("events").select("event_id", "user_id", "event_type"), 100)


@query("b14_rename_prefix", "SELECT p_partkey, p_size AS f_p_size, p_retailprice AS f_p_retailprice FROM part")
def _(t):
    return flt.prefix_columns(t.table("part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])


@query("b15_timestamp_parse", "SELECT o_orderkey, o_orderdate + INTERVAL 13 HOUR AS parsed FROM orders")
def _(t):
    text = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 13 HOURS"), "yyyy/MM/dd HH:mm:ss")
    return t.table("orders").select("o_orderkey", flt.parse_timestamp(text).alias("parsed"))


