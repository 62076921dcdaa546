"""Replay of impressions derived from orders."""

from pyspark.sql import functions as F

from queries.common import CATEGORIES, ORDER_LINES, query, sql_rounded, sql_unit
from rekindle.operators.replay import packed_items, shown_items
from rekindle.plans.replay import measure, replay_anchors, sample_impressions

KEPT = """kept AS (SELECT o.* FROM orders o WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'P' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'))"""
SHOWN = """l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS rk FROM lineitem),
shown AS (SELECT l_orderkey AS impression_id, CAST(rk AS INTEGER) AS rank, l_partkey AS item_id,
  CASE WHEN EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_partkey = l.l_partkey AND x.l_returnflag = 'R') THEN 1 ELSE 0 END AS clicked,
  COALESCE((SELECT arg_max(x.l_extendedprice, printf('%.2f', x.l_extendedprice)) FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_partkey = l.l_partkey AND x.l_linestatus = 'O'), 0.0) AS amount_7d,
  COALESCE((SELECT arg_max(x.l_extendedprice, printf('%.2f', x.l_extendedprice)) FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_partkey = l.l_partkey AND x.l_linestatus = 'F'), 0.0) AS amount_30d
  FROM l)"""


@query(
    "v17_packed_item_join",
    f"""WITH {SHOWN} SELECT impression_id, string_agg(rank || ':' || item_id || ':' || clicked || ':' || CASE WHEN amount_7d > 0 THEN printf('%.2f', amount_7d) ELSE '0' END
      || ':' || CASE WHEN amount_30d > 0 THEN printf('%.2f', amount_30d) ELSE '0' END, ',' ORDER BY rank) AS packed
      FROM shown JOIN orders ON o_orderkey = impression_id GROUP BY impression_id""",
)
def _(t):
    return packed_items(t.rec_log()).select("impression_id", F.array_join("packed", ",").alias("packed"))


@query("shown_items", sql_rounded(f"WITH {SHOWN} SELECT s.*, o_custkey AS user_id FROM shown s JOIN orders ON o_orderkey = impression_id", ["amount_7d", "amount_30d"]))
def _(t):
    return shown_items(t.rec_log()).select("impression_id", "rank", "item_id", "clicked", "amount_7d", "amount_30d", "user_id")


SAMPLED = f"sampled AS (SELECT * FROM kept WHERE {sql_unit('o_orderkey')} < 0.4)"


@query(
    "x12_recs_log_sample",
    sql_rounded(
        f"WITH {KEPT}, {SAMPLED}, {SHOWN} SELECT s.*, s.item_id AS leaf_id, o.o_custkey AS user_id FROM shown s JOIN sampled o ON o.o_orderkey = s.impression_id",
        ["amount_7d", "amount_30d"],
    ),
)
def _(t):
    return sample_impressions(t.rec_log(), t.items(), 8, "19980101", "19991231", 0.4).drop("shown_at")




def _rows(t, limit=None):
    rows = replay_anchors(sample_impressions(t.rec_log(), t.items(), 8, "19980101", "19991231", 1.0, limit), t.categories())
    return rows.withColumn("pred", (F.col("rank") <= 2).cast("int"))


@query(
    "replay_anchors",
    f"""WITH {KEPT}, {SHOWN}, {CATEGORIES} SELECT s.impression_id, s.rank, s.item_id, o.o_custkey AS user_id, o.o_orderdate AS event_ts, c.leaf_name, c.mid_id
      FROM shown s JOIN kept o ON o.o_orderkey = s.impression_id JOIN active c ON c.leaf_id = s.item_id AND c.site_id = 0""",
)
def _(t):
    return _rows(t).select("impression_id", "rank", "item_id", "user_id", "event_ts", "leaf_name", "mid_id")


def _lift_sql() -> str:
    cols = ["clicks", "kept_clicks", "amount", "kept_amount", "ctr", "amount_rate", "expected_new_clicks", "expected_new_amount", "pct_eligible",
            "pct_suppressed", "pct_recommended", "click_lift_pct", "amount_lift_pct"]
    return sql_rounded(
        f"""WITH {KEPT}, {SHOWN}, {CATEGORIES}, {ORDER_LINES}, bought AS (SELECT DISTINCT user_id, leaf_id // 10 AS mid FROM lines WHERE event_date < DATE '1998-01-01'),
        r AS (SELECT s.*, CASE WHEN s.rank <= 2 THEN 1 ELSE 0 END AS pred, CASE WHEN b.user_id IS NULL THEN 0 ELSE 1 END AS e
          FROM shown s JOIN kept o ON o.o_orderkey = s.impression_id JOIN active c ON c.leaf_id = s.item_id AND c.site_id = 0
          LEFT JOIN bought b ON b.user_id = o.o_custkey AND b.mid = c.mid_id),
        a AS (SELECT COUNT(*) AS total_items, COUNT(CASE WHEN e = 1 THEN 1 END) AS eligible_items, COUNT(CASE WHEN e = 1 AND pred = 0 THEN 1 END) AS suppressed,
          COUNT(CASE WHEN e = 1 AND pred = 1 THEN 1 END) AS recommended, CAST(SUM(clicked * e) AS DOUBLE) AS clicks, CAST(SUM(clicked * e * pred) AS DOUBLE) AS kept_clicks,
          SUM(amount_7d * e) AS amount, SUM(amount_7d * e * pred) AS kept_amount FROM r)
        SELECT *, clicks / eligible_items AS ctr, amount / eligible_items AS amount_rate, clicks / eligible_items * suppressed AS expected_new_clicks,
          amount / eligible_items * suppressed AS expected_new_amount, eligible_items / total_items * 100 AS pct_eligible, suppressed / eligible_items * 100 AS pct_suppressed,
          recommended / eligible_items * 100 AS pct_recommended, ((kept_clicks + clicks / eligible_items * suppressed) / clicks - 1) * 100 AS click_lift_pct,
          ((kept_amount + amount / eligible_items * suppressed) / amount - 1) * 100 AS amount_lift_pct FROM a""",
        cols,
    )


@query("y14_recs_replay_lift", _lift_sql())
def _(t):
    rows = _rows(t).drop("leaf_id").withColumnRenamed("mid_id", "leaf_id")
    past = t.order_lines().where(F.col("event_date") < F.lit("1998-01-01").cast("date"))
    return measure(rows, past.select("user_id", F.col("mid_id").alias("leaf_id")))
