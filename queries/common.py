"""Registration, shared inputs and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rekindle.config import Config, EventLimits, Filters, Sampling
from rekindle.sources.supplied import Supplied

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

REF = "2024-01-20"
START = "2024-01-01"
END = "2024-01-31"
WINDOWS = (1, 2, 5, 7, 14)
CONFIG = Config(
    filters=Filters(START, END, (0,), min_purchases=3),
    sampling=Sampling(REF, fraction=0.5, max_samples=800),
    limits=EventLimits(8, 8, 6, 5, 4, 12),
)
ORDER_CONFIG = Config(
    filters=Filters("1997-01-01", "2001-12-31", (0,), min_purchases=3),
    sampling=Sampling("2000-01-01", fraction=0.5, max_samples=800),
    limits=EventLimits(20, 8, 6, 5, 4, 24),
)


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its rows are checked."""

    def register(build: Callable[[Supplied], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(build(Supplied(spark, folder)))

        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to 6 places, so that the order of summation does not show. Whole numbers, which most cells of a matrix are, skip the decimal arithmetic."""
    return df.select(
        [
            (F.when(F.rint(f.name) == F.col(f.name), F.col(f.name)).otherwise(F.round(f.name, places)) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def sql_rounded(sql: str, columns: Sequence[str]) -> str:
    """The same rounding in SQL."""
    cols = ", ".join(f"ROUND({c}, 6) + 0.0 AS {c}" for c in columns)
    return f"SELECT * REPLACE ({cols}) FROM ({sql})"


# ---- inputs -------------------------------------------------------------------------------


def ref_anchors(t: Supplied) -> DataFrame:
    """Every (user, category) bought before the reference date, at the reference date."""
    past = t.purchases().where(F.col("event_ts") < F.lit(REF).cast("timestamp"))
    pairs = past.select("user_id", "leaf_id", "mid_id", "top_id").distinct()
    return pairs.withColumn("event_ts", F.lit(REF).cast("timestamp"))


def click_anchors(t: Supplied) -> DataFrame:
    """Every click as an anchor at its own time: anchors on many days."""
    return t.actions().where(F.col("event_type") == "click").select("user_id", "leaf_id", "mid_id", "top_id", "event_ts")


def with_names(t: Supplied, anchors: DataFrame) -> DataFrame:
    names = t.category_names().drop("mid_id", "top_id")
    return anchors.join(names, "leaf_id")


# ---- SQL fragments -------------------------------------------------------------------------

ACTIONS = """actions AS (
  SELECT event_id, user_id, ts AS event_ts, event_type, value AS amount,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS leaf_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS mid_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) // 50 AS top_id
  FROM events)"""

REF_ANCHORS = f"""anchors AS (
  SELECT DISTINCT user_id, leaf_id, mid_id, top_id, TIMESTAMP '{REF}' AS event_ts
  FROM actions WHERE event_type = 'purchase' AND event_ts < TIMESTAMP '{REF}')"""

CLICK_ANCHORS = """anchors AS (
  SELECT user_id, leaf_id, mid_id, top_id, event_ts FROM actions WHERE event_type = 'click')"""

NAMES = """names AS (
  SELECT l.p_partkey AS leaf_id, l.p_name AS leaf_name, m.p_partkey AS mid_id, m.p_name AS mid_name,
         t.p_partkey AS top_id, t.p_name AS top_name
  FROM part l JOIN part m ON m.p_partkey = l.p_partkey // 10 JOIN part t ON t.p_partkey = l.p_partkey // 50)"""

CATEGORIES = f"""{NAMES}, categories AS (
  SELECT s.site_id, n.*, CASE WHEN p.p_size = 1 THEN p.p_partkey + 1 ELSE p.p_partkey END AS redirect_leaf_id
  FROM names n JOIN part p ON p.p_partkey = n.leaf_id, (VALUES (0), (3)) s(site_id)),
active AS (SELECT * EXCLUDE (redirect_leaf_id) FROM categories WHERE leaf_id = redirect_leaf_id)"""

ITEMS = """items AS (
  SELECT p_partkey AS item_id, p_name AS title, DATE '2023-12-01' + p_size AS end_date, p_partkey AS leaf_id,
         0 AS site_id, 'img/' || p_partkey || '.jpg' AS image_url FROM part)"""

ORDER_LINES = """lines AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, l_orderkey AS txn_id, l_linenumber AS line, l_suppkey AS seller_id,
         CASE WHEN o_orderpriority = '5-LOW' THEN 3 ELSE 0 END AS site_id, l_extendedprice / l_quantity AS price,
         l_quantity AS qty, o_orderdate AS event_ts, CAST(o_orderdate AS DATE) AS event_date, l_returnflag AS return_flag,
         CASE WHEN l_quantity > 25 THEN CAST(l_linenumber AS BIGINT) END AS variation_id,
         l_partkey AS leaf_id, l_partkey // 10 AS mid_id, l_partkey // 50 AS top_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

WITH_REF = f"WITH {ACTIONS}, {REF_ANCHORS}"
WITH_CLICKS = f"WITH {ACTIONS}, {CLICK_ANCHORS}"


def sql_hash(*keys: str, seed: int = 42) -> str:
    """The 48-bit key hash."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 12) AS BIGINT)"


def sql_unit(*keys: str, seed: int = 42) -> str:
    return f"({sql_hash(*keys, seed=seed)} / {float(2**48)})"


AGE = "date_diff('day', CAST(e.event_ts AS DATE), CAST(a.event_ts AS DATE))"


def keyed_anchors(level: str) -> str:
    """Distinct anchor keys of a level."""
    return f"(SELECT DISTINCT user_id, {level}_id, event_ts FROM anchors)"
