"""Scalar, array, map and JSON functions over whole tables."""

from pyspark.sql import functions as F

from queries.common import ACTIONS, NAMES, query, sql_rounded
from rekindle.functions import arrays, maps, text


def _vector(t):
    return t.table("embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))


VEC = "v AS (SELECT vec_id, i, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"


@query(
    "v1_entropy",
    """SELECT user_id, ROUND(ABS(SUM(-p * LOG2(p))), 4) + 0.0 AS entropy FROM (SELECT user_id, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY user_id) AS p
       FROM events GROUP BY user_id, event_type) GROUP BY user_id""",
)
def _(t):
    counts = t.table("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    # five action types at most
    shares = counts.groupBy("user_id").agg(F.collect_list("n").alias("ns"), F.sum("n").alias("total"))
    return shares.select("user_id", arrays.shannon_entropy(F.transform("ns", lambda n: n / F.col("total"))).alias("entropy"))


TOKENS = r"list_filter(string_split(lower(regexp_replace(p_name, '\W+', ' ', 'g')), ' '), lambda s: s <> '')"


@query("v2_clean_tokens", rf"SELECT p_partkey, array_to_string({TOKENS}, '|') AS tokens, CAST(len(list_filter(string_split(lower(regexp_replace(p_name, '\W+', '', 'g')), ''), lambda s: s <> '')) AS INTEGER) AS characters FROM part")
def _(t):
    name = F.col("p_name")
    return t.table("part").select("p_partkey", F.array_join(text.tokens(name), "|").alias("tokens"), F.size(text.tokens(name, "char")).alias("characters"))


# names joined with their category's names: (leaf_name, mid_name) and (leaf_name, top_name) side by side
PAIR = f"""WITH {NAMES}, t AS (SELECT leaf_id, 'l' AS s, unnest({TOKENS.replace('p_name', "leaf_name || ' ' || top_name")}) AS w FROM names
  UNION ALL SELECT leaf_id, 'r', unnest({TOKENS.replace('p_name', "mid_name || ' ' || top_name")}) FROM names),
  c AS (SELECT leaf_id, w, CAST(SUM(CASE WHEN s = 'l' THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(SUM(CASE WHEN s = 'r' THEN 1 ELSE 0 END) AS BIGINT) AS b FROM t GROUP BY ALL)"""


def _pair(t):
    left = text.tokens(F.concat_ws(" ", "leaf_name", "top_name"))
    right = text.tokens(F.concat_ws(" ", "mid_name", "top_name"))
    return t.category_names(), left, right


@query("v3_cosine_counts", sql_rounded(f"{PAIR} SELECT leaf_id, SUM(a * b) / (SQRT(SUM(a * a)) * SQRT(SUM(b * b))) AS cosine FROM c GROUP BY leaf_id", ["cosine"]))
def _(t):
    names, left, right = _pair(t)
    return names.select("leaf_id", text.cosine_counts(left, right).alias("cosine"))


@query("v4_jaccard_sets", sql_rounded(f"{PAIR} SELECT leaf_id, COUNT(CASE WHEN a > 0 AND b > 0 THEN 1 END) / COUNT(*) AS jaccard FROM c GROUP BY leaf_id", ["jaccard"]))
def _(t):
    names, left, right = _pair(t)
    return names.select("leaf_id", text.jaccard_sets(left, right).alias("jaccard"))


@query("v5_l2_normalise", sql_rounded(f"WITH {VEC} SELECT vec_id, CAST(i AS INTEGER) AS i, x / SQRT(SUM(x * x) OVER (PARTITION BY vec_id)) AS x FROM v", ["x"]))
def _(t):
    exploded = _vector(t).select("vec_id", F.posexplode(arrays.l2_normalise(F.col("v"))).alias("i", "x"))
    return exploded.withColumn("i", F.col("i") + 1)


@query(
    "v6_array_percentile",
    sql_rounded(f"WITH {VEC} SELECT vec_id, QUANTILE_CONT(x, 0.25) AS p25, QUANTILE_CONT(x, 0.5) AS p50, QUANTILE_CONT(x, 0.75) AS p75 FROM v GROUP BY vec_id", ["p25", "p50", "p75"]),
)
def _(t):
    return _vector(t).select("vec_id", *[arrays.array_percentile(F.col("v"), p).alias(f"p{p}") for p in (25, 50, 75)])


@query(
    "v7_score_ratio",
    sql_rounded("SELECT p_brand, CASE WHEN MIN(p_size - 1) > 0 THEN MAX(p_size - 1) / MIN(p_size - 1) ELSE 0.0 END AS by_size, MAX(p_retailprice) / MIN(p_retailprice) AS by_price FROM part GROUP BY p_brand", ["by_size", "by_price"]),
)
def _(t):
    size = F.col("p_size") - 1
    return t.table("part").groupBy("p_brand").agg(
        arrays.score_ratio(F.min(size), F.max(size)).alias("by_size"), arrays.score_ratio(F.min("p_retailprice"), F.max("p_retailprice")).alias("by_price")
    )


@query("v8_array_mean", sql_rounded(f"WITH {VEC} SELECT vec_id, AVG(x) AS mean FROM v GROUP BY vec_id", ["mean"]))
def _(t):
    return _vector(t).select("vec_id", arrays.array_mean(F.col("v")).alias("mean"))


@query("v9_array_var", sql_rounded(f"WITH {VEC} SELECT vec_id, VAR_POP(x) AS var FROM v GROUP BY vec_id", ["var"]))
def _(t):
    return _vector(t).select("vec_id", arrays.array_var(F.col("v")).alias("var"))


@query("v10_poisson_k1", sql_rounded("SELECT o_orderkey, p * EXP(-p) AS poisson FROM (SELECT o_orderkey, o_totalprice / 100000 AS p FROM orders)", ["poisson"]))
def _(t):
    return t.table("orders").select("o_orderkey", arrays.poisson_once(F.col("o_totalprice") / 100000).alias("poisson"))


@query("v11_array_min_max", f"WITH {VEC} SELECT vec_id, ROUND(MIN(x), 6) + 0.0 AS smallest, ROUND(MAX(x), 6) + 0.0 AS largest FROM v GROUP BY vec_id")
def _(t):
    low, high = arrays.array_min_max(F.col("v"))
    return _vector(t).select("vec_id", low.alias("smallest"), high.alias("largest"))


@query("v12_merge_maps", "SELECT p_partkey, 'brand=' || p_brand || ';type=' || p_name AS merged FROM part")
def _(t):
    def pair(k, v):
        return F.create_map(F.lit(k), F.col(v))

    merged = maps.merge_maps(F.array(pair("brand", "p_brand"), pair("type", "p_type"), pair("type", "p_name")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return t.table("part").select("p_partkey", shown.alias("merged"))


@query("v14_explode_split", f"WITH {ACTIONS} SELECT event_id AS session_id, item_id + i AS result_item FROM actions, LATERAL (VALUES (0), (1), (2)) x(i) WHERE event_type = 'click'")
def _(t):
    log = t.search_log()
    return log.select("session_id", F.explode(F.split("result_items", ",").cast("array<bigint>")).alias("result_item"))


@query("v15_nest_structs", "SELECT l_orderkey, COUNT(*) AS n, string_agg(l_partkey || 'x' || CAST(l_quantity AS INTEGER), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS lines FROM lineitem GROUP BY l_orderkey")
def _(t):
    nested = t.table("lineitem").groupBy("l_orderkey").agg(
        maps.nested_events(["l_partkey", "l_quantity"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).alias("e")
    )
    shown = F.array_join(F.transform("e", lambda s: F.concat(s["l_partkey"], F.lit("x"), s["l_quantity"].cast("int"))), ",")
    return nested.select("l_orderkey", F.size("e").cast("bigint").alias("n"), shown.alias("lines"))


@query("v16_to_json", """SELECT p_partkey, '{"p_name":"' || p_name || '","p_size":' || p_size || '}' AS json FROM part""")
def _(t):
    return t.table("part").select("p_partkey", F.to_json(F.struct("p_name", "p_size")).alias("json"))


@query(
    "v18_builtins",
    f"""SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS age, COALESCE(NULLIF(o_orderstatus, 'P'), 'none') AS status,
      CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS size_class, ROUND(o_totalprice, 1) + 0.0 AS rounded, CAST(length(o_orderpriority) AS INTEGER) AS n,
      upper(o_orderpriority) AS up, lower(o_orderpriority) AS low FROM orders""",
)
def _(t):
    return t.table("orders").select(
        "o_orderkey", F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate")).alias("age"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("none")).alias("status"),
        F.when(F.col("o_totalprice") > 250000, "big").otherwise("small").alias("size_class"), F.round("o_totalprice", 1).alias("rounded"),
        F.length("o_orderpriority").alias("n"), F.upper("o_orderpriority").alias("up"), F.lower("o_orderpriority").alias("low"),
    )


@query("v19_text_casefold_path", "SELECT p_partkey, p_type || ' / ' || p_brand || ' / ' || p_name AS path FROM part")
def _(t):
    return t.table("part").select("p_partkey", text.category_path(F.concat_ws(":", "p_type", "p_brand", "p_name")).alias("path"))


