"""Per-user history builders over the supplied logs."""

from dataclasses import replace

from pyspark.sql import functions as F

from queries.common import ACTIONS, CATEGORIES, CONFIG, ITEMS, ORDER_CONFIG, ORDER_LINES, query, sql_rounded
from rekindle.operators.labels import select_cohort
from rekindle.operators.topk import recent_topk
from rekindle.plans import histories as h

START, END = CONFIG.filters.start_date, CONFIG.filters.end_date


def tables(t) -> h.Tables:
    return h.Tables(
        purchases=t.purchases().withColumns({"site_id": F.lit(0), "txn_id": F.col("event_id"), "line": F.lit(1), "price": F.col("amount"), "qty": F.lit(2.0),
                                             "variation_id": F.when(F.col("amount") > 50, F.col("mid_id"))}).drop("amount", "event_type", "event_id"),
        views=t.view_log(), searches=t.search_log(), watches=t.watch_log(), home_events=t.home_log(), items=t.items(), categories=t.categories(),
        item_attrs=t.item_attrs(), variation_attrs=t.variation_attrs(), returns=t.returns(),
    )


def order_tables(t) -> h.Tables:
    return h.Tables(purchases=t.order_lines().drop("seller_id", "return_flag"), items=t.items(), categories=t.categories(), item_attrs=t.item_attrs(),
                    variation_attrs=t.variation_attrs(), returns=t.returns())


def cohort(t):
    """Users with enough purchases."""
    return select_cohort(tables(t).purchases, CONFIG)


COHORT = f"""cohort AS (SELECT user_id FROM actions WHERE event_type = 'purchase' AND CAST(event_ts AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'
  GROUP BY user_id HAVING COUNT(*) >= 3)"""
BASE = f"WITH {ACTIONS}, {CATEGORIES}, {ITEMS}, {COHORT}"


def recent(event_type: str, k: int, tie: str, where: str = "TRUE") -> str:
    return f"""recent AS (SELECT * FROM actions WHERE event_type = '{event_type}' AND {where} AND user_id IN (SELECT user_id FROM cohort)
      AND CAST(event_ts AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'
      QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_ts DESC, {tie} DESC) <= {k})"""


NAMES = "c.leaf_name, c.mid_name, c.top_name"
ITEM_JOIN = f"JOIN items i ON i.item_id = r.item_id AND i.end_date >= DATE '{START}' JOIN active c ON c.leaf_id = i.leaf_id AND c.site_id = i.site_id"
MAP_TEXT = "'brand=' || lower(p_brand) || ';size=' || p_size || ';type=' || lower(CASE WHEN (length(p_name), p_name) < (length(p_type), p_type) THEN p_name ELSE p_type END)"


def shown(df, *maps):
    """Maps as text, so that any engine can compare them."""
    return df.withColumns(
        {m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";") for m in maps}
    )


VIEW_COLUMNS = ["user_id", "item_id", "event_ts", "title", "site_id", "leaf_id", "leaf_name", "mid_id", "mid_name", "top_id", "top_name", "event_type"]


@query(
    "x1_view_history",
    f"""{BASE}, {recent('view', 8, 'item_id')} SELECT r.event_id, r.user_id, r.item_id, r.event_ts, lower(i.title) AS title, i.site_id, i.leaf_id, lower(c.leaf_name) AS leaf_name,
      c.mid_id, c.top_id, 'view' AS event_type, {MAP_TEXT} AS attributes FROM recent r {ITEM_JOIN} JOIN part ON p_partkey = r.item_id""",
)
def _(t):
    out = h.view_history(tables(t), cohort(t), CONFIG)
    return shown(out, "attributes").select("event_id", "user_id", "item_id", "event_ts", "title", "site_id", "leaf_id", "leaf_name", "mid_id", "top_id", "event_type", "attributes")


@query(
    "x2_view_history_min",
    f"""{BASE}, {recent('view', 8, 'item_id')} SELECT r.user_id, r.item_id, r.event_ts, lower(i.title) AS title, i.site_id, i.leaf_id, {NAMES}, c.mid_id, c.top_id, 'view' AS event_type
      FROM recent r {ITEM_JOIN}""",
)
def _(t):
    return h.view_history_min(tables(t), cohort(t), CONFIG).select(*VIEW_COLUMNS)


@query(
    "x2_view_history_min_one_less",
    f"""{BASE}, {recent('view', 7, 'item_id')} SELECT r.user_id, r.item_id, r.event_ts FROM recent r {ITEM_JOIN}""",
)
def _(t):
    return h.view_history_min(tables(t), cohort(t), CONFIG, parity=True).select("user_id", "item_id", "event_ts")


ORDER_COHORT = f"""cohort AS (SELECT user_id FROM lines WHERE event_date BETWEEN DATE '1997-01-01' AND DATE '2001-12-31' AND site_id IN (0)
  GROUP BY user_id HAVING COUNT(*) >= 3)"""
ORDER_RECENT = """recent AS (SELECT * FROM lines WHERE site_id IN (0) AND event_date BETWEEN DATE '1997-01-01' AND DATE '2001-12-31' AND user_id IN (SELECT user_id FROM cohort)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_ts DESC, item_id DESC, txn_id DESC, line DESC, qty DESC) <= 20),
kept AS (SELECT r.*, lower(i.title) AS title, i.image_url, i.end_date FROM recent r JOIN items i USING (item_id, site_id)
  WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_returnflag = 'R' AND x.l_partkey = r.item_id AND x.l_orderkey = r.txn_id))"""
ORDER_BASE = f"WITH {ORDER_LINES}, {CATEGORIES}, {ITEMS}, {ORDER_COHORT}, {ORDER_RECENT}"
PURCHASE = "k.user_id, k.item_id, k.site_id, k.leaf_id, CAST(CAST(k.price AS DECIMAL(18, 8)) AS VARCHAR) AS price, k.qty, k.event_ts, k.title, lower(c.leaf_name) AS leaf_name, c.mid_id, c.top_id, 'purchase' AS event_type, k.price * k.qty AS amount"
PURCHASE_COLUMNS = ["user_id", "item_id", "site_id", "leaf_id", "price", "qty", "event_ts", "title", "leaf_name", "mid_id", "top_id", "event_type", "amount"]


def exact_price(df):
    """The price as text to 8 places: thirty-seconds of a cent would be ties at 6."""
    return df.withColumn("price", F.col("price").cast("decimal(18,8)").cast("string"))


@query("x4_purchase_history_min", sql_rounded(f"{ORDER_BASE} SELECT {PURCHASE} FROM kept k JOIN active c USING (site_id, leaf_id)", ["qty", "amount"]))
def _(t):
    users = select_cohort(t.order_lines(), ORDER_CONFIG)
    return exact_price(h.purchase_history_min(order_tables(t), users, ORDER_CONFIG)).select(*PURCHASE_COLUMNS)


@query(
    "x3_purchase_history",
    sql_rounded(
        f"""{ORDER_BASE} SELECT {PURCHASE}, k.image_url, k.variation_id, {MAP_TEXT} AS attributes,
          CASE WHEN k.variation_id IS NOT NULL THEN 'colour=' || CASE WHEN (length(v1), v1) < (length(v2), v2) THEN lower(v1) ELSE lower(v2) END || ';style=' || lower(p_type) END AS variation_attributes
          FROM (SELECT *, p_brand || '-' || variation_id AS v1, 'x' || variation_id AS v2 FROM kept JOIN part ON p_partkey = item_id) k JOIN active c USING (site_id, leaf_id)""",
        ["qty", "amount"],
    ),
)
def _(t):
    users = select_cohort(t.order_lines(), ORDER_CONFIG)
    out = exact_price(h.purchase_history(order_tables(t), users, ORDER_CONFIG))
    return shown(out, "attributes", "variation_attributes").select(*PURCHASE_COLUMNS, "image_url", "variation_id", "attributes", "variation_attributes")


HOME = f"""pages_seen AS (SELECT user_id, 'p' || mid_id AS page_id, CAST(event_ts AS DATE) AS session_date, MIN(event_ts) AS event_ts FROM actions
  WHERE event_type = 'signup' AND user_id IN (SELECT user_id FROM cohort) AND CAST(event_ts AS DATE) BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY ALL),
home AS (SELECT * FROM pages_seen QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_ts DESC, page_id DESC) <= 4)"""


@query("x5_home_events", f"WITH {ACTIONS}, {COHORT}, {HOME} SELECT user_id, session_date, event_ts, 'home' AS event_type FROM home")
def _(t):
    return h.home_events(tables(t), cohort(t), CONFIG)


SEARCH_RECENT = f"""searches AS (SELECT a.*, CASE WHEN amount > 15 THEN p_name ELSE '' END AS query, CASE WHEN amount < 30 THEN p_brand END AS query_attrs
    FROM actions a JOIN part ON p_partkey = item_id WHERE event_type = 'click'),
  recent AS (SELECT * FROM searches WHERE ((query_attrs IS NOT NULL AND query_attrs <> '') OR (query IS NOT NULL AND query <> '')) AND user_id IN (SELECT user_id FROM cohort)
    AND CAST(event_ts AS DATE) BETWEEN DATE '{START}' AND DATE '{END}' QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_ts DESC, event_id DESC) <= 6)"""


@query(
    "x7_search_history_min",
    f"""{BASE}, {SEARCH_RECENT} SELECT r.user_id, r.leaf_id, 0 AS site_id, lower(r.query) AS title, r.event_ts, lower(c.leaf_name) AS leaf_name, c.mid_id, c.top_id, 'search' AS event_type
      FROM recent r JOIN active c ON c.leaf_id = r.leaf_id AND c.site_id = 0""",
)
def _(t):
    out = h.search_history_min(tables(t), cohort(t), CONFIG)
    return out.select("user_id", "leaf_id", "site_id", "title", "event_ts", "leaf_name", "mid_id", "top_id", "event_type")


@query(
    "x6_search_history",
    f"""{BASE}, {SEARCH_RECENT}, listed AS (SELECT r.event_id, string_agg((r.item_id + x.i) || '=' || lower(i.title), ';' ORDER BY x.i) AS results, COUNT(*) AS n
        FROM recent r, LATERAL (VALUES (0), (1), (2)) x(i) JOIN items i ON i.item_id = r.item_id + x.i AND i.end_date >= DATE '{START}' GROUP BY r.event_id)
      SELECT r.user_id, r.leaf_id, r.event_id AS session_id, lower(r.query) AS title, lower(r.query_attrs) AS search_attrs, r.event_ts, lower(c.leaf_name) AS leaf_name, l.results, l.n
      FROM recent r JOIN active c ON c.leaf_id = r.leaf_id AND c.site_id = 0 JOIN listed l ON l.event_id = r.event_id""",
)
def _(t):
    out = h.search_history(tables(t), cohort(t), CONFIG)
    text = F.array_join(F.transform("results", lambda r: F.concat(r["item_id"], F.lit("="), r["title"])), ";")
    return out.select("user_id", "leaf_id", "session_id", "title", "search_attrs", "event_ts", "leaf_name", text.alias("results"), F.size("results").cast("bigint").alias("n"))


@query(
    "x8_watch_history_min",
    f"""{BASE}, {recent('error', 5, 'item_id', 'amount <= 90')} SELECT r.user_id, r.item_id, r.event_ts, lower(i.title) AS title, i.leaf_id, lower(c.leaf_name) AS leaf_name, c.mid_id, c.top_id, 'watch' AS event_type
      FROM recent r {ITEM_JOIN}""",
)
def _(t):
    out = h.watch_history_min(tables(t), cohort(t), CONFIG)
    return out.select("user_id", "item_id", "event_ts", "title", "leaf_id", "leaf_name", "mid_id", "top_id", "event_type")


@query(
    "x9_watch_history_alt",
    f"""{BASE}, {recent('error', 5, 'item_id', 'amount <= 60')} SELECT r.user_id, r.item_id, r.event_ts, r.leaf_id, lower(c.leaf_name) AS leaf_name, c.mid_id, c.top_id, 'watch' AS event_type
      FROM recent r JOIN active c ON c.leaf_id = r.leaf_id AND c.site_id = 0""",
)
def _(t):
    out = h.watch_history_alt(tables(t), cohort(t), CONFIG)
    return out.select("user_id", "item_id", "event_ts", "leaf_id", "leaf_name", "mid_id", "top_id", "event_type")


TIMELINE = f"""{BASE}, bought_recent AS (SELECT * FROM actions WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM cohort)
    AND CAST(event_ts AS DATE) BETWEEN DATE '{START}' AND DATE '{END}' QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_ts DESC, item_id DESC) <= 8),
  bought AS (SELECT r.user_id, r.item_id, r.event_ts, 'purchase' AS event_type FROM bought_recent r {ITEM_JOIN}
    WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_returnflag = 'R' AND x.l_partkey = r.item_id AND x.l_orderkey = r.event_id)),
  buyers AS (SELECT DISTINCT user_id FROM bought),
  {recent('view', 8, 'item_id')}, {SEARCH_RECENT.replace('recent AS', 'searched AS')}, {HOME},
  events_all AS (SELECT * FROM bought
    UNION ALL SELECT r.user_id, r.item_id, r.event_ts, 'view' FROM recent r {ITEM_JOIN} WHERE r.user_id IN (SELECT user_id FROM buyers)
    UNION ALL SELECT r.user_id, NULL, r.event_ts, 'search' FROM searched r JOIN active c ON c.leaf_id = r.leaf_id AND c.site_id = 0
      WHERE r.user_id IN (SELECT user_id FROM buyers) AND EXISTS (SELECT 1 FROM items i WHERE i.item_id BETWEEN r.item_id AND r.item_id + 2 AND i.end_date >= DATE '{START}')
    UNION ALL SELECT user_id, NULL, event_ts, 'home' FROM home WHERE user_id IN (SELECT user_id FROM buyers)),
  latest AS (SELECT * FROM events_all QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_ts DESC, event_type DESC) <= 12)"""


@query("timeline_events", f"{TIMELINE} SELECT * FROM latest")
def _(t):
    return h.timeline_events(tables(t), CONFIG).select("user_id", "item_id", "event_ts", "event_type")


#: Every field of an event as text: (name, SQL over the part of the union that has it).
FIELDS = ("event_type", "event_ts", "item_id", "title", "site_id", "leaf_id", "leaf_name", "mid_id", "mid_name", "top_id", "top_name", "price", "qty", "amount",
          "image_url", "variation_id", "attributes", "variation_attributes", "search_attrs", "results")


def _part(event_type: str, source: str, **fields: str) -> str:
    own = {"event_type": f"'{event_type}'", "event_ts": "CAST(epoch_us(r.event_ts) AS VARCHAR)"} | fields
    return "SELECT r.user_id, r.event_ts AS seen, " + ", ".join(f"CAST({own.get(f, 'NULL')} AS VARCHAR) AS {f}" for f in FIELDS) + f" FROM {source}"


_CATEGORY = {"leaf_name": "lower(c.leaf_name)", "mid_id": "c.mid_id", "mid_name": "lower(c.mid_name)", "top_id": "c.top_id", "top_name": "lower(c.top_name)"}
_ITEM = {"item_id": "r.item_id", "title": "lower(i.title)", "site_id": "i.site_id", "leaf_id": "i.leaf_id", "attributes": MAP_TEXT} | _CATEGORY
_VARIATION = """CASE WHEN r.amount > 50 AND (r.item_id, r.own_mid) IN (SELECT (l_partkey, l_linenumber) FROM lineitem WHERE l_quantity > 25) THEN 'colour=' || CASE WHEN (length(v1), v1) < (length(v2), v2) THEN lower(v1) ELSE lower(v2) END || ';style=' || lower(p_type) END"""
WHOLE = TIMELINE[: TIMELINE.index("  events_all AS")] + f"""  listed AS (SELECT s.event_id, string_agg((s.item_id + x.i) || '=' || lower(i.title) || '=' || i.image_url, ';' ORDER BY x.i) AS results
    FROM searched s, LATERAL (VALUES (0), (1), (2)) x(i) JOIN items i ON i.item_id = s.item_id + x.i AND i.end_date >= DATE '{START}' GROUP BY s.event_id),
  events_all AS ({_part("purchase", f"(SELECT *, mid_id AS own_mid FROM bought_recent) r {ITEM_JOIN} JOIN (SELECT p.*, q.mid_id, p_brand || '-' || q.mid_id AS v1, 'x' || q.mid_id AS v2 FROM part p JOIN (SELECT DISTINCT item_id, mid_id FROM actions) q ON q.item_id = p_partkey) pp ON p_partkey = r.item_id WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_returnflag = 'R' AND x.l_partkey = r.item_id AND x.l_orderkey = r.event_id)",
      **_ITEM, price="CAST(r.amount AS DECIMAL(18, 4))", qty="CAST(2 AS DECIMAL(18, 4))", amount="CAST(r.amount * 2 AS DECIMAL(18, 4))", image_url="i.image_url",
      variation_id="CASE WHEN r.amount > 50 THEN r.own_mid END", variation_attributes=_VARIATION)}
    UNION ALL {_part("view", f"recent r {ITEM_JOIN} JOIN part ON p_partkey = r.item_id WHERE r.user_id IN (SELECT user_id FROM buyers)", **_ITEM)}
    UNION ALL {_part("search", "searched r JOIN active c ON c.leaf_id = r.leaf_id AND c.site_id = 0 JOIN listed l ON l.event_id = r.event_id WHERE r.user_id IN (SELECT user_id FROM buyers)",
      title="lower(r.query)", site_id="0", leaf_id="r.leaf_id", search_attrs="lower(r.query_attrs)", results="l.results", **_CATEGORY)}
    UNION ALL {_part("home", "home r WHERE r.user_id IN (SELECT user_id FROM buyers)")}),
  told AS (SELECT *, concat_ws('|', {", ".join(f"COALESCE({f}, '')" for f in FIELDS)}) AS event FROM events_all),
  placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY seen DESC, event_type DESC) AS down, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY seen DESC, event_type) AS up FROM told)"""


def told(events):
    """Arrays of events as arrays of text, field by field."""

    def field(e, f):
        if f in ("attributes", "variation_attributes"):
            return F.array_join(F.transform(F.map_entries(e[f]), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
        if f == "results":
            return F.array_join(F.transform(e[f], lambda x: F.concat_ws("=", x["item_id"], x["title"], x["image_url"])), ";")
        if f == "event_ts":
            return F.unix_micros(e[f].cast("timestamp")).cast("string")
        if f in ("price", "qty", "amount"):
            return e[f].cast("decimal(18,4)").cast("string")
        return e[f].cast("string")

    return F.transform(events, lambda e: F.concat_ws("|", *[F.coalesce(field(e, f), F.lit("")) for f in FIELDS]))


@query("x10_user_timeline", f"{WHOLE} SELECT user_id, COUNT(*) AS n, string_agg(event, chr(10) ORDER BY up) AS sequence FROM placed WHERE down <= 12 GROUP BY user_id")
def _(t):
    out = h.user_timeline(tables(t), CONFIG)
    return out.select("user_id", F.size("events").cast("bigint").alias("n"), F.array_join(told("events"), "\n").alias("sequence"))


@query("x10_user_timeline_chunks", f"{WHOLE} SELECT user_id, (up - 1) // 5 AS chunk, string_agg(event, chr(10) ORDER BY up) AS sequence FROM placed GROUP BY ALL")
def _(t):
    """All events of the chosen histories, five to a row."""
    config = replace(CONFIG, limits=replace(CONFIG.limits, max_events=None))
    out = h.user_timeline(tables(t), config, chunk=5)
    return out.select("user_id", "chunk", F.array_join(told("events"), "\n").alias("sequence"))


JSON_ITEM = """'{"event_ts":"' || strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '","item_id":' || item_id || '}'"""
JSON_SOURCES = f"""{BASE}, {recent('view', 8, 'item_id')}, v AS (SELECT r.user_id, r.item_id, r.event_ts, r.event_id FROM recent r {ITEM_JOIN}),
      p AS (SELECT user_id, item_id, event_ts, event_id FROM actions WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM cohort))"""


def _json_histories(t):
    def stamped(df):
        return df.select("user_id", "item_id", F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_ts"))

    bought = t.purchases().join(cohort(t), "user_id", "left_semi")
    return {"views": stamped(h.view_history_min(tables(t), cohort(t), CONFIG)), "purchases": stamped(bought)}


@query(
    "x11_history_json",
    f"""{JSON_SOURCES},
      vj AS (SELECT user_id, '[' || string_agg({JSON_ITEM}, ',' ORDER BY event_ts, item_id) || ']' AS views FROM v GROUP BY user_id),
      pj AS (SELECT user_id, '[' || string_agg({JSON_ITEM}, ',' ORDER BY event_ts, item_id) || ']' AS purchases
        FROM (SELECT * FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_ts DESC, item_id DESC) <= 8) GROUP BY user_id)
      SELECT user_id, views, purchases FROM cohort JOIN vj USING (user_id) JOIN pj USING (user_id)""",
)
def _(t):
    histories = _json_histories(t)
    histories["purchases"] = recent_topk(histories["purchases"], 8, tie=["item_id"])
    return h.history_json(cohort(t), histories).select("user_id", "views", "purchases")


def _chunked(name: str) -> str:
    return f"""(SELECT user_id, (nr - 1) // 4 AS chunk, '[' || string_agg({JSON_ITEM}, ',' ORDER BY nr) || ']' AS {name}s
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_ts, item_id) AS nr FROM {name[0]}) GROUP BY ALL)"""


@query(
    "x11_history_json_chunks",
    f"""{JSON_SOURCES} SELECT user_id, chunk, views, purchases FROM {_chunked("view")} FULL JOIN {_chunked("purchase")} USING (user_id, chunk)
      WHERE user_id IN (SELECT user_id FROM v) AND user_id IN (SELECT user_id FROM p)""",
)
def _(t):
    """Histories without a limit, four events to a row."""
    return h.history_json(cohort(t), _json_histories(t), chunk=4).select("user_id", "chunk", "views", "purchases")
