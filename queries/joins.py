"""Joins, the flagship feature matrix and its plans."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import features as ft
from queries.common import (
    ACTIONS, AGE, CATEGORIES, CONFIG, ITEMS, ORDER_LINES, REF, WINDOWS, WITH_CLICKS, WITH_REF, NAMES, click_anchors, keyed_anchors, query, ref_anchors,
    sql_hash, sql_rounded, sql_unit,
)
from rekindle.config import OFFLINE_WEIGHTS, OFFLINE_WEIGHTS_ROUNDED, WEIGHT_WINDOWS
from rekindle.levels import LEAF, MID
from rekindle.operators import activity as act
from rekindle.operators import intervals as gaps
from rekindle.operators import joins as jn
from rekindle.operators import metrics, model
from rekindle.operators.attributes import item_attributes
from rekindle.operators.labels import label_reinterest
from rekindle.operators.similarity import MEASURES, STATS, similarity_name
from rekindle.plans.features import BASE_GRID, WATCH_GRID, FeatureGrid, counts_only, feature_matrix, level_names
from rekindle.plans.training import prepare, train_eval
from rekindle.session import cut_lineage
from rekindle.sources.supplied import Supplied

MONTH_GRID = FeatureGrid(
    count_windows=(1, 2, 5, 7, 14), amount_windows=(7, 14), similarity_windows=(7, 14), zscore_windows=(2, 7, 14), norm_windows=(1, 2, 5, 7, 14),
    ratio_windows=(7, 14), weight_windows=(2, 7, 14), weights=(0.5, 0.3, 0.2),
)


def flagship(t: Supplied) -> DataFrame:
    """All anchors at the reference date with every feature family and the re-interest label."""
    events, names = cut_lineage(t.actions()), cut_lineage(level_names(t.category_names()))
    # labelled while narrow; the wide rows are not moved for it
    anchors = cut_lineage(label_reinterest(ref_anchors(t), t.views(), REF))
    matrix = feature_matrix(anchors, events, MONTH_GRID, ref_date=REF, names=names)
    return matrix.select(*[c for c in matrix.columns if c != "reinterest_label"], "reinterest_label")


def _matrix_sql(prelude: str, labelled: bool = True, g: FeatureGrid = MONTH_GRID, names: str = NAMES) -> str:
    """Every family of the grid by plain joins, side by side per level."""
    ctes, joins, cols, doubles = [], [], [], []

    def of(action: str, text: str) -> str:
        for a, b in (("'view'", f"'{action}'"), ("f_num_views", f"f_num_{action}s"), ("f_entropy_for_views", f"f_entropy_for_{action}s")):
            text = text.replace(a, b)
        return text

    for a in g.actions:
        ctes.append(f"tot_{a} AS (SELECT * FROM {of(a, ft.totals_sql(g.norm_windows))})")
        joins.append(f"JOIN tot_{a} ON tot_{a}.user_id = a.user_id AND tot_{a}.event_ts = a.event_ts")
    for lv in g.levels:
        def family(name: str, template: str, lv=lv) -> str:
            alias = f"{name}_{lv.name}"
            ctes.append(f"{alias} AS (SELECT * FROM ({template.replace('{L}', lv.name).replace('{K}', keyed_anchors(lv.name))}))")
            joins.append(f"JOIN {alias} ON {alias}.user_id = a.user_id AND {alias}.category_id = a.{lv.id} AND {alias}.event_ts = a.event_ts")
            return alias

        def add(expr: str, name: str, double: bool = False) -> None:
            cols.append(f"{expr} AS {name}")
            if double:
                doubles.append(name)

        scores = ", ".join(
            f"CASE WHEN STDDEV_SAMP(f_num_{a}s_from_in_last_{n}_days) OVER w > 0 THEN (f_num_{a}s_from_in_last_{n}_days - AVG(f_num_{a}s_from_in_last_{n}_days) OVER w)"
            f" / STDDEV_SAMP(f_num_{a}s_from_in_last_{n}_days) OVER w ELSE 0.0 END AS z_{a}_{n}" for a in g.actions for n in g.zscore_windows
        )
        c = family("cnt", f"SELECT *, {scores} FROM ({ft._counts_sql(g.count_windows, g.actions)}) WINDOW w AS (PARTITION BY category_id)")

        def num(a: str, n: int, c=c) -> str:
            return f"{c}.f_num_{a}s_from_in_last_{n}_days"

        r = family("rec", f"{ft.HEAD}, {ft.last_sql(g.actions)} FROM {ft.JOINED} {ft.TAIL}")
        m = family("amt", f"{ft.HEAD}, {ft.AMOUNTS} FROM {ft.JOINED} {ft.TAIL}") if g.amount_windows else ""
        for a in g.actions:
            for n in g.count_windows:
                add(num(a, n), act.count_name(a, lv, n))
                add(f"CASE WHEN tot_{a}.t{n} > 0 THEN ROUND({num(a, n)} / tot_{a}.t{n}, 5) ELSE -1.0 END", act.norm_name(a, lv, n), True)
            for n in g.zscore_windows:
                add(f"{c}.z_{a}_{n}", act.zscore_name(a, lv, n), True)
            add(" + ".join(f"{w}::DOUBLE * {num(a, n)}" for n, w in zip(g.weight_windows, g.weights)), act.weighted_name(a, lv), True)
            add(f"{r}.f_time_since_last_{a}_from", act.recency_name(a, lv))
            e = family(f"ent_{a}", of(a, ft.DAY_ENTROPY))
            add(f"{e}.f_entropy_for_{a}s", f"f_entropy_for_{lv.name}_cat_{a}s", True)
            pool = f"SELECT DISTINCT a.user_id, a.{lv.id}, a.event_ts, n.{lv.label} FROM anchors a JOIN names n USING (leaf_id)"
            sims = ft.similarity_sql(lv, a, g.similarity_windows, "word", lv.label, lv.label, ("user_id", lv.id, "event_ts"), f"{lv.name}_cat", f"{prelude}, {names}, {ft.NAMED}", pool)
            s = family(f"sim_{a}", f"SELECT * EXCLUDE ({lv.id}), {lv.id} AS category_id FROM ({sims})")
            for n in g.similarity_windows:
                for x in MEASURES:
                    for st in STATS:
                        name = similarity_name(st, f"{lv.name}_cat", a, x, n)
                        add(f"{s}.{name}", name, True)
        for x, y in g.ratios:
            for n in g.ratio_windows:
                add(f"CASE WHEN {num(y, n)} = 0 THEN -1.0 ELSE {num(x, n)} / {num(y, n)} END", act.ratio_name(x, y, lv, n), True)
        for n in g.amount_windows:
            for st in ("sum", "mean", "max", "min", "var"):
                add(f"{m}.f_{st}_amount_from_in_last_{n}_days", act.amount_name(st, lv, n), True)
        for alias, template, named in (
            ("fv", ft.FIRST_VIEW, gaps.first_view_fills(lv)), ("btw", ft.BETWEEN, gaps.between_fills(lv)), ("snc", ft.SINCE, gaps.since_fills(lv)),
        ):
            i = family(alias, template)
            for name, fill in named.items():
                add(f"{i}.{name.removesuffix(f'_{lv.name}_cat')}", name, isinstance(fill, float))
    label = f"""CASE WHEN EXISTS (SELECT 1 FROM actions e WHERE e.user_id = a.user_id AND e.leaf_id = a.leaf_id
      AND e.event_type = 'view' AND e.event_ts > TIMESTAMP '{REF}') THEN 1 ELSE 0 END AS reinterest_label"""
    cols += [label] if labelled else []
    head = f"{prelude}, " + ", ".join(ctes)
    return sql_rounded(f"{head} SELECT a.user_id, a.leaf_id, a.mid_id, a.top_id, a.event_ts, {', '.join(cols)} FROM anchors a {' '.join(joins)}", doubles)


#: Features of several levels, families, actions and windows.
NAMED = [
    "f_num_views_from_leaf_cat_in_last_5_days", "f_num_purchases_from_mid_cat_in_last_14_days", "f_time_since_last_view_from_top_cat", "f_time_since_last_purchase_from_leaf_cat",
    "f_norm_num_views_from_leaf_cat_in_last_7_days", "f_norm_num_purchases_from_top_cat_in_last_14_days", "f_user_vs_mean_view_from_mid_cat_in_last_7_days",
    "f_weighted_num_views_from_leaf_cat", "f_weighted_num_purchases_from_mid_cat", "f_view_to_purchase_ratio_from_leaf_cat_in_last_14_days", "f_entropy_for_mid_cat_views",
    similarity_name("mean", "leaf_cat", "view", "cosine", 14), similarity_name("p75", "mid_cat", "purchase", "jaccard", 7), similarity_name("max", "leaf_cat", "purchase", "cosine", 7),
    gaps.since_names(LEAF)["views"], gaps.first_view_names(MID)["mean"], *list(gaps.between_fills(LEAF))[:2], act.amount_name("var", MID, 14), act.amount_name("max", LEAF, 7),
]


@query("feature_matrix_named", f"SELECT user_id, leaf_id, mid_id, top_id, event_ts, {', '.join(NAMED)} FROM ({_matrix_sql(WITH_REF, labelled=False)})")
def _(t):
    events, names = cut_lineage(t.actions()), cut_lineage(level_names(t.category_names()))
    return feature_matrix(cut_lineage(ref_anchors(t)), events, MONTH_GRID, ref_date=REF, names=names, columns=NAMED)


@query("feature_matrix", _matrix_sql(WITH_REF))
def _(t):
    return flagship(t)


@query("feature_matrix_many_days", _matrix_sql(WITH_CLICKS, labelled=False))
def _(t):
    events, names = cut_lineage(t.actions()), cut_lineage(level_names(t.category_names()))
    return feature_matrix(click_anchors(t), events, MONTH_GRID, names=names)


# ---- the full grids, on data of several years ------------------------------------------------------

YEARS_REF = "1998-01-01"
_LINES = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
YEARS = f"""WITH actions AS (SELECT ROW_NUMBER() OVER () AS event_id, o_custkey AS user_id, event_ts, event_type, l_extendedprice AS amount,
    l_partkey AS item_id, l_partkey AS leaf_id, l_partkey // 10 AS mid_id, l_partkey // 50 AS top_id FROM (
      SELECT *, 'purchase' AS event_type, o_orderdate AS event_ts {_LINES}
      UNION ALL SELECT *, 'view', l_shipdate {_LINES}
      UNION ALL SELECT *, 'watch', l_shipdate + to_days(l_linenumber) {_LINES} WHERE l_quantity > 25)),
  anchors AS (SELECT DISTINCT user_id, leaf_id, mid_id, top_id, TIMESTAMP '{YEARS_REF}' AS event_ts FROM actions
    WHERE event_type = 'purchase' AND event_ts >= TIMESTAMP '{YEARS_REF}' - INTERVAL 60 DAY AND event_ts < TIMESTAMP '{YEARS_REF}')"""


def year_lines(t: Supplied) -> DataFrame:
    """Order lines with what their events are made of."""
    li, o = t.table("lineitem"), t.table("orders")
    return li.join(o.hint("merge"), li.l_orderkey == o.o_orderkey).select("o_custkey", "l_extendedprice", "l_partkey", "o_orderdate", "l_shipdate", "l_linenumber", "l_quantity")


def year_events(lines: DataFrame) -> DataFrame:
    """Orders as purchases, shipments as views, and of large quantities a watch some days later."""
    kinds = F.expr("""inline(filter(array(
        named_struct('event_type', 'purchase', 'event_ts', o_orderdate), named_struct('event_type', 'view', 'event_ts', l_shipdate),
        named_struct('event_type', 'watch', 'event_ts', l_shipdate + make_dt_interval(l_linenumber))), x -> x.event_type <> 'watch' OR l_quantity > 25))""")
    key = F.col("l_partkey")
    tree = [key.alias("item_id"), key.alias("leaf_id"), F.floor(key / 10).alias("mid_id"), F.floor(key / 50).alias("top_id")]
    return lines.select(F.col("o_custkey").alias("user_id"), F.col("l_extendedprice").alias("amount"), *tree, kinds)


def _years_matrix(t: Supplied, grid: FeatureGrid, columns: list[str] | None = None) -> DataFrame:
    # a line is stored once, and not as its two or three events
    events, names = year_events(cut_lineage(year_lines(t))), cut_lineage(level_names(t.category_names()))
    ref = F.lit(YEARS_REF).cast("timestamp")
    bought = events.where((F.col("event_type") == "purchase") & (F.col("event_ts") < ref) & (F.col("event_ts") >= ref - F.expr("INTERVAL 60 DAY")))
    anchors = bought.select("user_id", "leaf_id", "mid_id", "top_id").distinct().withColumn("event_ts", ref)
    return feature_matrix(cut_lineage(anchors), events, grid, ref_date=YEARS_REF, names=names, columns=columns)


@query("feature_matrix_base_grid", _matrix_sql(YEARS, labelled=False, g=BASE_GRID))
def _(t):
    return _years_matrix(t, BASE_GRID)


@query("feature_matrix_watch_grid", _matrix_sql(YEARS, labelled=False, g=WATCH_GRID))
def _(t):
    return _years_matrix(t, WATCH_GRID)


def _count_grid_sql() -> str:
    levels = ("leaf", "mid", "top")
    counts = ", ".join(
        f"COUNT(CASE WHEN e.event_type = '{x}' AND e.{lv}_id = a.{lv}_id AND {AGE} <= {n} THEN 1 END) AS f_num_{x}s_from_{lv}_cat_in_last_{n}_days"
        for lv in levels for x in ("purchase", "view") for n in WINDOWS
    )
    recency = ", ".join(
        f"CAST(COALESCE(date_diff('day', CAST(MAX(CASE WHEN e.event_type = '{x}' AND e.{lv}_id = a.{lv}_id THEN e.event_ts END) AS DATE), DATE '{REF}'), -1) AS INTEGER) AS f_time_since_last_{x}_from_{lv}_cat"
        for lv in levels for x in ("purchase", "view")
    )
    return f"""{WITH_REF} SELECT a.user_id, a.leaf_id, a.mid_id, a.top_id, a.event_ts, {counts}, {recency}
      FROM anchors a LEFT JOIN actions e ON e.user_id = a.user_id AND e.top_id = a.top_id AND {AGE} >= 1 GROUP BY a.user_id, a.leaf_id, a.mid_id, a.top_id, a.event_ts"""


@query("count_grid", _count_grid_sql())
def _(t):
    """The whole count and recency grid, all levels in one plan."""
    return feature_matrix(ref_anchors(t), t.actions(), counts_only(WINDOWS, ("purchase", "view")), ref_date=REF)


COHORT = f"cohort AS (SELECT user_id FROM actions WHERE event_type = 'purchase' AND event_ts < TIMESTAMP '{REF}')"


@query("j1_cohort_semi_join", f"WITH {ACTIONS}, {COHORT} SELECT event_id, user_id, event_type FROM actions WHERE user_id IN (SELECT user_id FROM cohort)")
def _(t):
    cohort = t.purchases().where(F.col("event_ts") < F.lit(REF).cast("timestamp"))
    return jn.cohort_semi_join(t.actions().select("event_id", "user_id", "event_type"), cohort)


@query(
    "j2_item_dimension_join",
    f"""WITH {ORDER_LINES}, {ITEMS} SELECT l.user_id, l.item_id, l.txn_id, l.line, lower(i.title) AS title FROM lines l JOIN items i USING (item_id) WHERE i.end_date >= DATE '2024-01-01'""",
)
def _(t):
    lines = t.order_lines().select("user_id", "item_id", "txn_id", "line")
    return lines.join(jn.item_dimension(t.items(), lines, "2024-01-01").select("item_id", "title"), "item_id")


@query("j3_category_enrich", f"WITH {CATEGORIES}, {ORDER_LINES} SELECT l.user_id, l.txn_id, l.line, c.* FROM lines l JOIN active c USING (site_id, leaf_id)")
def _(t):
    return jn.category_enrich(t.order_lines().select("user_id", "txn_id", "line", "site_id", "leaf_id"), t.categories())


@query("j4_anchor_category_enrich", f"{WITH_REF}, {CATEGORIES} SELECT a.user_id, a.event_ts, c.* EXCLUDE (site_id) FROM anchors a JOIN active c ON c.leaf_id = a.leaf_id AND c.site_id = 0")
def _(t):
    return jn.anchor_category_enrich(ref_anchors(t).select("user_id", "leaf_id", "event_ts"), t.categories())


@query(
    "j5_item_enrich",
    f"""WITH {CATEGORIES}, {ITEMS}, {ACTIONS} SELECT e.event_id, e.item_id, lower(i.title) AS title, i.site_id, i.leaf_id, c.leaf_name, c.mid_id, c.mid_name, c.top_id, c.top_name,
      'brand=' || lower(p_brand) || ';size=' || p_size || ';type=' || lower(CASE WHEN (length(p_name), p_name) < (length(p_type), p_type) THEN p_name ELSE p_type END) AS attributes
      FROM actions e JOIN items i USING (item_id) JOIN active c ON c.leaf_id = i.leaf_id AND c.site_id = i.site_id JOIN part ON p_partkey = e.item_id
      WHERE i.end_date >= DATE '2024-01-01'""",
)
def _(t):
    events = t.actions().select("event_id", "item_id")
    attrs = item_attributes(t.item_attrs(), t.items())
    joined = jn.item_enrich(events, t.items(), t.categories(), attrs, "2024-01-01")
    text = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return joined.withColumn("attributes", text)


@query(
    "j6_returned_item_exclusion",
    f"""WITH {ORDER_LINES} SELECT user_id, item_id, txn_id, line FROM lines l WHERE NOT EXISTS
      (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_partkey = l.item_id AND r.l_orderkey = l.txn_id)""",
)
def _(t):
    return jn.exclude_returned(t.order_lines().select("user_id", "item_id", "txn_id", "line"), t.returns())


@query(
    "j7_windowed_event_join",
    f"""{WITH_CLICKS} SELECT a.user_id, a.mid_id, a.event_ts, COUNT(e.event_id) AS f_num_views_from_mid_cat_in_last_14_days
      FROM (SELECT DISTINCT user_id, mid_id, event_ts FROM anchors) a LEFT JOIN actions e ON e.user_id = a.user_id AND e.mid_id = a.mid_id AND e.event_type = 'view' AND {AGE} BETWEEN 1 AND 14 GROUP BY ALL""",
)
def _(t):
    return act.count_windows(click_anchors(t), t.actions(), MID, "view", [14])


@query(
    "j8_past_event_join",
    f"""{WITH_CLICKS} SELECT a.user_id, a.mid_id, a.event_ts, CAST(COALESCE(MIN({AGE}), -1) AS INTEGER) AS f_time_since_last_purchase_from_mid_cat
      FROM (SELECT DISTINCT user_id, mid_id, event_ts FROM anchors) a LEFT JOIN actions e ON e.user_id = a.user_id AND e.mid_id = a.mid_id AND e.event_type = 'purchase' AND {AGE} >= 1 GROUP BY ALL""",
)
def _(t):
    return act.days_since_last(click_anchors(t), t.actions(), MID, "purchase")


@query(
    "j9_user_only_window_join",
    f"""{WITH_CLICKS} SELECT a.user_id, a.event_ts, COUNT(CASE WHEN {AGE} <= 7 THEN 1 END) AS total_7, COUNT(CASE WHEN {AGE} <= 14 THEN 1 END) AS total_14
      FROM (SELECT DISTINCT user_id, event_ts FROM anchors) a LEFT JOIN actions e ON e.user_id = a.user_id AND e.event_type = 'view' AND {AGE} >= 1 GROUP BY ALL""",
)
def _(t):
    anchors, wanted = click_anchors(t), {"view": (7, 14)}
    totals = act.user_totals(anchors, t.actions(), wanted)
    found = jn.attach(act.anchor_keys(anchors, None), totals, None, act.total_fills(wanted))
    return found.drop("anchor_day").withColumnsRenamed({act.total_name("view", n): f"total_{n}" for n in (7, 14)})


@query(
    "j10_future_label_join",
    f"""{WITH_CLICKS}, later AS (SELECT * FROM actions WHERE event_type = 'purchase' AND CAST(event_ts AS DATE) > DATE '2024-01-10' AND CAST(event_ts AS DATE) <= DATE '2024-01-31')
      SELECT a.user_id, a.leaf_id, a.event_ts, COUNT(e.event_id) AS num_repurchases, CASE WHEN COUNT(e.event_id) > 0 THEN 1 ELSE 0 END AS label
      FROM (SELECT DISTINCT user_id, leaf_id, event_ts FROM anchors) a LEFT JOIN later e ON e.user_id = a.user_id AND e.leaf_id = a.leaf_id AND e.event_ts > a.event_ts GROUP BY ALL""",
)
def _(t):
    from dataclasses import replace

    from rekindle.operators.labels import label_repurchases

    config = replace(CONFIG, sampling=replace(CONFIG.sampling, ref_date="2024-01-10"))
    return label_repurchases(click_anchors(t), t.purchases().withColumn("site_id", F.lit(0)), config)


@query(
    "j13_feature_attach",
    f"""{WITH_REF} SELECT a.user_id, a.leaf_id, a.mid_id, a.event_ts, COUNT(e.event_id) AS f_num_views_from_leaf_cat_in_last_7_days FROM anchors a
      LEFT JOIN actions e ON e.user_id = a.user_id AND e.leaf_id = a.leaf_id AND e.event_type = 'view' AND {AGE} BETWEEN 1 AND 7 GROUP BY ALL""",
)
def _(t):
    spec = act.ActivitySpec(counts={"view": (7,)})
    anchors = ref_anchors(t).drop("top_id")
    return jn.attach(anchors, act.level_activity(anchors, t.actions(), LEAF, spec), LEAF, act.fills(spec, LEAF)).drop("anchor_day")


@query(
    "j15_eligibility_flag",
    f"""WITH {ACTIONS} SELECT v.event_id, v.user_id, v.leaf_id, CASE WHEN p.user_id IS NULL THEN 0 ELSE 1 END AS apply_filter FROM actions v
      LEFT JOIN (SELECT DISTINCT user_id, leaf_id FROM actions WHERE event_type = 'purchase') p USING (user_id, leaf_id) WHERE v.event_type = 'view'""",
)
def _(t):
    return jn.eligibility_flag(t.views().select("event_id", "user_id", "leaf_id"), t.purchases())


@query(
    "j16_multi_stat_merge",
    sql_rounded(
        """WITH s AS (SELECT p_brand AS feature, p_size > 25 AS big, AVG(p_retailprice) AS mean, STDDEV_SAMP(p_retailprice) AS std FROM part GROUP BY ALL)
        SELECT a.feature, a.mean AS mean_0, a.std AS std_0, b.mean AS mean_1, b.std AS std_1, b.mean - a.mean AS diff_mean, b.std - a.std AS diff_std
        FROM s a JOIN s b USING (feature) WHERE NOT a.big AND b.big""",
        ["mean_0", "std_0", "mean_1", "std_1", "diff_mean", "diff_std"],
    ),
)
def _(t):
    p = t.table("part")

    def side(where):
        return p.where(where).groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("mean"), F.stddev_samp("p_retailprice").alias("std"))

    return jn.merge_stats(side(F.col("p_size") <= 25), side(F.col("p_size") > 25), "feature", ["mean", "std"])


TRAINING = f"""{WITH_REF}, later AS (SELECT user_id, leaf_id FROM actions WHERE event_type = 'view' AND event_ts > TIMESTAMP '{REF}')
      SELECT a.user_id, a.leaf_id, a.event_ts, COUNT(CASE WHEN e.event_type = 'purchase' AND {AGE} <= 14 THEN 1 END) AS f_num_purchases_from_leaf_cat_in_last_14_days,
        COUNT(CASE WHEN e.event_type = 'view' AND {AGE} <= 14 THEN 1 END) AS f_num_views_from_leaf_cat_in_last_14_days,
        CAST(COALESCE(MIN(CASE WHEN e.event_type = 'purchase' THEN {AGE} END), -1) AS INTEGER) AS f_time_since_last_purchase_from_leaf_cat,
        CAST(COALESCE(MIN(CASE WHEN e.event_type = 'view' THEN {AGE} END), -1) AS INTEGER) AS f_time_since_last_view_from_leaf_cat,
        MAX(CASE WHEN (a.user_id, a.leaf_id) IN (SELECT (user_id, leaf_id) FROM later) THEN 1 ELSE 0 END) AS reinterest_label
      FROM anchors a JOIN actions e ON e.user_id = a.user_id AND e.leaf_id = a.leaf_id AND {AGE} >= 1
      WHERE a.user_id IN (SELECT user_id FROM later) GROUP BY a.user_id, a.leaf_id, a.event_ts
      HAVING f_num_purchases_from_leaf_cat_in_last_14_days > 0"""


def training_matrix(t: Supplied) -> DataFrame:
    matrix = feature_matrix(ref_anchors(t), t.actions(), counts_only((14,), ("purchase", "view"), (LEAF,)), ref_date=REF)
    return prepare(matrix, t.views(), CONFIG, labels=(), active_column="f_num_purchases_from_leaf_cat_in_last_14_days")


@query("training_rows", TRAINING)
def _(t):
    return training_matrix(t)


_UNIT = sql_unit("user_id", "leaf_id", "event_ts")


@query(
    "training_frames",
    f"""WITH rows AS ({TRAINING}), parts AS (SELECT *, CASE WHEN {_UNIT} < 0.7 THEN 'train' WHEN {_UNIT} < 0.8 THEN 'validation' ELSE 'test' END AS part FROM rows),
      ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY reinterest_label ORDER BY {sql_hash("user_id", "leaf_id", "event_ts", seed=123)}, user_id, leaf_id, event_ts) AS nth FROM parts WHERE part = 'train'),
      least AS (SELECT LEAST(SUM(reinterest_label), COUNT(*) - SUM(reinterest_label)) AS n FROM parts WHERE part = 'train')
      SELECT part, user_id, leaf_id, event_ts, reinterest_label FROM ranked, least WHERE nth <= n
      UNION ALL SELECT part, user_id, leaf_id, event_ts, reinterest_label FROM parts WHERE part <> 'train'""",
)
def _(t):
    frames = zip(("train", "validation", "test"), train_eval(cut_lineage(training_matrix(t))))
    parts = [df.select(F.lit(part).alias("part"), "user_id", "leaf_id", "event_ts", "reinterest_label") for part, df in frames]
    return parts[0].union(parts[1]).union(parts[2])


@query("end_to_end_segments")
def _(t):
    """Anchors to matrix, split, fit, score and segment metrics."""
    train, _, test = train_eval(cut_lineage(training_matrix(t)))
    features = [c for c in test.columns if c.startswith("f_")]
    _, scored = model.train_and_score(train, test, features, "reinterest_label", model.TreeParams(trees=5, depth=3))
    return metrics.segment_metrics(scored, "reinterest_label", "pred", min_views=(1, 2), windows=(14,))


def _offline(weights, column: str, action: str) -> str:
    return " + ".join(f"{w}::DOUBLE * f_num_{action}s_from_in_last_{n}_days" for n, w in zip(WEIGHT_WINDOWS, weights)) + f" AS {column}"


@query(
    "g16_weighted_count_reference_weights",
    sql_rounded(
        f"""{YEARS} SELECT user_id, category_id AS mid_id, event_ts, {_offline(OFFLINE_WEIGHTS, "f_views", "view")}, {_offline(OFFLINE_WEIGHTS_ROUNDED, "f_views_rounded", "view")},
          {_offline(OFFLINE_WEIGHTS, "f_purchases", "purchase")}, {_offline(OFFLINE_WEIGHTS_ROUNDED, "f_purchases_rounded", "purchase")}
          FROM ({ft._counts_sql(WEIGHT_WINDOWS).replace("{L}", "mid").replace("{K}", keyed_anchors("mid"))})""",
        ["f_views", "f_views_rounded", "f_purchases", "f_purchases_rounded"],
    ),
)
def _(t):
    """Both weight vectors over all their windows, on counts of a year."""
    counted = _years_matrix(t, BASE_GRID, [act.count_name(a, MID, n) for a in ("view", "purchase") for n in WEIGHT_WINDOWS])
    weighted = [
        act.weighted_count_offline(counted, MID, a, WEIGHT_WINDOWS, w).alias(f"f_{a}s{suffix}")
        for a in ("view", "purchase") for w, suffix in ((OFFLINE_WEIGHTS, ""), (OFFLINE_WEIGHTS_ROUNDED, "_rounded"))
    ]
    return counted.select("user_id", "mid_id", "event_ts", *weighted).distinct()
