"""Behavioural features against plain theta joins in SQL."""

from functools import reduce

from pyspark.sql import functions as F

from queries.common import (
    AGE, NAMES, REF, WINDOWS, WITH_CLICKS, WITH_REF, click_anchors, keyed_anchors, query, ref_anchors, sql_rounded, with_names,
)
from rekindle.levels import LEVELS, LEAF, MID, TOP
from rekindle.operators import activity as act
from rekindle.operators import entropy, intervals, similarity

ALL = " UNION ALL BY NAME ".join


def per_level(build):
    """One frame for all levels: (level, category_id, …) with level-neutral feature names."""
    frames = []
    for lv in LEVELS:
        df = build(lv)
        names = {c: c.replace(f"_{lv.name}_cat", "") for c in df.columns if c.startswith("f_")}
        frames.append(df.withColumnsRenamed(names | {lv.id: "category_id"}).withColumn("level", F.lit(lv.name)))
    return reduce(lambda a, b: a.unionByName(b), frames)


def levels_sql(template: str, prelude: str, doubles=()) -> str:
    body = ALL("(" + template.replace("{L}", lv.name).replace("{K}", keyed_anchors(lv.name)) + ")" for lv in LEVELS)
    sql = f"{prelude} SELECT * FROM ({body})"
    return sql_rounded(sql, doubles) if doubles else sql


JOINED = f"""{{K}} a LEFT JOIN actions e ON e.user_id = a.user_id AND e.{{L}}_id = a.{{L}}_id AND {AGE} >= 1"""
HEAD = "SELECT a.user_id, a.{L}_id AS category_id, a.event_ts, '{L}' AS level"
TAIL = "GROUP BY a.user_id, a.{L}_id, a.event_ts"


def _counts_sql(windows=WINDOWS, actions=("view", "purchase")) -> str:
    cols = ", ".join(
        f"COUNT(CASE WHEN e.event_type = '{x}' AND {AGE} <= {n} THEN 1 END) AS f_num_{x}s_from_in_last_{n}_days" for x in actions for n in windows
    )
    return f"{HEAD}, {cols} FROM {JOINED} {TAIL}"


def _spec(windows=WINDOWS, actions=("view", "purchase")):
    return act.ActivitySpec(counts={a: tuple(windows) for a in actions})


@query("g1_count_window", levels_sql(_counts_sql(), WITH_REF))
def _(t):
    return per_level(lambda lv: act.activity(ref_anchors(t), t.actions(), lv, _spec(), ref_date=REF))


@query("g1_count_window_many_days", levels_sql(_counts_sql(), WITH_CLICKS))
def _(t):
    return per_level(lambda lv: act.activity(click_anchors(t), t.actions(), lv, _spec()))


@query(
    "g1_count_window_repeated_rows",
    levels_sql(_counts_sql().replace("{K} a", "anchors a"), WITH_REF),
)
def _(t):
    return per_level(lambda lv: act.activity(ref_anchors(t), t.actions(), lv, _spec(), repeat_anchor_rows=True))


def last_sql(actions) -> str:
    return ", ".join(
        f"CAST(COALESCE(date_diff('day', CAST(MAX(CASE WHEN e.event_type = '{x}' THEN e.event_ts END) AS DATE), CAST(a.event_ts AS DATE)), -1) AS INTEGER) AS f_time_since_last_{x}_from"
        for x in actions
    )


LAST = last_sql(("view", "purchase"))


@query("g2_days_since_last", levels_sql(f"{HEAD}, {LAST} FROM {JOINED} {TAIL}", WITH_REF))
def _(t):
    spec = act.ActivitySpec(recency=("view", "purchase"))
    return per_level(lambda lv: act.activity(ref_anchors(t), t.actions(), lv, spec, ref_date=REF))


@query("g2_days_since_last_many_days", levels_sql(f"{HEAD}, {LAST} FROM {JOINED} {TAIL}", WITH_CLICKS))
def _(t):
    return per_level(lambda lv: act.activity(click_anchors(t), t.actions(), lv, act.ActivitySpec(recency=("view", "purchase"))))


AMOUNT_DOUBLES = [f"f_{s}_amount_from_in_last_{n}_days" for s in ("sum", "mean", "max", "min", "var") for n in (7, 14)]
AMOUNTS = ", ".join(
    f"COALESCE({f}(CASE WHEN e.event_type = 'purchase' AND {AGE} <= {n} THEN e.amount END), {v}) AS f_{s}_amount_from_in_last_{n}_days"
    for n in (7, 14)
    for s, f, v in (("sum", "SUM", 0), ("mean", "AVG", 0), ("max", "MAX", -1), ("min", "MIN", -1), ("var", "VAR_SAMP", -1))
)


#: Variances of cents can end in a five at the seventh place; a nudge keeps the sixth from hanging on the last bit.
NUDGE = 2e-7
VARS = [c for c in AMOUNT_DOUBLES if c.startswith("f_var_")]


def off_ties(df):
    return df.withColumns({c: F.col(c) + NUDGE for c in VARS})


def off_ties_sql(prelude: str) -> str:
    moved = ", ".join(f"{c} + {NUDGE}::DOUBLE AS {c}" for c in VARS)
    return sql_rounded(f"SELECT * REPLACE ({moved}) FROM ({levels_sql(f'{HEAD}, {AMOUNTS} FROM {JOINED} {TAIL}', prelude)})", AMOUNT_DOUBLES)


@query("g3_amount_stats", off_ties_sql(WITH_REF))
def _(t):
    return off_ties(per_level(lambda lv: act.amount_stats(ref_anchors(t), t.actions(), lv, "purchase", (7, 14), ref_date=REF)))


@query("g3_amount_stats_many_days", off_ties_sql(WITH_CLICKS))
def _(t):
    return off_ties(per_level(lambda lv: act.amount_stats(click_anchors(t), t.actions(), lv, "purchase", (7, 14))))


def totals_sql(windows) -> str:
    return f"""(SELECT a.user_id, a.event_ts, {", ".join(f"COUNT(CASE WHEN {AGE} <= {n} THEN 1 END) AS t{n}" for n in windows)}
  FROM (SELECT DISTINCT user_id, event_ts FROM anchors) a LEFT JOIN actions e ON e.user_id = a.user_id AND e.event_type = 'view' AND {AGE} >= 1
  GROUP BY a.user_id, a.event_ts)"""


TOTALS = totals_sql(WINDOWS)


def _norm_sql() -> str:
    cols = ", ".join(
        f"CASE WHEN t{n} > 0 THEN ROUND(f_num_views_from_in_last_{n}_days / t{n}, 5) ELSE -1.0 END AS f_norm_num_views_from_in_last_{n}_days" for n in WINDOWS
    )
    return f"SELECT c.user_id, c.category_id, c.event_ts, c.level, {cols} FROM ({_counts_sql(actions=('view',))}) c JOIN {TOTALS} u USING (user_id, event_ts)"


@query("g4_normalised_count", levels_sql(_norm_sql(), WITH_REF))
def _(t):
    return per_level(lambda lv: act.normalised_counts(ref_anchors(t), t.actions(), lv, "view", WINDOWS, ref_date=REF))


@query("g4_normalised_count_many_days", levels_sql(_norm_sql(), WITH_CLICKS))
def _(t):
    return per_level(lambda lv: act.normalised_counts(click_anchors(t), t.actions(), lv, "view", WINDOWS))


RATIOS = [f"f_view_to_purchase_ratio_from_in_last_{n}_days" for n in WINDOWS]


def _ratio_sql() -> str:
    cols = ", ".join(
        f"CASE WHEN f_num_purchases_from_in_last_{n}_days = 0 THEN -1.0 ELSE f_num_views_from_in_last_{n}_days / f_num_purchases_from_in_last_{n}_days END AS {c}"
        for n, c in zip(WINDOWS, RATIOS)
    )
    return f"SELECT user_id, category_id, event_ts, level, {cols} FROM ({_counts_sql()})"


@query("g5_action_ratio", levels_sql(_ratio_sql(), WITH_REF, RATIOS))
def _(t):
    return per_level(lambda lv: act.action_ratios(ref_anchors(t), t.actions(), lv, ("view", "purchase"), WINDOWS, ref_date=REF))


WEIGHTED = dict(zip((1, 2, 7, 14), (0.4, 0.3, 0.2, 0.1)))


@query(
    "g6_weighted_count",
    levels_sql(
        "SELECT user_id, category_id, event_ts, level, "
        + " + ".join(f"{w}::DOUBLE * f_num_views_from_in_last_{n}_days" for n, w in WEIGHTED.items())
        + f" AS f_weighted_num_views_from FROM ({_counts_sql(tuple(WEIGHTED), ('view',))})",
        WITH_REF,
        ["f_weighted_num_views_from"],
    ),
)
def _(t):
    return per_level(lambda lv: act.weighted_counts(ref_anchors(t), t.actions(), lv, "view", tuple(WEIGHTED), tuple(WEIGHTED.values()), ref_date=REF))


ZSCORES = [f"f_user_vs_mean_view_from_in_last_{n}_days" for n in (7, 14)]


def _zscore_sql() -> str:
    cols = ", ".join(
        f"CASE WHEN STDDEV_SAMP(f_num_views_from_in_last_{n}_days) OVER w > 0 THEN "
        f"(f_num_views_from_in_last_{n}_days - AVG(f_num_views_from_in_last_{n}_days) OVER w) / STDDEV_SAMP(f_num_views_from_in_last_{n}_days) OVER w ELSE 0.0 END AS {c}"
        for n, c in zip((7, 14), ZSCORES)
    )
    return f"SELECT user_id, category_id, event_ts, level, {cols} FROM ({_counts_sql((7, 14), ('view',))}) WINDOW w AS (PARTITION BY category_id)"


@query("g7_zscore_vs_population", levels_sql(_zscore_sql(), WITH_REF, ZSCORES))
def _(t):
    return per_level(lambda lv: act.count_zscores(ref_anchors(t), t.actions(), lv, "view", (7, 14), ref_date=REF))


ENTROPY = """SELECT a.user_id, a.{L}_id AS category_id, a.event_ts, '{L}' AS level, COALESCE(h.h, -1.0) AS f_entropy_for_views
  FROM {K} a LEFT JOIN (
    SELECT user_id, ROUND(ABS(SUM(-p * LOG2(p))), 4) AS h FROM (
      SELECT user_id, n / SUM(n) OVER (PARTITION BY user_id) AS p FROM (SCOPE)) GROUP BY user_id) h USING (user_id)"""
ANCHOR_SCOPE = f"""SELECT e.user_id, e.{{L}}_id, COUNT(*) AS n FROM {{A}} a JOIN actions e ON e.user_id = a.user_id AND e.{{L}}_id = a.{{L}}_id
  AND e.event_type = 'view' AND {AGE} >= 1 GROUP BY ALL"""
# an event before several anchors of its category counts once
ONCE_SCOPE = ANCHOR_SCOPE.replace("COUNT(*)", "COUNT(DISTINCT e.event_id)")
# each anchor day looks at what happened before it, in the categories with an anchor on that day
DAY_ENTROPY = f"""SELECT a.user_id, a.{{L}}_id AS category_id, a.event_ts, '{{L}}' AS level, COALESCE(h.h, -1.0) AS f_entropy_for_views
  FROM {{K}} a LEFT JOIN (
    SELECT user_id, day, ROUND(ABS(SUM(-p * LOG2(p))), 4) AS h FROM (
      SELECT user_id, day, n / SUM(n) OVER (PARTITION BY user_id, day) AS p FROM (
        SELECT a.user_id, CAST(a.event_ts AS DATE) AS day, a.{{L}}_id, COUNT(DISTINCT e.event_id) AS n FROM {{K}} a JOIN actions e
          ON e.user_id = a.user_id AND e.{{L}}_id = a.{{L}}_id AND e.event_type = 'view' AND {AGE} >= 1 GROUP BY ALL)) GROUP BY user_id, day) h
    ON h.user_id = a.user_id AND h.day = CAST(a.event_ts AS DATE)"""
ALL_SCOPE = f"""SELECT e.user_id, e.{{L}}_id, COUNT(*) AS n FROM (SELECT user_id, MAX(event_ts) AS event_ts FROM anchors GROUP BY 1) a
  JOIN actions e ON e.user_id = a.user_id AND e.event_type = 'view' AND {AGE} >= 1 GROUP BY ALL"""


def _entropy(t, **kw):
    return per_level(lambda lv: entropy.category_entropy(ref_anchors(t), t.actions(), lv, "view", **kw))


@query("g8_category_entropy", levels_sql(ENTROPY.replace("SCOPE", ANCHOR_SCOPE.replace("{A}", "{K}")), WITH_REF))
def _(t):
    return _entropy(t)


@query("g8_category_entropy_repeated_rows", levels_sql(ENTROPY.replace("SCOPE", ANCHOR_SCOPE.replace("{A}", "anchors")), WITH_REF))
def _(t):
    return _entropy(t, repeat_anchor_rows=True)


@query("g8_category_entropy_many_days", levels_sql(DAY_ENTROPY, WITH_CLICKS))
def _(t):
    return per_level(lambda lv: entropy.category_entropy(click_anchors(t), t.actions(), lv, "view"))


@query("g8_category_entropy_pooled_days", levels_sql(ENTROPY.replace("SCOPE", ONCE_SCOPE.replace("{A}", "{K}")), WITH_CLICKS))
def _(t):
    return per_level(lambda lv: entropy.category_entropy(click_anchors(t), t.actions(), lv, "view", pool_days=True))


@query("g8_category_entropy_many_days_repeated_rows", levels_sql(ENTROPY.replace("SCOPE", ANCHOR_SCOPE.replace("{A}", "anchors")), WITH_CLICKS))
def _(t):
    return per_level(lambda lv: entropy.category_entropy(click_anchors(t), t.actions(), lv, "view", repeat_anchor_rows=True, pool_days=True))


@query("g8_category_entropy_all_categories", levels_sql(ENTROPY.replace("SCOPE", ALL_SCOPE), WITH_REF))
def _(t):
    return _entropy(t, scope="all")


# ---- view-to-purchase intervals ----------------------------------------------------------------

SIDES = """p AS (SELECT DISTINCT user_id, {L}_id AS c, event_ts AS pts FROM actions WHERE event_type = 'purchase'),
  v AS (SELECT DISTINCT user_id, {L}_id AS c, event_ts AS vts FROM actions WHERE event_type = 'view')"""


def day_gap(later, earlier):
    return f"date_diff('day', CAST({earlier} AS DATE), CAST({later} AS DATE))"


FIRST_VIEW = f"""WITH {SIDES},
  f AS (SELECT p.user_id, p.c, p.pts, MIN(v.vts) AS fvts, MIN({day_gap('v.vts', 'p.pts')}) AS d
        FROM p JOIN v ON v.user_id = p.user_id AND v.c = p.c AND {day_gap('v.vts', 'p.pts')} > 0 GROUP BY ALL),
  g AS (SELECT * FROM f QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, c, fvts ORDER BY d) = 1)
  SELECT a.user_id, a.{{L}}_id AS category_id, a.event_ts, '{{L}}' AS level,
    CAST(COALESCE(MIN(d), -1) AS INTEGER) AS f_min_time_since_first_view_after_purchase_in,
    CAST(COALESCE(MAX(d), -1) AS INTEGER) AS f_max_time_since_first_view_after_purchase_in,
    COALESCE(AVG(d), -1.0) AS f_mean_time_since_first_view_after_purchase_in
  FROM {{K}} a LEFT JOIN g ON g.user_id = a.user_id AND g.c = a.{{L}}_id AND {day_gap('a.event_ts', 'g.fvts')} > 0
  GROUP BY a.user_id, a.{{L}}_id, a.event_ts"""


def _interval(t, build, anchors):
    e = t.actions()
    purchases, views = e.where(F.col("event_type") == "purchase"), e.where(F.col("event_type") == "view")
    return per_level(lambda lv: build(anchors(t), purchases, views, lv))


@query("g9_first_view_lag", levels_sql(FIRST_VIEW, WITH_REF, ["f_mean_time_since_first_view_after_purchase_in"]))
def _(t):
    return _interval(t, intervals.first_view_lag, ref_anchors)


@query("g9_first_view_lag_many_days", levels_sql(FIRST_VIEW, WITH_CLICKS, ["f_mean_time_since_first_view_after_purchase_in"]))
def _(t):
    return _interval(t, intervals.first_view_lag, click_anchors)


BETWEEN = f"""WITH {SIDES},
  q AS (SELECT *, COALESCE(LEAD(pts) OVER (PARTITION BY user_id, c ORDER BY pts), TIMESTAMP '9999-12-31') AS npts FROM p),
  m AS (SELECT v.user_id, v.c, v.vts, q.pts, {day_gap('v.vts', 'q.pts')} AS d FROM v JOIN q ON q.user_id = v.user_id AND q.c = v.c AND v.vts > q.pts AND v.vts <= q.npts),
  k AS (SELECT a.user_id, a.{{L}}_id AS c, a.event_ts, m.pts, COUNT(*) AS n, MAX(d) AS d FROM {{K}} a JOIN m ON m.user_id = a.user_id AND m.c = a.{{L}}_id
        AND {day_gap('a.event_ts', 'm.vts')} > 0 AND {day_gap('a.event_ts', 'm.pts')} > 0 GROUP BY ALL),
  r AS (SELECT *, CASE WHEN d > 0 THEN n / d ELSE 0.0 END AS rate FROM k)
  SELECT a.user_id, a.{{L}}_id AS category_id, a.event_ts, '{{L}}' AS level,
    COALESCE(MIN(n), 0) AS f_min_num_views_between_purchases_in, COALESCE(MAX(n), 0) AS f_max_num_views_between_purchases_in,
    COALESCE(AVG(n), 0.0) AS f_mean_num_views_between_purchases_in, COALESCE(MIN(rate), 0.0) AS f_min_views_between_purchases_per_days_in,
    COALESCE(MAX(rate), 0.0) AS f_max_views_between_purchases_per_days_in, COALESCE(AVG(rate), 0.0) AS f_mean_views_between_purchases_per_days_in
  FROM {{K}} a LEFT JOIN r ON r.user_id = a.user_id AND r.c = a.{{L}}_id AND r.event_ts = a.event_ts
  GROUP BY a.user_id, a.{{L}}_id, a.event_ts"""
BETWEEN_DOUBLES = ["f_mean_num_views_between_purchases_in", *[f"f_{s}_views_between_purchases_per_days_in" for s in ("min", "max", "mean")]]


@query("g10_views_between_purchases", levels_sql(BETWEEN, WITH_REF, BETWEEN_DOUBLES))
def _(t):
    return _interval(t, intervals.views_between_purchases, ref_anchors)


@query("g10_views_between_purchases_many_days", levels_sql(BETWEEN, WITH_CLICKS, BETWEEN_DOUBLES))
def _(t):
    return _interval(t, intervals.views_between_purchases, click_anchors)


SINCE = f"""WITH {SIDES},
  j AS (SELECT a.user_id, a.{{L}}_id AS c, a.event_ts, v.vts, p.pts FROM {{K}} a
        JOIN v ON v.user_id = a.user_id AND v.c = a.{{L}}_id AND {day_gap('a.event_ts', 'v.vts')} > 0
        JOIN p ON p.user_id = v.user_id AND p.c = v.c AND {day_gap('v.vts', 'p.pts')} > 0
        QUALIFY ROW_NUMBER() OVER (PARTITION BY a.user_id, a.{{L}}_id, a.event_ts, v.vts ORDER BY p.pts DESC) = 1),
  l AS (SELECT * FROM j QUALIFY RANK() OVER (PARTITION BY user_id, c, event_ts ORDER BY pts DESC) = 1)
  SELECT a.user_id, a.{{L}}_id AS category_id, a.event_ts, '{{L}}' AS level, COUNT(l.vts) AS f_num_views_since_last_purchase_in,
    CAST(COALESCE(MAX({day_gap('l.vts', 'l.pts')}), -1) AS INTEGER) AS f_time_from_last_view_to_last_purchase_in
  FROM {{K}} a LEFT JOIN l ON l.user_id = a.user_id AND l.c = a.{{L}}_id AND l.event_ts = a.event_ts
  GROUP BY a.user_id, a.{{L}}_id, a.event_ts"""


@query("g11_views_since_last_purchase", levels_sql(SINCE, WITH_REF))
def _(t):
    return _interval(t, intervals.views_since_last_purchase, ref_anchors)


@query("g11_views_since_last_purchase_many_days", levels_sql(SINCE, WITH_CLICKS))
def _(t):
    return _interval(t, intervals.views_since_last_purchase, click_anchors)


# ---- similarity ----------------------------------------------------------------------------------

def _tokens_sql(granularity: str) -> str:
    if granularity == "word":
        return r"list_filter(string_split(lower(regexp_replace(x, '\W+', ' ', 'g')), ' '), lambda s: s <> '')"
    return r"list_filter(string_split(lower(regexp_replace(x, '\W+', '', 'g')), ''), lambda s: s <> '')"


def similarity_sql(level, action: str, windows, granularity: str, anchor_text: str, event_text: str, keys, subject: str, prelude: str, pool: str) -> str:
    """Every pair of anchor and event in the window, then plain aggregates."""
    joined = ", ".join(f"b.{k}" for k in keys)
    outs, columns = [], []
    for n in windows:
        for m, c in (("cosine", "cos"), ("jaccard", "jac")):
            def name(s, m=m, n=n):
                return similarity.similarity_name(s, subject, action, m, n)
            inside = f"FILTER (WHERE age <= {n})"
            outs += [
                f"MAX({c}) {inside} AS {name('max')}", f"MIN({c}) {inside} AS {name('min')}", f"AVG({c}) {inside} AS {name('mean')}",
                f"VAR_POP({c}) {inside} AS {name('var')}",
                *[f"QUANTILE_CONT({c}, 0.{q}) {inside} AS {name('p' + q)}" for q in ("25", "50", "75")],
                f"CASE WHEN MIN({c}) {inside} > 0 THEN MAX({c}) {inside} / MIN({c}) {inside} WHEN MIN({c}) {inside} IS NULL THEN NULL ELSE 0.0 END AS {name('scoreratio')}",
                f"AVG({c}) {inside} * EXP(-(AVG({c}) {inside})) AS {name('poisson')}",
            ]
            columns += [name(s) for s in similarity.STATS]
    sql = f"""{prelude},
      base AS ({pool}),
      texts AS (SELECT DISTINCT x FROM (SELECT {anchor_text} AS x FROM base UNION SELECT {event_text} AS x FROM named) WHERE x IS NOT NULL),
      tok AS (SELECT x, unnest({_tokens_sql(granularity)}) AS tk FROM texts),
      cnt AS (SELECT x, tk, COUNT(*) AS n FROM tok GROUP BY ALL),
      nrm AS (SELECT x, SQRT(CAST(SUM(n * n) AS DOUBLE)) AS nn, COUNT(*) AS sz FROM cnt GROUP BY x),
      sims AS (SELECT l.x AS a, r.x AS b, CAST(SUM(l.n * r.n) AS DOUBLE) AS dot, COUNT(*) AS sh FROM cnt l JOIN cnt r USING (tk) GROUP BY ALL),
      s2 AS (SELECT a, b, dot / (l.nn * r.nn) AS cos, sh / (l.sz + r.sz - sh) AS jac FROM sims JOIN nrm l ON l.x = a JOIN nrm r ON r.x = b),
      pairs AS (SELECT {joined}, COALESCE(s2.cos, 0.0) AS cos, COALESCE(s2.jac, 0.0) AS jac, {AGE.replace('a.event_ts', 'b.event_ts')} AS age
        FROM base b JOIN named e ON e.user_id = b.user_id AND e.event_type = '{action}' AND {AGE.replace('a.event_ts', 'b.event_ts')} BETWEEN 1 AND {max(windows)}
        LEFT JOIN s2 ON s2.a = b.{anchor_text} AND s2.b = e.{event_text}),
      stats AS (SELECT {", ".join(keys)}, {", ".join(outs)} FROM pairs GROUP BY {", ".join(keys)})
      SELECT {joined}, {", ".join(columns)} FROM (SELECT DISTINCT {", ".join(keys)} FROM base) b LEFT JOIN stats USING ({", ".join(keys)})"""
    return sql_rounded(sql, columns)


NAMED = "named AS (SELECT e.*, n.leaf_name, n.mid_name, n.top_name, n.leaf_name AS title FROM actions e JOIN names n USING (leaf_id))"
SIM_WINDOWS = (7, 14)


def _category_sql(lv, granularity, prelude=WITH_REF):
    pool = f"SELECT DISTINCT a.user_id, a.{lv.id}, a.event_ts, n.{lv.label} FROM anchors a JOIN names n USING (leaf_id)"
    return similarity_sql(
        lv, "view", SIM_WINDOWS, granularity, lv.label, lv.label, ("user_id", lv.id, "event_ts"), f"{lv.name}_cat", f"{prelude}, {NAMES}, {NAMED}", pool
    )


def _category(t, lv, anchors, **kw):
    return similarity.category_similarity(with_names(t, anchors(t)), t.named_actions(), lv, "view", SIM_WINDOWS, **kw)


@query("g12_category_similarity", _category_sql(LEAF, "word"))
def _(t):
    return _category(t, LEAF, ref_anchors, ref_date=REF)


@query("g12_category_similarity_mid", _category_sql(MID, "word"))
def _(t):
    return _category(t, MID, ref_anchors, ref_date=REF)


@query("g12_category_similarity_top_characters", _category_sql(TOP, "char"))
def _(t):
    return _category(t, TOP, ref_anchors, ref_date=REF, granularity="char")


@query("g12_category_similarity_characters", _category_sql(LEAF, "char"))
def _(t):
    return _category(t, LEAF, ref_anchors, granularity="char")


@query("g12_category_similarity_many_days", _category_sql(LEAF, "word", WITH_CLICKS))
def _(t):
    return _category(t, LEAF, click_anchors)


def _title_pool(alias_sql="anchors"):
    return f"SELECT DISTINCT a.user_id, a.leaf_id AS item_id, n.leaf_name AS title, a.event_ts FROM {alias_sql} a JOIN names n USING (leaf_id)"


@query(
    "g13_title_similarity",
    similarity_sql(LEAF, "purchase", SIM_WINDOWS, "word", "title", "title", ("user_id", "item_id", "title", "event_ts"), "title", f"{WITH_REF}, {NAMES}, {NAMED}", _title_pool()),
)
def _(t):
    anchors = with_names(t, ref_anchors(t)).select("user_id", F.col("leaf_id").alias("item_id"), F.col("leaf_name").alias("title"), "event_ts")
    return similarity.title_similarity(anchors, t.named_actions(), "purchase", SIM_WINDOWS, ref_date=REF)


# ---- derived columns -----------------------------------------------------------------------------

LABELLED = f"""SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM actions x WHERE x.user_id = c.user_id AND x.mid_id = c.category_id AND x.event_type = 'view'
  AND x.event_ts > TIMESTAMP '{REF}') THEN 1 ELSE 0 END AS label FROM ({_counts_sql((2, 5, 7, 14)).replace('{L}', 'mid').replace('{K}', keyed_anchors('mid'))}) c"""


def labelled_mid(t):
    counts = act.activity(ref_anchors(t), t.actions(), MID, _spec((2, 5, 7, 14)), ref_date=REF)
    later = t.views().where(F.col("event_ts") > F.lit(REF).cast("timestamp")).select("user_id", "mid_id").distinct().withColumn("label", F.lit(1))
    return counts.join(later, ["user_id", "mid_id"], "left").fillna(0, subset=["label"])


def _recency_sql() -> str:
    def guard(c):
        return f"CASE WHEN {c} = 0 THEN -1 ELSE {c} END"

    def col(a, n):
        return f"f_num_{a}s_from_in_last_{n}_days"

    exprs = {
        "recent_purchase_ratio": f"{col('purchase', 2)} / ({guard(col('purchase', 14))})",
        "recent_view_ratio": f"{col('view', 2)} / ({guard(col('view', 14))})",
        "view_to_purchase_ratio": f"({guard(col('view', 2))}) / ({guard(col('purchase', 2))})",
        "recent_purchase_ratio_7": f"{col('purchase', 7)} / ({guard(col('purchase', 14))})",
        "recent_view_ratio_7": f"{col('view', 7)} / ({guard(col('view', 14))})",
        "view_to_purchase_ratio_7": f"({guard(col('view', 7))}) / ({guard(col('purchase', 7))})",
    }
    body = ALL(f"SELECT label, '{k}' AS feature, AVG({v}) AS mean, STDDEV_SAMP({v}) AS std FROM x GROUP BY label" for k, v in exprs.items())
    return sql_rounded(f"{WITH_REF}, x AS ({LABELLED}) SELECT * FROM ({body})", ["mean", "std"])


@query("g15_recency_ratio", _recency_sql())
def _(t):
    from rekindle.operators.profiles import ratio_stats

    df = act.recency_ratios(labelled_mid(t), MID, short=(2, 7), long=14)
    names = [c for c in df.columns if "ratio" in c]
    return ratio_stats(df, names, "label")


OFFLINE = dict(zip((2, 5, 7, 14), (0.1, 0.25, 0.3, 0.35)))


@query(
    "g16_weighted_count_offline",
    sql_rounded(
        f"""{WITH_REF}, x AS ({LABELLED}) SELECT user_id, category_id AS mid_id, event_ts, label,
          ROUND({" + ".join(f"{w}::DOUBLE * f_num_views_from_in_last_{n}_days" for n, w in OFFLINE.items())}, 3) AS f_weighted_views,
          {" + ".join(f"{w}::DOUBLE * f_num_purchases_from_in_last_{n}_days" for n, w in OFFLINE.items())} AS f_weighted_purchases FROM x""",
        ["f_weighted_views", "f_weighted_purchases"],
    ),
)
def _(t):
    df = labelled_mid(t)
    w, ws = tuple(OFFLINE), tuple(OFFLINE.values())
    return df.select(
        "user_id", "mid_id", "event_ts", "label",
        act.weighted_count_offline(df, MID, "view", w, ws, 3).alias("f_weighted_views"),
        act.weighted_count_offline(df, MID, "purchase", w, ws).alias("f_weighted_purchases"),
    )
