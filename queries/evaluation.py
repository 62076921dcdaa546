"""Model-evaluation analytics over whole tables."""

from pyspark.sql import functions as F

from queries.common import REF, WITH_REF, query, ref_anchors, sql_rounded, sql_unit
from queries.features import labelled_mid
from rekindle.config import PROFILE_QUANTILES
from rekindle.levels import MID
from rekindle.operators import distribution, metrics, model, profiles, single
from rekindle.operators.activity import count_name

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "gap", "value"]


def scored_lines(t):
    """Order lines as scored rows: label = returned, prediction = large quantity; features with -1, 0, negatives and nulls."""
    li = t.table("lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_quantity") > 30).cast("int").alias("pred"),
        (F.col("l_tax") > 0.03).cast("int").alias("pred_new"),
        "l_quantity", "l_extendedprice", "l_discount",
        F.when(F.col("l_quantity") < 10, -1.0).when(F.col("l_quantity") < 20, 0.0).otherwise(F.col("l_quantity") - 40).alias("gap"),
        F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice") * F.col("l_discount")).alias("value"),
    )


ROWS = """s AS (SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_returnflag = 'R' AS INT) AS label, CAST(l_quantity > 30 AS INT) AS pred, CAST(l_tax > 0.03 AS INT) AS pred_new,
  l_quantity, l_extendedprice, l_discount, CASE WHEN l_quantity < 10 THEN -1.0::DOUBLE WHEN l_quantity < 20 THEN 0.0 ELSE l_quantity - 40 END AS gap,
  CASE WHEN l_discount > 0.02 THEN l_extendedprice * l_discount END AS value FROM lineitem)"""
LONG = f"""{ROWS}, u AS ({" UNION ALL ".join(f"SELECT label, pred, '{f}' AS feature, {f} AS x FROM s" for f in FEATURES)})"""


def metrics_sql(source: str, label: str, pred: str) -> str:
    return f"""SELECT tp, fp, fn, tn, (tp + tn) / n AS accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS roc_auc, (tp + tn) / n AS precision_micro, (tp + tn) / n AS recall_micro,
      (CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END + CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END) / 2 AS precision_macro,
      (tp / (tp + fn) + tn / (tn + fp)) / 2 AS recall_macro
      FROM (SELECT COUNT(CASE WHEN {label} = 1 AND {pred} = 1 THEN 1 END) AS tp, COUNT(CASE WHEN {label} = 0 AND {pred} = 1 THEN 1 END) AS fp,
        COUNT(CASE WHEN {label} = 1 AND {pred} = 0 THEN 1 END) AS fn, COUNT(CASE WHEN {label} = 0 AND {pred} = 0 THEN 1 END) AS tn, COUNT(*) AS n FROM {source})"""


@query("y1_binary_metrics", sql_rounded(metrics_sql("labels", "quality", "toxic"), metrics.METRICS))
def _(t):
    return metrics.binary_metrics(t.table("labels"), "quality", "toxic")


@query(
    "y1_classification_report",
    sql_rounded(
        f"""WITH {ROWS}, c AS (SELECT v AS class, COUNT(CASE WHEN label = v AND pred = v THEN 1 END) AS hit, COUNT(CASE WHEN pred = v THEN 1 END) AS claimed,
          COUNT(CASE WHEN label = v THEN 1 END) AS support FROM s, (VALUES (0), (1)) x(v) GROUP BY v)
          SELECT class, hit / claimed AS precision, hit / support AS recall, 2 * hit / (claimed + support) AS f1, support FROM c""",
        ["precision", "recall", "f1"],
    ),
)
def _(t):
    return metrics.classification_report(scored_lines(t), "label", "pred")


@query(
    "y2_compare_metrics",
    sql_rounded(
        f"""WITH {ROWS}, b AS (UNPIVOT ({metrics_sql('s', 'label', 'pred')}) ON {", ".join(metrics.METRICS)} INTO NAME metric VALUE v),
          w AS (UNPIVOT ({metrics_sql('s', 'label', 'pred_new')}) ON {", ".join(metrics.METRICS)} INTO NAME metric VALUE v)
          SELECT metric, ROUND(b.v, 3) AS baseline, ROUND(w.v, 3) AS new, ROUND(w.v - b.v, 3) AS absolute_difference, ROUND((w.v - b.v) / b.v * 100, 3) AS percent_change FROM b JOIN w USING (metric)""",
        ["baseline", "new", "absolute_difference", "percent_change"],
    ),
)
def _(t):
    rows = scored_lines(t)
    return metrics.compare_metrics(metrics.binary_metrics(rows, "label", "pred"), metrics.binary_metrics(rows, "label", "pred_new"))


SEGMENTS = [(v, d) for v in (1, 2, 5, 10) for d in (2, 7, 14)]


def _segment_sql() -> str:
    counts = ", ".join(f"COUNT(CASE WHEN date_diff('day', CAST(e.event_ts AS DATE), DATE '{REF}') BETWEEN 1 AND {d} THEN 1 END) AS v{d}" for d in (2, 7, 14))
    base = f"""{WITH_REF}, x AS (SELECT a.user_id, a.mid_id, {counts}, MAX(CASE WHEN e.event_ts > TIMESTAMP '{REF}' THEN 1 ELSE 0 END) AS label
      FROM (SELECT DISTINCT user_id, mid_id FROM anchors) a LEFT JOIN actions e ON e.user_id = a.user_id AND e.mid_id = a.mid_id AND e.event_type = 'view' GROUP BY ALL),
      y AS (SELECT *, CAST(v14 > 0 AS INT) AS pred FROM x),
      z AS (SELECT 'All' AS days, 'All' AS views, * FROM y {" ".join(f"UNION ALL SELECT '{d}', '{v}', * FROM y WHERE v{d} >= {v}" for v, d in SEGMENTS)}),
      c AS (SELECT days, views, COUNT(*) AS observations, COUNT(CASE WHEN label = 1 AND pred = 1 THEN 1 END) AS tp, COUNT(CASE WHEN label = 0 AND pred = 1 THEN 1 END) AS fp,
        COUNT(CASE WHEN label = 1 AND pred = 0 THEN 1 END) AS fn, COUNT(CASE WHEN label = 0 AND pred = 0 THEN 1 END) AS tn FROM z GROUP BY ALL)
      SELECT days, views, observations, (tp / NULLIF(tp + fn, 0) + tn / NULLIF(tn + fp, 0)) / 2 AS roc_auc, (tp + tn) / observations AS accuracy,
        COALESCE(tp / NULLIF(tp + fp, 0), 0) AS precision, COALESCE(tp / NULLIF(tp + fn, 0), 0) AS recall, tp + fn AS class_1_count, tp AS correct_predictions,
        tp + fp AS positive_predictions, observations / (SELECT COUNT(*) FROM y) * 100 AS percent_of_observations FROM c"""
    return sql_rounded(base, ["roc_auc", "accuracy", "precision", "recall", "percent_of_observations"])


@query("y3_segment_metrics", _segment_sql())
def _(t):
    rows = labelled_mid(t).withColumn("pred", (F.col(count_name("view", MID, 14)) > 0).cast("int"))
    return metrics.segment_metrics(rows, "label", "pred", windows=(2, 7, 14), column=lambda d: count_name("view", MID, d))


@query(
    "y4_roc_curve",
    sql_rounded(
        f"""WITH {ROWS}, g AS (SELECT l_quantity AS v, SUM(label) AS p, SUM(1 - label) AS n FROM s GROUP BY l_quantity)
          SELECT CAST(v AS DOUBLE) AS threshold, SUM(n) OVER w / SUM(n) OVER () AS fpr, SUM(p) OVER w / SUM(p) OVER () AS tpr FROM g WINDOW w AS (ORDER BY v DESC)
          UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""",
        ["fpr", "tpr"],
    ),
)
def _(t):
    return metrics.roc_curve(scored_lines(t), "label", "l_quantity")


@query(
    "y4_roc_area",
    sql_rounded(
        f"""WITH {ROWS}, g AS (SELECT l_extendedprice AS v, SUM(label) AS p, SUM(1 - label) AS n FROM s GROUP BY 1), c AS (SELECT *, SUM(n) OVER (ORDER BY v) - n AS b FROM g)
          SELECT CAST(SUM(p * (b + n / 2)) AS DOUBLE) / (CAST(SUM(p) AS DOUBLE) * SUM(n)) AS roc_auc FROM c""",
        ["roc_auc"],
    ),
)
def _(t):
    return metrics.roc_area(scored_lines(t), "label", "l_extendedprice")


@query("y5_label_counts", "SELECT quality, COUNT(*) AS n FROM labels GROUP BY quality")
def _(t):
    return metrics.label_counts(t.table("labels"), "quality")


def pct(cond: str, total: str) -> str:
    return f"COUNT(CASE WHEN {cond} THEN 1 END) / {total} * 100"


@query(
    "y6_feature_profile",
    sql_rounded(
        f"""WITH {LONG} SELECT feature, {pct('x > 0', 'COUNT(*)')} AS pct_positive, {pct('x = 0', 'COUNT(*)')} AS pct_zero, {pct('x = -1', 'COUNT(*)')} AS pct_minus_one,
          {pct('x < 0 AND x <> -1', 'COUNT(*)')} AS pct_other_negative, AVG(x) FILTER (WHERE x > 0) AS mean_positive, STDDEV_SAMP(x) FILTER (WHERE x > 0) AS std_positive FROM u GROUP BY feature""",
        ["pct_positive", "pct_zero", "pct_minus_one", "pct_other_negative", "mean_positive", "std_positive"],
    ),
)
def _(t):
    return profiles.feature_profile(scored_lines(t), FEATURES)


@query(
    "y7_feature_profile_na",
    sql_rounded(
        f"""WITH {LONG} SELECT feature, {pct('x = -1', 'COUNT(x)')} AS pct_minus_one, {pct('x = 0', 'COUNT(x)')} AS pct_zero, {pct('x > 0', 'COUNT(x)')} AS pct_positive,
          {pct('x IS NULL', 'COUNT(*)')} AS pct_null, AVG(x) FILTER (WHERE x > 0) AS mean_positive FROM u GROUP BY feature""",
        ["pct_minus_one", "pct_zero", "pct_positive", "pct_null", "mean_positive"],
    ),
)
def _(t):
    return profiles.feature_profile_na(scored_lines(t), FEATURES)


QUANTILES = {f"p{round(p * 100):02d}": p for p in PROFILE_QUANTILES}
STAT_COLUMNS = ["pct_minus_one", "pct_zero", "pct_positive", "mean", "std", *QUANTILES]
STATS_SQL = f"""{pct('x = -1', 'COUNT(x)')} AS pct_minus_one, {pct('x = 0', 'COUNT(x)')} AS pct_zero, {pct('x > 0', 'COUNT(x)')} AS pct_positive, AVG(x) AS mean, STDDEV_SAMP(x) AS std,
  {", ".join(f"QUANTILE_CONT(x, {p}) AS {n}" for n, p in QUANTILES.items())}"""


@query("y8_feature_quantiles", sql_rounded(f"WITH {LONG} SELECT feature, {STATS_SQL} FROM u GROUP BY feature", STAT_COLUMNS))
def _(t):
    return profiles.feature_quantiles(scored_lines(t), FEATURES)


@query("y8_feature_quantiles_by_label", sql_rounded(f"WITH {LONG} SELECT label, feature, {STATS_SQL} FROM u GROUP BY label, feature", STAT_COLUMNS))
def _(t):
    return profiles.feature_quantiles(scored_lines(t), FEATURES, ["label"])


@query(
    "y8_outcome_quantile_gap",
    sql_rounded(
        f"""WITH {LONG}, g AS (SELECT label, feature, {STATS_SQL} FROM u WHERE pred = 0 GROUP BY label, feature)
          SELECT a.feature, {", ".join(f"a.{c} AS {c}_fn, b.{c} AS {c}_tn, a.{c} - b.{c} AS diff_{c}" for c in STAT_COLUMNS)} FROM g a JOIN g b USING (feature) WHERE a.label = 1 AND b.label = 0""",
        [f"{p}{c}{s}" for c in STAT_COLUMNS for p, s in (("", "_fn"), ("", "_tn"), ("diff_", ""))],
    ),
)
def _(t):
    return profiles.outcome_quantile_gap(scored_lines(t), FEATURES, "label", "pred")


def _gap_sql(group: str, where: str) -> str:
    def of(f, g):
        return f"{f}(x) FILTER (WHERE {group} = {g} AND x > -1)"

    return sql_rounded(
        f"""WITH {LONG} SELECT feature, {of('AVG', 0)} AS mean_0, {of('STDDEV_SAMP', 0)} AS std_0, {of('AVG', 1)} AS mean_1, {of('STDDEV_SAMP', 1)} AS std_1,
          mean_1 - mean_0 AS difference, mean_1 / (mean_0 + 1e-10) AS ratio FROM u WHERE {where} GROUP BY feature""",
        ["mean_0", "std_0", "mean_1", "std_1", "difference", "ratio"],
    )


@query("y9_group_mean_gap", _gap_sql("pred", "label = 1"))
def _(t):
    return profiles.group_mean_gap(scored_lines(t), FEATURES, "pred", F.col("label") == 1)


@query("y9_group_mean_gap_by_label", _gap_sql("label", "pred = 1"))
def _(t):
    return profiles.group_mean_gap(scored_lines(t), FEATURES, "label", F.col("pred") == 1)


@query(
    "y10_outcome_group_stats",
    sql_rounded(
        f"""WITH {LONG} SELECT CASE WHEN label = 1 AND pred = 1 THEN 'TP' WHEN label = 1 THEN 'FN' WHEN pred = 1 THEN 'FP' ELSE 'TN' END AS outcome, feature,
          ROUND(AVG(x), 3) AS mean, ROUND(STDDEV_SAMP(x), 3) AS std FROM u WHERE x > -1 GROUP BY ALL""",
        ["mean", "std"],
    ),
)
def _(t):
    return profiles.outcome_group_stats(scored_lines(t), FEATURES, "label", "pred")


def _divergence_sql(edges: str) -> str:
    return sql_rounded(
        f"""WITH {LONG}, e AS (SELECT {edges}, MIN(x) AS lo, MAX(x) AS hi FROM u WHERE x IS NOT NULL GROUP BY ALL),
          b AS (SELECT feature, label, LEAST(CAST(FLOOR((x - lo) / ((hi - lo) / 50)) AS INT), 49) AS bin, COUNT(*) AS n, ANY_VALUE((hi - lo) / 50) AS w FROM u JOIN e USING ({edges}) WHERE x IS NOT NULL GROUP BY ALL),
          h AS (SELECT feature, label, bin, n / SUM(n) OVER (PARTITION BY feature, label) AS p, n / SUM(n) OVER (PARTITION BY feature, label) / w AS d FROM b),
          j AS (SELECT feature, bin, COALESCE(MAX(CASE WHEN label = 0 THEN p END), 0) AS p, COALESCE(MAX(CASE WHEN label = 1 THEN p END), 0) AS q,
            COALESCE(MAX(CASE WHEN label = 0 THEN d END), 0) AS d0, COALESCE(MAX(CASE WHEN label = 1 THEN d END), 0) AS d1 FROM h GROUP BY ALL)
          SELECT feature, SUM(CASE WHEN p > 0 THEN p * LN(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * LN(q / ((p + q) / 2)) ELSE 0 END) / 2 AS js_divergence,
            SUM(LEAST(d0, d1)) AS overlap FROM j GROUP BY feature""",
        ["js_divergence", "overlap"],
    )


@query("y11_histogram_divergence", _divergence_sql("feature"))
def _(t):
    return distribution.divergence(distribution.unpivot_features(scored_lines(t), FEATURES, ["label"]), "label")


@query("y11_histogram_divergence_own_bins", _divergence_sql("feature, label"))
def _(t):
    return distribution.divergence(distribution.unpivot_features(scored_lines(t), FEATURES, ["label"]), "label", own_edges=True)


T_SQL = f"""WITH {LONG}, g AS (SELECT feature, COUNT(x) FILTER (WHERE label = 0) AS n0, COUNT(x) FILTER (WHERE label = 1) AS n1, AVG(x) FILTER (WHERE label = 0) AS m0,
  AVG(x) FILTER (WHERE label = 1) AS m1, VAR_SAMP(x) FILTER (WHERE label = 0) AS v0, VAR_SAMP(x) FILTER (WHERE label = 1) AS v1 FROM u GROUP BY feature)
  SELECT feature, (m0 - m1) / SQRT(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1 / n0 + 1 / n1)) AS t_statistic, n0 + n1 - 2 AS degrees_of_freedom FROM g"""


@query("y12_t_test", sql_rounded(T_SQL, ["t_statistic"]))
def _(t):
    return profiles.t_test(scored_lines(t), FEATURES, "label")


#: The share of cos(w)^(f - 1) beyond w = atan(|t| / sqrt(f)), by Simpson's rule over u = w * sqrt(f) up to where nothing is left.
P_SQL = f"""WITH t AS ({T_SQL}), k AS (SELECT unnest(range(4001)) AS k),
  e AS (SELECT *, atan(abs(t_statistic) / sqrt(degrees_of_freedom)) * sqrt(degrees_of_freedom) AS u0, least(acos(0.0) * sqrt(degrees_of_freedom) - 1e-9, 16) AS u1 FROM t),
  p AS (SELECT feature, least(u0, u1) AS u0, u1, degrees_of_freedom AS f, k, CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS w FROM e, k),
  i AS (SELECT feature, sum(w * exp((f - 1) * ln(cos((u0 + (u1 - u0) * k / 4000) / sqrt(f))))) * any_value(u1 - u0) AS tail, sum(w * exp((f - 1) * ln(cos(u1 * k / 4000 / sqrt(f))))) * any_value(u1) AS whole FROM p GROUP BY feature)
  SELECT feature, t_statistic, degrees_of_freedom, tail / whole AS p_value FROM e JOIN i USING (feature)"""


@query("y12_t_test_p_values", sql_rounded(P_SQL, ["t_statistic", "p_value"]))
def _(t):
    return profiles.t_test_p_values(scored_lines(t), FEATURES, "label")


@query("y13_label_correlation", sql_rounded(f"WITH {LONG} SELECT feature, CORR(x, CAST(label AS DOUBLE)) AS correlation FROM u GROUP BY feature", ["correlation"]))
def _(t):
    return profiles.label_correlation(scored_lines(t), FEATURES, "label")


@query(
    "y15_prediction_check",
    f"""{WITH_REF}, f AS (SELECT DISTINCT user_id, leaf_id FROM actions WHERE event_type IN ('view', 'purchase') AND event_ts > TIMESTAMP '{REF}')
      SELECT a.user_id, a.leaf_id, CAST(a.leaf_id < 50 AS INT) AS pred, CASE WHEN f.user_id IS NOT NULL THEN a.leaf_id < 50 ELSE a.leaf_id >= 50 END AS correct
      FROM anchors a LEFT JOIN f ON f.user_id = a.user_id AND f.leaf_id = a.leaf_id""",
)
def _(t):
    later = t.actions().where(F.col("event_type").isin("view", "purchase") & (F.col("event_ts") > F.lit(REF).cast("timestamp")))
    scored = ref_anchors(t).select("user_id", "leaf_id").withColumn("pred", (F.col("leaf_id") < 50).cast("int"))
    return metrics.prediction_check(scored, later)


SMALL = model.TreeParams(trees=5, depth=3)
MODEL_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "gap"]


def _train_eval(t):
    from rekindle.operators.labels import hash_split

    train, _, test = hash_split(scored_lines(t), ["l_orderkey", "l_partkey", "l_linenumber"])
    return train, test


@query("y16_boosted_tree_train_score")
def _(t):
    train, test = _train_eval(t)
    _, scored = model.train_and_score(train, test, MODEL_FEATURES, "label", SMALL)
    return scored.select("l_orderkey", "l_partkey", "l_linenumber", "label", "pred", "probability")


@query("y17_single_feature_models")
def _(t):
    train, test = _train_eval(t)
    return single.single_feature_models(train, test, ["l_quantity", "gap", "l_extendedprice"], "label", single.BoostParams(trees=20, depth=2))


STUMP = single.BoostParams(trees=1, depth=1, learning_rate=0.5)
_UNIT = sql_unit("l_orderkey", "l_partkey", "l_linenumber")
#: Features with at most 64 values: a bin is a value, and missing ones come first.
STUMPS = f"""WITH {ROWS}, x AS (SELECT *, {_UNIT} AS unit FROM s),
  l AS (SELECT feature, v, label, unit FROM ({" UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v, pred AS label, unit FROM x" for f in ("l_quantity", "gap", "l_discount"))})),
  n AS (SELECT feature, v, CAST(SUM(label) AS DOUBLE) AS pos, CAST(SUM(1 - label) AS DOUBLE) AS neg FROM l WHERE unit < 0.7 GROUP BY ALL),
  a AS (SELECT feature, SUM(pos) AS p, SUM(neg) AS q, LN((SUM(pos) + 0.5::DOUBLE) / (SUM(neg) + 0.5::DOUBLE)) AS prior FROM n GROUP BY feature),
  g AS (SELECT feature, v, prior, pos - (pos + neg) / (1 + EXP(-prior)) AS gr, (pos + neg) / (1 + EXP(-prior)) * (1 - 1 / (1 + EXP(-prior))) AS he FROM n JOIN a USING (feature)),
  c AS (SELECT *, COALESCE(SUM(gr) OVER w, 0) AS gl, COALESCE(SUM(he) OVER w, 0) AS hl, SUM(gr) OVER (PARTITION BY feature) AS ga, SUM(he) OVER (PARTITION BY feature) AS ha
    FROM g WINDOW w AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  d AS (SELECT *, gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1) AS gain FROM c WHERE hl > 0),
  r AS (SELECT * FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY feature ORDER BY gain DESC, v) = 1)"""


@query("y17_first_splits", sql_rounded(f"{STUMPS} SELECT feature, v AS first_right, gain FROM r", ["first_right", "gain"]))
def _(t):
    cuts, bins = single.fit(_train_eval(t)[0], ["l_quantity", "gap", "l_discount"], "pred", STUMP)
    value = F.element_at("cuts", F.col("root_bin"))
    return bins.select("feature", "root_bin", "root_gain").distinct().join(cuts, "feature").select("feature", value.alias("first_right"), F.col("root_gain").alias("gain"))


_STUMP_ROWS = """(SELECT feature, label, CAST(prior + 0.5::DOUBLE * CASE WHEN l.v < r.v THEN gl / (hl + 1) ELSE (ga - gl) / (ha - hl + 1) END > 0 AS INT) AS pred FROM l JOIN r USING (feature) WHERE unit >= 0.8)"""
_CELLS = ", ".join(f"COUNT(CASE WHEN label = {y} AND pred = {p} THEN 1 END) AS {k}" for k, y, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))


@query("y17_single_feature_stumps", f"{STUMPS} SELECT feature, {_CELLS} FROM {_STUMP_ROWS} GROUP BY feature")
def _(t):
    train, test = _train_eval(t)
    out = single.single_feature_models(train, test, ["l_quantity", "gap", "l_discount"], "pred", STUMP)
    return out.select("feature", "tp", "fp", "fn", "tn")


@query(
    "y17_feature_auc",
    sql_rounded(
        f"""WITH {LONG}, g AS (SELECT feature, x, SUM(label) AS p, SUM(1 - label) AS n FROM u WHERE x IS NOT NULL GROUP BY ALL),
          c AS (SELECT *, SUM(n) OVER (PARTITION BY feature ORDER BY x) - n AS b FROM g)
          SELECT feature, CAST(SUM(p * (b + n / 2)) AS DOUBLE) / (CAST(SUM(p) AS DOUBLE) * SUM(n)) AS auc FROM c GROUP BY feature""",
        ["auc"],
    ),
)
def _(t):
    return metrics.feature_auc(scored_lines(t), FEATURES, "label")


@query("y18_feature_importance")
def _(t):
    fitted = model.train(_train_eval(t)[0], MODEL_FEATURES, "label", SMALL)
    return model.feature_importance(fitted, MODEL_FEATURES, t.spark)


