"""Window counts, recency and amount statistics, all windows in one aggregate.

Calendar-day arithmetic: an event counts for a window of N days when it happened 1 to
N days before the anchor's day; events on the anchor's own day never count.

Two plans give the same numbers:

* one reference date for all anchors (``ref_date``): events are aggregated directly by
  (user, category) with conditional sums, so map tasks combine a hot user before the
  shuffle, and the leaf totals are rolled up to the upper levels;
* anchors on many days: events are first reduced to one row per (user, category,
  day); these days and the anchor days then share one timeline per (user, category), and
  every window is a range frame over the day number. No event day is paired with an anchor
  day, and a timeline holds at most two rows per calendar day, however hot its key is.

Variances come from states of count, sum and squared deviations from the own mean, which
events give by the built-in aggregates and which are merged pairwise from then on: through
days, leaves, levels and windows. Sums of squares would cancel for large amounts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rekindle.levels import ANY, LEVELS, Level, all_levels
from rekindle.operators.joins import anchor_day, attach


@dataclass(frozen=True)
class ActivitySpec:
    """What to compute: windows per action, actions with recency, amount windows per action."""

    counts: Mapping[str, Sequence[int]] = field(default_factory=dict)
    recency: Sequence[str] = ()
    amounts: Mapping[str, Sequence[int]] = field(default_factory=dict)

    @property
    def actions(self) -> list[str]:
        return sorted({*self.counts, *self.recency, *self.amounts})

    @property
    def max_window(self) -> int | None:
        """Longest window, or None when recency needs the whole past."""
        if self.recency:
            return None
        return max(n for windows in (*self.counts.values(), *self.amounts.values()) for n in windows)


def count_name(action: str, level: Level, days: int) -> str:
    return f"f_num_{action}s_from_{level.name}_cat_in_last_{days}_days"


def recency_name(action: str, level: Level) -> str:
    return f"f_time_since_last_{action}_from_{level.name}_cat"


def amount_name(stat: str, level: Level, days: int) -> str:
    return f"f_{stat}_amount_from_{level.name}_cat_in_last_{days}_days"


def norm_name(action: str, level: Level, days: int) -> str:
    return f"f_norm_num_{action}s_from_{level.name}_cat_in_last_{days}_days"


def ratio_name(above: str, below: str, level: Level, days: int) -> str:
    return f"f_{above}_to_{below}_ratio_from_{level.name}_cat_in_last_{days}_days"


def weighted_name(action: str, level: Level) -> str:
    return f"f_weighted_num_{action}s_from_{level.name}_cat"


def zscore_name(action: str, level: Level, days: int) -> str:
    return f"f_user_vs_mean_{action}_from_{level.name}_cat_in_last_{days}_days"


# ---- partial sums ---------------------------------------------------------------------
# Measures per action: n events, c known amounts, s their sum, v their squared deviations
# from the mean, lo and hi their extremes, last the latest day. Written as SQL text because a
# grid has hundreds of them.

_MERGE = {"n": "sum", "c": "sum", "s": "sum", "lo": "min", "hi": "max", "last": "max"}
_AMOUNT_MEASURES = ("c", "s", "v", "lo", "hi")


def _first_measure(measure: str, hit: str) -> str:
    """SQL of an amount measure over plain events, of those where ``hit`` holds."""
    value = f"CASE WHEN {hit} THEN CAST(amount AS DOUBLE) END"
    return {
        "c": f"count({value})",
        "s": f"sum({value})",
        "v": f"coalesce(var_pop({value}) * count({value}), 0D)",
        "lo": f"min({value})",
        "hi": f"max({value})",
    }[measure]


def _state(suffix: str) -> str:
    """SQL of the state of a group of amounts; null for an empty one."""
    return f"CASE WHEN c_{suffix} > 0 THEN struct(c_{suffix} AS c, s_{suffix} AS s, v_{suffix} AS v) END"


def merged_deviations(states: str) -> str:
    """SQL of the squared deviations from the common mean of groups, from the list of their states.

    A state is count, sum and squared deviations; two groups are merged by the distance of their
    means, so nothing is lost to the size of the values. Sorted, so that the result does not
    depend on the order of arrival.
    """
    gap = "(x.s / x.c - a.m)"
    total = "(a.n + x.c)"
    step = f"(a, x) -> named_struct('n', {total}, 'm', a.m + {gap} * x.c / {total}, 'v', a.v + x.v + {gap} * {gap} * a.n * x.c / {total})"
    return f"aggregate(array_sort({states}), named_struct('n', CAST(0 AS BIGINT), 'm', 0D, 'v', 0D), {step}, a -> a.v)"


def _merge(col: str) -> Column:
    measure, suffix = col.split("_", 1)
    if measure == "v":
        return F.expr(f"{merged_deviations(f'collect_list({_state(suffix)})')} AS {col}")
    return F.expr(f"{_MERGE[measure]}({col}) AS {col}")


def _totals(spec: ActivitySpec, hit: Callable[[str, int | None], str], windows: bool) -> list[Column]:
    """Aggregates over plain events: all measures of ``spec``, per window or without any."""
    out: list[str] = []
    for a, days in spec.counts.items() if windows else ((a, (None,)) for a in spec.actions):
        out += [f"count(CASE WHEN {hit(a, n)} THEN 1 END) AS n_{a}{'' if n is None else f'_{n}'}" for n in days]
    if windows:
        out += [f"max(CASE WHEN {hit(a, None)} THEN to_date(event_ts) END) AS last_{a}" for a in spec.recency]
    for a, days in spec.amounts.items():
        for n in days if windows else (None,):
            out += [f"{_first_measure(m, hit(a, n))} AS {m}_{a}{'' if n is None else f'_{n}'}" for m in _AMOUNT_MEASURES]
    return [F.expr(e) for e in out]


def _finish(partials: DataFrame, spec: ActivitySpec, level: Level, keys: Sequence[str], repeat: str) -> DataFrame:
    """Partial sums to feature columns. ``repeat`` multiplies additive measures."""
    out: list[str] = []
    for a, windows in spec.counts.items():
        out += [f"CAST(coalesce(n_{a}_{n}, 0) * {repeat} AS BIGINT) AS {count_name(a, level, n)}" for n in windows]
    out += [f"coalesce(datediff(anchor_day, last_{a}), -1) AS {recency_name(a, level)}" for a in spec.recency]
    for a, windows in spec.amounts.items():
        for n in windows:
            c, s, v = (f"({m}_{a}_{n} * {repeat})" for m in ("c", "s", "v"))
            out += [
                f"coalesce({s}, 0D) AS {amount_name('sum', level, n)}",
                f"coalesce(CASE WHEN {c} > 0 THEN {s} / {c} END, 0D) AS {amount_name('mean', level, n)}",
                f"coalesce(hi_{a}_{n}, -1D) AS {amount_name('max', level, n)}",
                f"coalesce(lo_{a}_{n}, -1D) AS {amount_name('min', level, n)}",
                f"coalesce(CASE WHEN {c} > 1 THEN {v} / ({c} - 1) END, -1D) AS {amount_name('var', level, n)}",
            ]
    return partials.selectExpr(*keys, *out)


def fills(spec: ActivitySpec, level: Level) -> dict[str, object]:
    """Values for anchors without any matching event."""
    out: dict[str, object] = {}
    for a, windows in spec.counts.items():
        out |= {count_name(a, level, n): 0 for n in windows}
    out |= {recency_name(a, level): -1 for a in spec.recency}
    for windows in spec.amounts.values():
        for n in windows:
            out |= {amount_name(s, level, n): 0.0 for s in ("sum", "mean")}
            out |= {amount_name(s, level, n): -1.0 for s in ("max", "min", "var")}
    return out


def _bounded(events: DataFrame, spec: ActivitySpec, ref_date: str | None) -> DataFrame:
    """Push the reachable date range down to the scan when the reference date is known."""
    if ref_date is None:
        return events
    ref = F.lit(ref_date).cast("date")
    kept = events.where(F.col("event_ts") < ref.cast("timestamp"))
    if spec.max_window is not None:
        kept = kept.where(F.col("event_ts") >= F.date_sub(ref, spec.max_window).cast("timestamp"))
    return kept


def _of(spec: ActivitySpec, events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(spec.actions))


def _at_reference(events: DataFrame, spec: ActivitySpec, ref_date: str, keys: Sequence[str]) -> DataFrame:
    """Totals per key of what lies before one reference date, for every window."""

    def hit(action: str, days: int | None) -> str:
        age = f"datediff(DATE'{ref_date}', to_date(event_ts))"
        return f"event_type = '{action}' AND {age} " + (">= 1" if days is None else f"BETWEEN 1 AND {days}")

    return _of(spec, _bounded(events, spec, ref_date)).groupBy(*keys).agg(*_totals(spec, hit, windows=True))


def _on_day(days: DataFrame, ref_date: str, keys: Sequence[str]) -> DataFrame:
    """The rows of ``days`` (keys, anchor_day, _rows) on one day, dealt out by ``keys`` alone, as the totals are."""
    day = F.lit(ref_date).cast("date")
    return days.where(F.col("anchor_day") == day).groupBy(*keys).agg(F.max("_rows").alias("_rows")).withColumn("anchor_day", day)


def reference_date_partials(events: DataFrame, spec: ActivitySpec, ref_date: str) -> DataFrame:
    """Leaf totals of every (user, leaf, mid, top) for one reference date."""
    return _at_reference(events, spec, ref_date, ["user_id", *[lv.id for lv in LEVELS]])


def roll_up(partials: DataFrame, level: Level, levels: Sequence[Level] = LEVELS) -> DataFrame:
    """Leaf totals to totals of ``level``; ``ANY`` gives all of ``levels`` in one shuffle."""
    ids = {lv.id for lv in LEVELS}
    measures = [c for c in partials.columns if c != "user_id" and c not in ids]
    rows = all_levels(partials, levels) if level == ANY else partials.where(F.col(level.id).isNotNull())
    return rows.groupBy("user_id", *level.keys).agg(*[_merge(c) for c in measures])


def daily(events: DataFrame, spec: ActivitySpec, keys: Sequence[str]) -> DataFrame:
    """One row per key and calendar day; the combine runs in the map tasks."""
    totals = _totals(spec, lambda a, _: f"event_type = '{a}'", windows=False)
    return _of(spec, events).groupBy(*keys, F.to_date("event_ts").alias("event_day")).agg(*totals)


def timeline(days: DataFrame, per_day: DataFrame, keys: Sequence[str], frames: Callable[[Callable[[int | None], WindowSpec]], Sequence[Column]]) -> DataFrame:
    """The anchor days of ``days`` (keys, anchor_day, _rows) with aggregates over what ``per_day`` (keys, event_day, measures) has before them.

    ``frames`` gets a function from a number of days to the range frame of the 1 to that many
    days before the row's own (None: all earlier days) and returns the aggregates. Event days of
    keys without any anchor leave before the timelines are sorted.
    """
    keys = list(keys)
    wanted = per_day.join(days.select(*keys).distinct().hint("merge"), keys, "left_semi").withColumnRenamed("event_day", "anchor_day")
    line = days.unionByName(wanted, allowMissingColumns=True).withColumn("_at", F.unix_date("anchor_day"))

    def before(n: int | None) -> WindowSpec:
        return Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding if n is None else -n, -1)

    return line.select(*keys, "anchor_day", "_rows", *frames(before)).where(F.col("_rows").isNotNull())


def _over_days(spec: ActivitySpec, before: Callable[[int | None], WindowSpec]) -> list[Column]:
    """The measures of every window over daily measures; of deviations the list of states."""
    out = [F.sum(f"n_{a}").over(before(n)).alias(f"n_{a}_{n}") for a, windows in spec.counts.items() for n in windows]
    out += [F.max(F.expr(f"CASE WHEN n_{a} > 0 THEN anchor_day END")).over(before(None)).alias(f"last_{a}") for a in spec.recency]
    for a, windows in spec.amounts.items():
        for n in windows:
            out += [F.expr(f"{_MERGE[m]}({m}_{a})").over(before(n)).alias(f"{m}_{a}_{n}") for m in _AMOUNT_MEASURES if m != "v"]
            out.append(F.collect_list(F.expr(_state(a))).over(before(n)).alias(f"_v_{a}_{n}"))  # a state per calendar day at most
    return out


def _many_days(days: DataFrame, per_day: DataFrame, keys: Sequence[str], spec: ActivitySpec) -> DataFrame:
    """Totals of every window per (keys, anchor_day)."""
    found = timeline(days, per_day, keys, lambda before: _over_days(spec, before))
    lists = {f"v_{a}_{n}": F.expr(merged_deviations(f"_v_{a}_{n}")) for a, windows in spec.amounts.items() for n in windows}
    return found.withColumns(lists) if lists else found


def level_activity(
    anchors: DataFrame,
    events: DataFrame,
    level: Level,
    spec: ActivitySpec,
    ref_date: str | None = None,
    repeat_anchor_rows: bool = False,
    levels: Sequence[Level] = LEVELS,
) -> DataFrame:
    """Features keyed by (user, category, anchor_day); for ``ANY`` of all ``levels``.

    Events that :func:`all_levels` has dealt out to the levels already are taken as they are.

    ``repeat_anchor_rows`` counts an event once per anchor row that shares the category
    at this level, as a plain join of anchor rows with events does.
    """
    keys = ["user_id", *level.keys]
    days = (
        (all_levels(anchors, levels) if level == ANY else anchors.where(F.col(level.id).isNotNull()))
        .groupBy(*keys, anchor_day().alias("anchor_day"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    repeat = "_rows" if repeat_anchor_rows else "1"
    by_leaf = level == ANY and ANY.id not in events.columns
    if ref_date is not None:
        if by_leaf:
            totals = roll_up(reference_date_partials(events, spec, ref_date), level, levels)
        else:  # one level alone needs no leaf totals
            totals = _at_reference(events.where(F.col(level.id).isNotNull()), spec, ref_date, keys)
        joined = _on_day(days, ref_date, keys).join(totals.hint("merge"), keys)
        return _finish(joined, spec, level, [*keys, "anchor_day"], repeat)
    if by_leaf:
        ids = [lv.id for lv in LEVELS]
        leaf_days = daily(events, spec, ["user_id", *ids])
        per_day = all_levels(leaf_days, levels)
        measures = [c for c in per_day.columns if c not in (*keys, "event_day")]
        per_day = per_day.groupBy(*keys, "event_day").agg(*[_merge(c) for c in measures])
    else:
        per_day = daily(events.where(F.col(level.id).isNotNull()), spec, keys)
    return _finish(_many_days(days, per_day, keys, spec), spec, level, [*keys, "anchor_day"], repeat)


def anchor_keys(anchors: DataFrame, level: Level | None) -> DataFrame:
    """Distinct (user, category, event_ts) of the anchors, with their day."""
    cols = ["user_id", *(level.keys if level else []), "event_ts"]
    return anchors.select(*cols).distinct().withColumn("anchor_day", anchor_day())


def activity(
    anchors: DataFrame,
    events: DataFrame,
    level: Level,
    spec: ActivitySpec,
    ref_date: str | None = None,
    repeat_anchor_rows: bool = False,
) -> DataFrame:
    """Features keyed by (user, category, event_ts); every anchor key is present."""
    found = level_activity(anchors, events, level, spec, ref_date, repeat_anchor_rows)
    return attach(anchor_keys(anchors, level), found, level, fills(spec, level)).drop("anchor_day")


# ---- the families ---------------------------------------------------------------------


def count_windows(anchors, events, level: Level, action: str, windows: Sequence[int], **kw) -> DataFrame:
    """Number of events in each window."""
    return activity(anchors, events, level, ActivitySpec(counts={action: tuple(windows)}), **kw)


def days_since_last(anchors, events, level: Level, action: str, **kw) -> DataFrame:
    """Days since the latest earlier event; -1 without one."""
    return activity(anchors, events, level, ActivitySpec(recency=(action,)), **kw)


def amount_stats(anchors, events, level: Level, action: str, windows: Sequence[int], **kw) -> DataFrame:
    """Sum, mean, max, min and sample variance of the amounts in each window."""
    return activity(anchors, events, level, ActivitySpec(amounts={action: tuple(windows)}), **kw)


def total_name(action: str, days: int) -> str:
    return f"_total_{action}_{days}"


def user_totals(
    anchors: DataFrame,
    events: DataFrame,
    counts: Mapping[str, Sequence[int]],
    ref_date: str | None = None,
    repeat_anchor_rows: bool = False,
) -> DataFrame:
    """Events of any category per (user, anchor_day), action and window."""
    spec = ActivitySpec(counts=counts)
    days = anchors.groupBy("user_id", anchor_day().alias("anchor_day")).agg(F.count(F.lit(1)).alias("_rows"))
    repeat = "_rows" if repeat_anchor_rows else "1"
    if ref_date is not None:
        totals = _at_reference(events, spec, ref_date, ["user_id"])
        partials = _on_day(days, ref_date, ["user_id"]).join(totals.hint("merge"), "user_id")
    else:
        partials = _many_days(days, daily(events, spec, ["user_id"]), ["user_id"], spec)
    cols = [f"coalesce(n_{a}_{n}, 0) * {repeat} AS {total_name(a, n)}" for a, windows in counts.items() for n in windows]
    return partials.selectExpr("user_id", "anchor_day", *cols)


def total_fills(counts: Mapping[str, Sequence[int]]) -> dict[str, object]:
    return {total_name(a, n): 0 for a, windows in counts.items() for n in windows}


def normalised(part: str, total: str) -> str:
    """SQL of the share of the user's events, 5 places; -1 when the user had none."""
    return f"CASE WHEN {total} > 0 THEN round({part} / {total}, 5) ELSE -1D END"


def normalised_counts(anchors, events, level: Level, action: str, windows: Sequence[int], **kw) -> DataFrame:
    """Window count divided by the user's count over all categories."""
    counts = count_windows(anchors, events, level, action, windows, **kw).withColumn("anchor_day", anchor_day())
    wanted = {action: tuple(windows)}
    both = attach(counts, user_totals(anchors, events, wanted, **kw), None, total_fills(wanted))
    cols = [
        f"{normalised(count_name(action, level, n), total_name(action, n))} AS {norm_name(action, level, n)}" for n in windows
    ]
    return both.selectExpr("user_id", *level.keys, "event_ts", *cols)


def ratio(above: str, below: str) -> str:
    """SQL of above / below; -1 for a zero denominator."""
    return f"CASE WHEN {below} = 0 THEN -1D ELSE {above} / {below} END"


def action_ratios(anchors, events, level: Level, actions: tuple[str, str], windows: Sequence[int], **kw) -> DataFrame:
    """Count of the first action over count of the second in the same window."""
    above, below = actions
    spec = ActivitySpec(counts={above: tuple(windows), below: tuple(windows)})
    counts = activity(anchors, events, level, spec, **kw)
    cols = [
        f"{ratio(count_name(above, level, n), count_name(below, level, n))} AS {ratio_name(above, below, level, n)}" for n in windows
    ]
    return counts.selectExpr("user_id", *level.keys, "event_ts", *cols)


def weighted(action: str, level: Level, windows: Sequence[int], weights: Sequence[float]) -> str:
    """SQL of the weighted sum of window counts; windows are cumulative."""
    if len(windows) != len(weights):
        raise ValueError("one weight per window")
    return " + ".join(f"{count_name(action, level, n)} * {float(w)}D" for n, w in zip(windows, weights))


def weighted_counts(
    anchors, events, level: Level, action: str, windows: Sequence[int], weights: Sequence[float], **kw
) -> DataFrame:
    counts = count_windows(anchors, events, level, action, windows, **kw)
    return counts.selectExpr("user_id", *level.keys, "event_ts", f"{weighted(action, level, windows, weights)} AS {weighted_name(action, level)}")


def population_stats(counts: DataFrame, level: Level, columns: Sequence[str], times: str | None = None) -> DataFrame:
    """Mean and sample deviation of count columns per category, as ``_mean_<i>`` and ``_dev_<i>``.

    A row stands for ``times`` anchors. The built-in moments are merged over map tasks, so a category
    holding a third of the anchors is combined there.
    """
    rows = counts.where(F.col(level.id).isNotNull())
    if times is not None:
        rows = rows.select(*level.keys, *columns, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    out = [f(F.col(c).cast("double")).alias(f"_{name}_{i}") for i, c in enumerate(columns) for name, f in (("mean", F.avg), ("dev", F.stddev_samp))]
    return rows.groupBy(*level.keys).agg(*out)


def standard_scores(named: Mapping[str, str]) -> list[str]:
    """SQL of the scores of count columns; a null or zero deviation gives 0."""
    return [
        f"CASE WHEN _dev_{i} > 0 THEN ({c} - _mean_{i}) / _dev_{i} ELSE 0D END AS {out}" for i, (c, out) in enumerate(named.items())
    ]


def zscores(counts: DataFrame, level: Level, named: Mapping[str, str]) -> DataFrame:
    """Standard scores of count columns against all anchors of the same category.

    ``named`` maps count column to output column.
    """
    keys = counts.select("user_id", *level.keys, "event_ts", *named).distinct()
    both = keys.join(population_stats(keys, level, list(named)), level.keys, "left")
    return both.selectExpr("user_id", *level.keys, "event_ts", *standard_scores(named))


def count_zscores(anchors, events, level: Level, action: str, windows: Sequence[int], **kw) -> DataFrame:
    counts = count_windows(anchors, events, level, action, windows, **kw)
    return zscores(counts, level, {count_name(action, level, n): zscore_name(action, level, n) for n in windows})


# ---- derived columns of a scored matrix -----------------------------------------------


def recency_ratios(df: DataFrame, level: Level, short: Sequence[int] = (30, 180), long: int = 360) -> DataFrame:
    """Short over long window per action, and views over purchases in the short window.

    A zero denominator counts as -1; in views over purchases a zero numerator does too.
    """

    def guarded(col: str) -> Column:
        return F.when(F.col(col) == 0, F.lit(-1)).otherwise(F.col(col))

    out: dict[str, Column] = {}
    for n in short:
        suffix = "" if n == short[0] else f"_{n}"
        for action in ("purchase", "view"):
            out[f"recent_{action}_ratio{suffix}"] = F.col(count_name(action, level, n)) / guarded(count_name(action, level, long))
        out[f"view_to_purchase_ratio{suffix}"] = guarded(count_name("view", level, n)) / guarded(count_name("purchase", level, n))
    return df.withColumns(out)


def weighted_count_offline(
    df: DataFrame, level: Level, action: str, windows: Sequence[int], weights: Sequence[float], places: int | None = None
) -> Column:
    """Weighted count from existing columns, sentinels counted as 0, optionally rounded."""
    total = F.lit(0.0)
    for n, w in zip(windows, weights):
        value = F.col(count_name(action, level, n))
        total = total + F.when(value > 0, value).otherwise(0) * F.lit(float(w))
    return total if places is None else F.round(total, places)
