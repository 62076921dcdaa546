"""Similarity of an anchor's text to the texts of the user's recent events.

For every anchor, token-count cosine and token-set Jaccard against each event in the
window, summarised by max, min, mean, population variance, three percentiles, max/min
and the Poisson probability of one.

Only texts that share a token are ever joined: cosine and Jaccard come from sums over
the shared tokens of a (user, day, token) equi-join. Events that share nothing are
known from the totals and enter the statistics as a zero with their count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rekindle.functions.text import squared_norm, token_counts, tokens
from rekindle.levels import Level
from rekindle.operators.joins import anchor_day, salted_join

STATS = ("max", "min", "mean", "var", "p25", "p50", "p75", "scoreratio", "poisson")
MEASURES = ("cosine", "jaccard")
_PERCENTS = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def similarity_name(stat: str, subject: str, action: str, measure: str, days: int) -> str:
    return f"f_{stat}_{subject}_{action}_propensity_{measure}_sim_in_last_{days}_days"


def _counted(df: DataFrame, text: str, granularity: str) -> DataFrame:
    """Add the text's distinct tokens with counts as ``_t``."""
    words = df.withColumn("_w", tokens(F.col(text), granularity))
    return words.withColumn("_t", token_counts(F.col("_w"))).drop("_w")


def _by_token(df: DataFrame, side: str) -> DataFrame:
    """One row per distinct token of ``_t`` with its count, the squared norm and set size."""
    kept = [c for c in df.columns if c != "_t"]
    sized = df.withColumn(f"_sq_{side}", squared_norm(F.col("_t"))).withColumn(f"_size_{side}", F.size("_t"))
    exploded = sized.select(*kept, f"_sq_{side}", f"_size_{side}", F.inline("_t"))
    return exploded.withColumnsRenamed({"token": "_token", "n": f"_c_{side}"})


def recent_texts(
    anchors: DataFrame, events: DataFrame, text: str, windows: Sequence[int], ref_date: str | None, by: Sequence[str] = ()
) -> DataFrame:
    """Event counts per (user, ``by``, anchor_day, text), cumulative per window as ``_n_<N>``."""
    known = events.where(F.col(text).isNotNull())
    longest = max(windows)
    if ref_date is not None:
        ref = F.lit(ref_date).cast("date")
        known = known.where(
            (F.col("event_ts") < ref.cast("timestamp"))
            & (F.col("event_ts") >= F.date_sub(ref, longest).cast("timestamp"))
        )
        age = F.datediff(ref, F.to_date("event_ts"))
        counts = known.groupBy("user_id", *by, F.col(text).alias("_text")).agg(
            *[F.sum(F.when(age <= n, 1).otherwise(0)).alias(f"_n_{n}") for n in windows]
        )
        users = anchors.where(F.to_date("event_ts") == ref).select("user_id", anchor_day().alias("anchor_day")).distinct()
        return counts.join(users.hint("merge"), "user_id")
    per_day = known.groupBy("user_id", *by, F.col(text).alias("_text"), F.to_date("event_ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    days = anchors.select("user_id", anchor_day().alias("anchor_day")).distinct()
    joined = salted_join(per_day, days, ["user_id"], ["_text"])
    age = F.datediff("anchor_day", "day")
    return (
        joined.where((age >= 1) & (age <= longest))
        .groupBy("user_id", "_salt", *by, "anchor_day", "_text")
        .agg(*[F.sum(F.when(age <= n, F.col("n")).otherwise(0)).alias(f"_n_{n}") for n in windows])
        .drop("_salt")
    )


def _summaries(subject: str, action: str, windows: Sequence[int]) -> dict[str, str]:
    """Output name → SQL over rows (_cosine, _jaccard, _n_<N>) that stand for _n_<N> events each.

    Percentiles interpolate between the values at two ranks. ``_all_<N>`` has the events of the group and
    ``_upto_<measure>_<N>`` those up to the row's value.
    """
    out = {}
    for n in windows:
        w, total = f"_n_{n}", f"sum(_n_{n})"
        for m in MEASURES:
            sim = f"_{m}"
            high, low = (f"{f}(CASE WHEN {w} > 0 THEN {sim} END)" for f in ("max", "min"))
            mean = f"sum({sim} * {w}) / {total}"
            stats = {
                "max": high,
                "min": low,
                "mean": f"CASE WHEN {total} > 0 THEN {mean} END",
                "var": f"CASE WHEN {total} > 0 THEN greatest(sum({sim} * {sim} * {w}) / {total} - power({mean}, 2), 0D) END",
                "scoreratio": f"CASE WHEN {low} > 0 THEN {high} / {low} WHEN {low} IS NOT NULL THEN 0D END",
                "poisson": f"CASE WHEN {total} > 0 THEN {mean} * exp(-({mean})) END",
            }
            for name, p in _PERCENTS.items():
                at, upto = f"(nullif(_all_{n}, 0) - 1) * {p}D", f"_upto_{m}_{n}"
                below, above = (f"min(CASE WHEN {upto} > {f}({at}) THEN {sim} END)" for f in ("floor", "ceil"))
                rank = f"(({total} - 1) * {p}D)"
                stats[name] = f"CASE WHEN {below} = {above} THEN {below} ELSE (ceil({rank}) - {rank}) * {below} + ({rank} - floor({rank})) * {above} END"
            out |= {similarity_name(s, subject, action, m, n): stats[s] for s in STATS}
    return out


def propensity_similarity(
    anchors: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    anchor_text: str,
    event_text: str,
    subject: str,
    action: str,
    windows: Sequence[int],
    by: Sequence[str] = (),
    granularity: str = "word",
    ref_date: str | None = None,
    measures: Sequence[str] = MEASURES,
    stats: Sequence[str] = STATS,
    fill: float | None = None,
    lookup: DataFrame | None = None,
) -> DataFrame:
    """Similarity features keyed by ``keys``; every anchor key is present.

    An anchor without events in a window, or without a text, gets ``fill`` (null by default).
    ``by`` columns, present on both frames, must be equal for an event to count. With
    ``lookup``, ``anchor_text`` and ``event_text`` are ids and the last column of ``lookup``
    holds their text: ids are counted and moved, texts join the counted rows only.
    """
    named = [similarity_name(s, subject, action, m, n) for n in windows for m in measures for s in stats]
    base = anchors.select(*dict.fromkeys([*keys, anchor_text])).distinct().withColumn("anchor_day", anchor_day())
    side = ["user_id", *by, "anchor_day"]
    subjects = base.where(F.col(anchor_text).isNotNull() if lookup is not None else F.col(anchor_text) != "").select(
        *side, F.col(anchor_text).alias("_about")
    ).distinct()
    counts = [f"_n_{n}" for n in windows]
    recent = recent_texts(anchors, events, event_text, windows, ref_date, by)

    group = [*side, "_about"]
    if lookup is None:
        left, right = _counted(subjects, "_about", granularity), _counted(recent, "_text", granularity)
    else:
        *ids, key, name = lookup.columns
        known = _counted(lookup.where(F.col(name).isNotNull()), name, granularity)

        def tokenised(rows: DataFrame, column: str, where=F.lit(True)) -> DataFrame:
            return rows.join(known.where(where).select(*ids, F.col(key).alias(column), "_t").hint("merge"), [*ids, column])

        left, right = tokenised(subjects, "_about", F.col(name) != ""), tokenised(recent, "_text")
        subjects, recent = left.drop("_t"), right.drop("_t")
    left, right = _by_token(left, "a"), _by_token(right, "b")
    shared = left.join(right, [*side, "_token"])
    pairs = shared.groupBy(*group, "_text", "_sq_a", "_size_a", "_sq_b", "_size_b", *counts).agg(
        F.sum(F.col("_c_a") * F.col("_c_b")).alias("_dot"), F.count(F.lit(1)).alias("_shared")
    )
    cosine = F.col("_dot") / (F.sqrt(F.col("_sq_a").cast("double")) * F.sqrt(F.col("_sq_b").cast("double")))
    jaccard = F.col("_shared") / (F.col("_size_a") + F.col("_size_b") - F.col("_shared"))
    # every event counts as a zero, and every match takes its events back from the zeros
    zero = [F.lit(0.0).alias("_cosine"), F.lit(0.0).alias("_jaccard")]
    gain = F.struct(cosine.alias("_cosine"), jaccard.alias("_jaccard"), *[F.col(c) for c in counts])
    loss = F.struct(*zero, *[(-F.col(c)).alias(c) for c in counts])
    moved = pairs.select(*group, F.inline(F.array(gain, loss)))
    totals = recent.groupBy(*side).agg(*[F.sum(c).alias(c) for c in counts])
    zeros = subjects.join(totals, side).select(*group, *zero, *counts)
    # dealt out once, while rows are narrow: all that follows stays with its group
    weighted = (
        zeros.unionByName(moved)
        .repartition(*group)
        .groupBy(*group, "_cosine", "_jaccard")
        .agg(*[F.sum(c).alias(c) for c in counts])
    )
    if any(s in _PERCENTS for s in stats):
        whole = Window.partitionBy(*group)
        ranks = {f"_all_{n}": F.sum(f"_n_{n}").over(whole) for n in windows}
        for m in measures:
            upto = whole.orderBy(f"_{m}").rowsBetween(Window.unboundedPreceding, 0)
            ranks |= {f"_upto_{m}_{n}": F.sum(f"_n_{n}").over(upto) for n in windows}
        weighted = weighted.withColumns(ranks)
    summaries = _summaries(subject, action, windows)
    summary = [F.expr(f"{summaries[name]} AS {name}") for name in named]
    found = weighted.groupBy(*group).agg(*summary).withColumnRenamed("_about", anchor_text)
    joined = base.join(found.hint("merge"), [*side, anchor_text], "left")
    out = joined.select(*keys, *named)
    return out if fill is None else out.fillna(float(fill), subset=named)


def category_similarity(anchors: DataFrame, events: DataFrame, level: Level, action: str, windows: Sequence[int], **kw) -> DataFrame:
    """Anchor category name against the names of the user's recent event categories."""
    keys = ["user_id", *level.keys, "event_ts"]
    mine = events.where(F.col("event_type") == action)
    return propensity_similarity(
        anchors, mine, keys, level.label, level.label, f"{level.name}_cat", action, windows, by=level.extra, **kw
    )


def category_similarity_by_action(
    anchors: DataFrame,
    events: DataFrame,
    level: Level,
    actions: Sequence[str],
    windows: Sequence[int],
    names: DataFrame | None = None,
    **kw,
) -> DataFrame:
    """:func:`category_similarity` for several actions in one plan.

    ``names`` (level keys, name) supplies the category names if the frames carry ids only.
    """
    keys = ["user_id", *level.keys, "event_ts"]
    mine = events.where(F.col("event_type").isin(list(actions)))
    text = level.label if names is None else level.id
    asked = anchors.select(*dict.fromkeys([*keys, text])).distinct().withColumn("event_type", F.explode(F.array(*[F.lit(a) for a in actions])))
    subject = f"{level.name}_cat"
    long = propensity_similarity(
        asked, mine, [*keys, "event_type"], text, text, subject, "any", windows, by=[*level.extra, "event_type"], lookup=names, **kw
    )
    values = [c for c in long.columns if c not in (*keys, "event_type")]
    # one row per action and key
    packed = long.repartition(*keys).groupBy(*keys).agg(
        *[F.first(F.when(F.col("event_type") == a, F.struct(*values)), ignorenulls=True).alias(f"_{a}") for a in actions]
    )
    named = [f"_{a}.{c} AS {c.replace(f'_{subject}_any_', f'_{subject}_{a}_')}" for a in actions for c in values]
    return packed.selectExpr(*keys, *named)


def title_similarity(anchors: DataFrame, events: DataFrame, action: str, windows: Sequence[int], **kw) -> DataFrame:
    """Anchor item title against the titles of the user's recent events."""
    keys = ["user_id", "item_id", "title", "event_ts"]
    mine = events.where(F.col("event_type") == action)
    return propensity_similarity(anchors, mine, keys, "title", "title", "title", action, windows, **kw)
