"""Per-user event histories: cohort, recent events, item and category facts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rekindle.config import Config
from rekindle.functions.maps import nested_events
from rekindle.operators.attributes import item_attributes, variation_attributes
from rekindle.operators.filters import (
    history_range,
    human_sessions,
    lowercase_strings,
    nonempty_search,
    required,
    with_amount,
)
from rekindle.operators.joins import category_enrich, exclude_returned, item_dimension
from rekindle.operators.labels import select_cohort
from rekindle.operators.topk import cohort_recent_topk, history_limit, recent_topk
from rekindle.session import cut_lineage

NAMED = ("item_id", "site_id", "leaf_id", "title", "leaf_name")
CATEGORY_COLUMNS = ("leaf_name", "mid_id", "mid_name", "top_id", "top_name")


@dataclass(frozen=True)
class Tables:
    """The input frames; only those used by the chosen histories are needed."""

    purchases: DataFrame | None = None
    views: DataFrame | None = None
    searches: DataFrame | None = None
    watches: DataFrame | None = None
    home_events: DataFrame | None = None
    items: DataFrame | None = None
    categories: DataFrame | None = None
    item_attrs: DataFrame | None = None
    variation_attrs: DataFrame | None = None
    returns: DataFrame | None = None


def _recent(df: DataFrame, users: DataFrame, limit: int | None, config: Config, tie: Sequence[str], parity: bool) -> DataFrame:
    """Recent events of the cohort, stored because the dimensions and the result both need them."""
    return cut_lineage(cohort_recent_topk(df, users, history_limit(limit, config.limits.max_events, parity), tie=tie))


def _with_item(df: DataFrame, t: Tables, config: Config, event_type: str) -> DataFrame:
    facts = item_dimension(t.items, df, config.filters.start_date).select("item_id", "title", "site_id", "leaf_id")
    named = category_enrich(df.join(facts, "item_id"), t.categories)
    return required(named.withColumn("event_type", F.lit(event_type)), NAMED)


def view_history_min(t: Tables, users: DataFrame, config: Config, parity: bool = False) -> DataFrame:
    """Recent views with item title and category names."""
    f = config.filters
    log = history_range(t.views, "session_date", f.start_date, f.end_date, f.site_ids)
    recent = _recent(log.select("user_id", "item_id", "event_ts"), users, config.limits.max_views, config, ["item_id"], parity)
    return _with_item(recent, t, config, "view")


def view_history(t: Tables, users: DataFrame, config: Config, parity: bool = False) -> DataFrame:
    """As :func:`view_history_min` with the log's other columns and the attribute map."""
    f = config.filters
    log = history_range(t.views, "session_date", f.start_date, f.end_date, f.site_ids).drop("site_id")
    recent = _recent(log, users, config.limits.max_views, config, ["item_id"], parity)
    named = _with_item(recent, t, config, "view")
    facts = item_dimension(t.items, recent, f.start_date)
    return lowercase_strings(named.join(item_attributes(t.item_attrs, facts), "item_id", "left"))


def watch_history_min(t: Tables, users: DataFrame, config: Config, parity: bool = False) -> DataFrame:
    """Recent watch events of human sessions with item title and category names."""
    f = config.filters
    log = human_sessions(history_range(t.watches, "session_date", f.start_date, f.end_date, f.site_ids))
    log = log.where(F.col("action") == "Watch").select("user_id", "item_id", "event_ts")
    recent = _recent(log, users, config.limits.max_watches, config, ["item_id"], parity)
    return lowercase_strings(_with_item(recent, t, config, "watch"))


def watch_history_alt(t: Tables, users: DataFrame, config: Config, parity: bool = False) -> DataFrame:
    """Watch history from a watch-state table: rows not deleted, category from the row itself."""
    f = config.filters
    log = history_range(t.watches, "session_date", f.start_date, f.end_date, f.site_ids).where(F.col("deleted_by").isNull())
    log = log.select("user_id", "item_id", "leaf_id", "site_id", "event_ts")
    recent = _recent(log, users, config.limits.max_watches, config, ["item_id"], parity)
    named = category_enrich(recent, t.categories).withColumn("event_type", F.lit("watch"))
    return lowercase_strings(required(named, ["item_id", "site_id", "leaf_id", "leaf_name"]))


def search_history_min(t: Tables, users: DataFrame, config: Config, parity: bool = False) -> DataFrame:
    """Recent searches that have a query or attributes, with category names."""
    f = config.filters
    log = nonempty_search(history_range(t.searches, "session_date", f.start_date, f.end_date, f.site_ids))
    log = log.select("user_id", "leaf_id", "site_id", F.col("query").alias("title"), "event_ts")
    recent = _recent(log, users, config.limits.max_searches, config, ["leaf_id", "title"], parity)
    named = category_enrich(recent, t.categories).withColumn("event_type", F.lit("search"))
    return lowercase_strings(required(named, ["title", "site_id", "leaf_id"]))


SEARCH_KEY = ("session_date", "site_id", "session_id", "seq")


def search_history(t: Tables, users: DataFrame, config: Config, parity: bool = False) -> DataFrame:
    """As :func:`search_history_min` with the result list as an array of item structs.

    With ``collect_result_titles`` the items get their titles and unknown items drop out.
    """
    f = config.filters
    log = nonempty_search(history_range(t.searches, "session_date", f.start_date, f.end_date, f.site_ids))
    log = log.withColumnsRenamed({"query": "title", "query_attrs": "search_attrs"}).withColumn("event_type", F.lit("search"))
    recent = _recent(log, users, config.limits.max_searches, config, [*SEARCH_KEY[1:], "leaf_id"], parity)
    listed = recent.select(*SEARCH_KEY, F.posexplode(F.split("result_items", ",")).alias("pos", "item_id"))
    columns = ["item_id"]
    if config.collect_result_titles:
        listed = listed.withColumn("item_id", F.col("item_id").cast("bigint"))
        facts = item_dimension(t.items, listed, f.start_date).select("item_id", "title", "image_url")
        listed, columns = listed.join(facts, "item_id"), ["item_id", "title", "image_url"]
    nested = listed.groupBy(*SEARCH_KEY).agg(nested_events(columns, ["pos"]).alias("results"))
    named = category_enrich(recent.drop("result_items"), t.categories)
    return lowercase_strings(named.join(nested, list(SEARCH_KEY)))


def _recent_purchases(t: Tables, users: DataFrame, config: Config, parity: bool) -> DataFrame:
    f = config.filters
    log = history_range(t.purchases, "event_date", f.start_date, f.end_date, f.site_ids)
    return _recent(log, users, config.limits.max_purchases, config, ["item_id", "txn_id", "line", "qty"], parity)


def purchase_history_min(t: Tables, users: DataFrame, config: Config, parity: bool = False) -> DataFrame:
    """Recent purchases that were not returned, with title, category names and amount."""
    recent = _recent_purchases(t, users, config, parity)
    facts = item_dimension(t.items, recent, config.filters.start_date, ("item_id", "site_id")).select("item_id", "site_id", "title")
    kept = exclude_returned(recent, t.returns).join(facts, ["item_id", "site_id"])
    kept = kept.drop("mid_id", "top_id")
    named = category_enrich(kept, t.categories)
    return lowercase_strings(
        with_amount(named, "purchase").select(
            "user_id", "item_id", "site_id", "leaf_id", "price", "qty", "event_ts", "title", *CATEGORY_COLUMNS, "event_type", "amount"
        )
    )


def purchase_history(t: Tables, users: DataFrame, config: Config, parity: bool = False) -> DataFrame:
    """As :func:`purchase_history_min` with item and variation attribute maps and the image."""
    recent = _recent_purchases(t, users, config, parity)
    facts = item_dimension(t.items, recent, config.filters.start_date, ("item_id", "site_id"))
    facts = facts.select("item_id", "site_id", "end_date", "title", "image_url")
    kept = exclude_returned(recent, t.returns).join(facts, ["item_id", "site_id"])
    kept = kept.drop("mid_id", "top_id")
    named = category_enrich(kept, t.categories)
    dated = recent.join(facts.select("item_id", "site_id", "end_date"), ["item_id", "site_id"])
    full = named.join(item_attributes(t.item_attrs, dated), "item_id", "left").join(
        variation_attributes(t.variation_attrs, dated), ["item_id", "variation_id"], "left"
    )
    return lowercase_strings(
        with_amount(full, "purchase").select(
            "user_id", "item_id", "variation_id", "site_id", "leaf_id", "price", "qty", "event_ts", "title", "image_url",
            *CATEGORY_COLUMNS, "attributes", "variation_attributes", "event_type", "amount",
        )
    )


def home_events(t: Tables, users: DataFrame, config: Config, parity: bool = False) -> DataFrame:
    """One event per (session date, page, user), at its first time."""
    f = config.filters
    log = t.home_events.where(F.col("dt").between(f.start_date.replace("-", ""), f.end_date.replace("-", "")))
    log = log.join(users.select("user_id"), "user_id", "left_semi")
    first = log.groupBy("session_date", "page_id", "user_id").agg(F.min("event_ts").alias("event_ts"))
    tagged = first.select("user_id", "page_id", "event_ts", "session_date").withColumn("event_type", F.lit("home"))
    limit = history_limit(config.limits.max_home_events, config.limits.max_events, parity)
    return recent_topk(tagged, limit, tie=["page_id"]).drop("page_id")


def timeline_events(t: Tables, config: Config, parity: bool = False) -> DataFrame:
    """All chosen histories of the cohort in one frame; columns an action lacks are null."""
    lim = config.limits
    users = cut_lineage(select_cohort(t.purchases, config))
    parts = []
    if lim.max_purchases != 0:
        bought = cut_lineage(purchase_history(t, users, config, parity))
        parts.append(bought)
        if config.filters.min_purchases > 0:
            users = bought.select("user_id").distinct()
    for limit, build in ((lim.max_views, view_history), (lim.max_searches, search_history), (lim.max_home_events, home_events)):
        if limit != 0:
            parts.append(build(t, users, config, parity))
    if not parts:
        raise ValueError("every history is switched off by a limit of 0")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return recent_topk(union, history_limit(lim.max_events, None, parity), tie=["event_type", "item_id"])


def _bound(config: Config) -> int:
    lim = config.limits
    if lim.max_events is not None:
        return lim.max_events
    each = (lim.max_purchases, lim.max_views, lim.max_searches, lim.max_home_events)
    if any(k is None for k in each):
        raise ValueError("a nested history needs max_events, a limit per action or a chunk size")
    return sum(each)


def numbered(events: DataFrame, order: Sequence[Column], latest_first: bool = False) -> DataFrame:
    """``events`` with ``_nr``, the row's number from 0 in its user's history, by event_ts and then ``order``.

    A day's rows are ordered by themselves and start after the number of rows on the days before,
    so however long a history is, only one day of it is in one task.
    """
    dated = events.withColumn("_day", F.to_date("event_ts"))
    sizes = dated.groupBy("user_id", "_day").agg(F.count(F.lit(1)).alias("_n"))
    day, time = (F.col("_day").desc(), F.col("event_ts").desc()) if latest_first else (F.col("_day"), F.col("event_ts"))
    ahead = Window.partitionBy("user_id").orderBy(day).rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    offsets = sizes.select("user_id", F.col("_day").alias("_d"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")).withColumnRenamed("user_id", "_u")
    within = F.row_number().over(Window.partitionBy("user_id", "_day").orderBy(time, *order))
    placed = dated.withColumn("_within", within - 1)
    joined = placed.join(offsets, (F.col("user_id") == F.col("_u")) & (F.col("_day") == F.col("_d")))
    return joined.withColumn("_nr", F.col("_ahead") + F.col("_within")).drop("_day", "_d", "_u", "_ahead", "_within")


def chunks(events: DataFrame, columns: Sequence[str], order: Sequence[Column], size: int, name: str, latest_first: bool = False) -> DataFrame:
    """(user_id, chunk, ``name``): each history in arrays of ``size`` events, the last one shorter; no row grows with its user."""
    placed = numbered(events, order, latest_first)
    number = F.floor(F.col("_nr") / size).cast("bigint").alias("chunk")
    return placed.groupBy("user_id", number).agg(nested_events(list(columns), ["_nr"]).alias(name))


def user_timeline(t: Tables, config: Config, parity: bool = False, chunk: int | None = None) -> DataFrame:
    """One row per user with the events, latest first, as an array of structs.

    The array is bounded by the configured limits; without one the call is refused, because a
    single row could hold any number of events. With ``chunk`` there is no need for limits: a
    user's events fill rows of that many, numbered by a column ``chunk`` from 0.
    """
    if chunk is None:
        _bound(config)
    flat = timeline_events(t, config, parity)
    columns = [c for c in flat.columns if c != "user_id"]
    if chunk is not None:
        flat = cut_lineage(flat)
        return chunks(flat, columns, [F.col("event_type"), F.col("item_id")], chunk, "events", latest_first=True)
    age = -F.unix_micros(F.col("event_ts").cast("timestamp"))
    return flat.withColumn("_age", age).groupBy("user_id").agg(
        nested_events(columns, ["_age", "event_type", "item_id"]).alias("events")
    )


def history_json(anchors: DataFrame, histories: dict[str, DataFrame], chunk: int | None = None) -> DataFrame:
    """Anchors of users present in every history, each history as a JSON array per user.

    Without ``chunk`` the histories must be bounded per user, as the builders above return them. With it
    an anchor has a row for each chunk of that many events, numbered by a column ``chunk``; a
    history that has ended before is null there.
    """
    out = anchors
    packed: DataFrame | None = None
    for name, events in histories.items():
        columns = ["event_ts", *[c for c in events.columns if c not in ("event_ts", "user_id")]]
        order = [c for c in ("event_type", "item_id") if c in columns]
        if chunk is None:
            own = events.groupBy("user_id").agg(F.to_json(nested_events(columns, ["event_ts", *order])).alias(name))
            out = out.join(own, "user_id")
        else:
            stored = cut_lineage(events)
            out = out.join(stored.select("user_id").distinct(), "user_id", "left_semi")
            own = chunks(stored, columns, [F.col(c) for c in order], chunk, name).withColumn(name, F.to_json(name))
            packed = own if packed is None else packed.join(own, ["user_id", "chunk"], "full")
    return out if packed is None else out.join(packed, "user_id")
