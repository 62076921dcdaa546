"""Top-k, deduplication and exact caps that no hot key can overload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rekindle.functions.hashing import HASH_BITS, salt, stable_hash
from rekindle.session import cut_lineage

#: Tasks that share the rows of one key.
SALTS = 32


def history_limit(per_action: int | None, overall: int | None, parity: bool = False) -> int | None:
    """The smaller of the limits that are set; ``parity`` keeps one row less."""
    limits = [k for k in (per_action, overall) if k is not None]
    if not limits:
        return None
    return min(limits) - 1 if parity else min(limits)


def _latest(df: DataFrame, keys: Sequence[str], k: int, order: Sequence[Column]) -> DataFrame:
    """The first k rows per key. Spark keeps only k rows per key in every map task before it shuffles."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rn") <= k).drop("_rn")


def _order(df: DataFrame, key: str, ts: str, tie: Sequence[str]) -> tuple[list[str], list[Column]]:
    tie = list(tie) or [c for c in df.columns if c not in (key, ts)]
    return tie, [F.col(ts).desc()] + [F.col(c).desc() for c in tie]


def recent_topk(df: DataFrame, k: int | None, key: str = "user_id", ts: str = "event_ts", tie: Sequence[str] = ()) -> DataFrame:
    """The k latest rows per key.

    The first pass ranks within (key, salt), so a key that holds a third of the rows
    is cut by many tasks; the second pass sees at most k rows per salt.
    """
    if k is None:
        return df
    tie, order = _order(df, key, ts, tie)
    salted = df.withColumn("_salt", salt(SALTS, ts, *tie))
    return _latest(_latest(salted, [key, "_salt"], k, order).drop("_salt"), [key], k, order)


def cohort_recent_topk(
    events: DataFrame,
    users: DataFrame,
    k: int | None,
    ts: str = "event_ts",
    tie: Sequence[str] = (),
) -> DataFrame:
    """The k latest events of each cohort user.

    The cohort is joined after the first ranking pass, in that pass's partitioning: the events
    move once, and of a hot user only k rows per map task and salt.
    """
    cohort = users.select("user_id").distinct()
    if k is None:
        return events.join(cohort, "user_id", "left_semi")
    tie, order = _order(events, "user_id", ts, tie)
    first = _latest(events.withColumn("_salt", salt(SALTS, ts, *tie)), ["user_id", "_salt"], k, order)
    salted = cohort.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kept = first.join(salted, ["user_id", "_salt"], "left_semi").drop("_salt")
    return _latest(kept, ["user_id"], k, order)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, chosen by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def shortest_value(attrs: DataFrame, keys: Sequence[str], value: str = "attr_value") -> DataFrame:
    """Per key the shortest value, equal lengths by the value itself.

    A plain aggregate: every map task keeps one candidate per key.
    """
    best = F.min(F.struct(F.length(value).alias("n"), F.col(value).alias("v")))
    kept = attrs.where(F.col(value).isNotNull())
    return kept.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col("_best.v").alias(value))


def take_by_hash(
    df: DataFrame,
    keys: Sequence[str],
    limit: int | DataFrame,
    within: Sequence[str] = (),
    seed: int = 42,
    buckets: int = 4096,
) -> DataFrame:
    """Exactly ``limit`` rows (per ``within`` group), the ones with the smallest key hash.

    ``keys`` must identify a row. The rows are stored once with their hash, so the input is evaluated
    once. Hash buckets are counted; those that lie whole under the limit pass by a join with
    these counts, and only the bucket at the limit is moved and ranked, so no task sees a whole
    group. ``limit`` may be a frame (``within`` columns, ``_limit``).
    """
    within = list(within)
    h = stable_hash(*keys, seed=seed)
    tagged = df.withColumn("_h", h)
    tagged = cut_lineage(tagged.withColumn("_b", F.shiftright("_h", HASH_BITS - buckets.bit_length() + 1).cast("int")))
    sizes = tagged.groupBy(*within, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # at most `buckets` rows per group
    order = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_b")
    cut = sizes.withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
    if isinstance(limit, int):
        cut = cut.withColumn("_limit", F.lit(limit).cast("bigint"))
    else:
        cut = cut.join(limit, within)
    end = F.col("_before") + F.col("_n")
    whole = tagged.join(cut.where(end <= F.col("_limit")), [*within, "_b"])
    edge = tagged.join(cut.where((F.col("_before") < F.col("_limit")) & (end > F.col("_limit"))), [*within, "_b"])
    rank = F.row_number().over(Window.partitionBy(*within, "_b").orderBy("_h", *keys))
    first = edge.withColumn("_rn", rank).where(F.col("_before") + F.col("_rn") <= F.col("_limit"))
    return whole.select(*df.columns).union(first.select(*df.columns))


def top_by(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """A top-n report."""
    return df.orderBy(*order).limit(n)
