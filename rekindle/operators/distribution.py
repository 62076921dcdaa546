"""Exact quantiles, running totals and histograms of long (group, value) frames.

Nothing here gathers a whole feature in one task. Values are first reduced to distinct
values with counts; these rows are dealt out by range of (group, value) into as many buckets
as their number asks for, so that a bucket is bounded at every size however the values
are distributed and whatever their counts. Exact counts per bucket give the offsets, so ranks are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rekindle.session import cut_lineage

#: Distinct values that one task sorts at most.
ROWS_PER_BUCKET = 1_000_000


def unpivot_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Wide matrix to rows (keep…, feature, value)."""
    casted = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features])
    return casted.unpivot([F.col(k) for k in keep], list(features), "feature", "value")


def value_counts(df: DataFrame, by: Sequence[str], value: str = "value", measures: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values with their count (or other additive measures)."""
    measures = measures or {"n": F.count(F.lit(1))}
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return kept.groupBy(*by, value).agg(*[m.alias(k) for k, m in measures.items()])


def range_buckets(counts: DataFrame, by: Sequence[str], value: str = "value", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The rows of ``counts`` (by, value, measures; distinct values), stored with a ``_bucket`` that rises with (by, value).

    The rows decide the number of buckets, and Spark's range partitioner, which samples them, the
    borders. It is asked for buckets of half the bound, and any that is still above it is cut again
    in the same way, so none is above ``rows_per_bucket``.
    """
    keys = [*by, value]
    left, done = cut_lineage(counts).withColumn("_bucket", F.array().cast("array<int>")), None
    rows = left.count()
    while rows > rows_per_bucket:
        dealt = left.repartitionByRange(-(-2 * rows // rows_per_bucket), "_bucket", *keys)
        dealt = cut_lineage(dealt.withColumn("_bucket", F.concat("_bucket", F.array(F.spark_partition_id()))))
        large = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows_per_bucket).select("_bucket")
        fit = dealt.join(large, "_bucket", "left_anti").select(dealt.columns)
        done = fit if done is None else done.union(fit)
        left = cut_lineage(dealt.join(large, "_bucket", "left_semi").select(dealt.columns))
        rows = left.count()
    return left if done is None else done.union(left)


def running_totals(
    counts: DataFrame, by: Sequence[str], value: str, measures: Sequence[str], descending: bool = False, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Running sums of ``measures`` over the sorted distinct values, as ``cum_<measure>``.

    Rows are ordered inside range buckets only; bucket totals supply the offsets.
    """
    rows = range_buckets(counts, by, value, rows_per_bucket)
    first, then = (F.col("_bucket").desc(), F.col(value).desc()) if descending else (F.col("_bucket"), F.col(value))
    sums = rows.groupBy(*by, "_bucket").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    offsets = sums.select(*by, "_bucket", *[F.coalesce(F.sum(f"_s_{m}").over(order), F.lit(0)).alias(f"_o_{m}") for m in measures])
    inside = Window.partitionBy(*by, "_bucket").orderBy(then).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(offsets, [*by, "_bucket"])
    out = joined.withColumns({f"cum_{m}": F.col(f"_o_{m}") + F.sum(m).over(inside) for m in measures})
    return out.drop("_bucket", *[f"_o_{m}" for m in measures])


def exact_quantiles(df: DataFrame, by: Sequence[str], shares: Sequence[float], value: str = "value", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Linear-interpolation quantiles per group, one ``p<percent>`` column per share.

    Bucket counts tell which bucket holds each wanted rank, and only those buckets are ranked.
    """
    by = list(by)
    rows = range_buckets(value_counts(df, by, value), by, value, rows_per_bucket)
    keyed = by or ["_all"]
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    sums = rows.groupBy(*keyed, "_bucket").agg(F.sum("n").alias("_n"))
    whole = Window.partitionBy(*keyed)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_total", F.sum("_n").over(whole))

    def position(p: float) -> Column:
        return (F.col("_total") - 1) * F.lit(float(p))

    wanted = [(i, rank) for i, p in enumerate(shares) for rank in (F.floor(position(p)), F.ceil(position(p)))]
    hit = F.lit(False)
    for _, rank in wanted:
        hit = hit | ((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n")))
    kept = rows.join(sums.where(hit).drop("_n"), [*keyed, "_bucket"])
    inside = Window.partitionBy(*keyed, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = kept.withColumn("_upto", F.col("_before") + F.sum("n").over(inside))

    def at(rank: Column) -> Column:
        covers = (rank >= F.col("_upto") - F.col("n")) & (rank < F.col("_upto"))
        return F.max(F.when(covers, F.col(value)))

    aggs = []
    for i, p in enumerate(shares):
        aggs += [at(F.floor(position(p))).alias(f"_lo_{i}"), at(F.ceil(position(p))).alias(f"_hi_{i}")]
    found = ranked.groupBy(*keyed, "_total").agg(*aggs)
    cols = []
    for i, p in enumerate(shares):
        part = position(p) - F.floor(position(p))
        cols.append((F.col(f"_lo_{i}") + (F.col(f"_hi_{i}") - F.col(f"_lo_{i}")) * part).alias(f"p{round(p * 100):02d}"))
    return found.select(*by, *cols)


def histogram(
    df: DataFrame, by: Sequence[str], bins: int = 50, edges_by: Sequence[str] | None = None, value: str = "value"
) -> DataFrame:
    """Equal-width bin counts and densities per group.

    Bin edges span min to max of ``edges_by`` (default: each group's own range); the last
    bin includes its upper edge. A group whose values are all equal spans value ± 0.5.
    Every task gets the spans, one row per group: groups are features and labels, not users.
    """
    by = list(by)
    edges_by = by if edges_by is None else list(edges_by)
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    span = kept.groupBy(*edges_by).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    flat = F.col("_min") == F.col("_max")
    span = span.select(
        *edges_by,
        F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("lo"),
        F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("hi"),
    )
    # the spans go to the rows, so no group meets in one task; map tasks count their own rows by bin, and only bins move
    placed = kept.join(F.broadcast(span), edges_by)
    width = (F.col("hi") - F.col("lo")) / bins
    position = F.floor((F.col(value) - F.col("lo")) / width)
    binned = placed.withColumn("bin", F.least(F.greatest(position, F.lit(0)), F.lit(bins - 1)).cast("int"))
    grouped = binned.groupBy(*by, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return grouped.withColumn("density", F.col("n") / (total * width))


def divergence(df: DataFrame, label: str, bins: int = 50, own_edges: bool = False) -> DataFrame:
    """Jensen-Shannon divergence (nats) and density overlap of each feature between labels 0 and 1.

    Bins are shared by both labels; ``own_edges`` gives each label its own bins, compared
    bin by bin whatever their values. Overlap sums the smaller density, not the area.
    """
    hist = histogram(df, ["feature", label], bins, None if own_edges else ["feature"])
    side = {
        v: {m: F.coalesce(F.max(F.when(F.col(label) == v, F.col(m))), F.lit(0.0)) for m in ("density",)} for v in (0, 1)
    }
    per_bin = hist.groupBy("feature", "bin").agg(side[0]["density"].alias("d0"), side[1]["density"].alias("d1"))
    mass = per_bin.groupBy("feature").agg(F.sum("d0").alias("t0"), F.sum("d1").alias("t1"))
    both = per_bin.join(mass, "feature").where((F.col("t0") > 0) & (F.col("t1") > 0))
    p, q = F.col("d0") / F.col("t0"), F.col("d1") / F.col("t1")
    m = (p + q) / 2

    def kl(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x / m)).otherwise(0.0)

    return both.groupBy("feature").agg(
        (F.sum(kl(p) + kl(q)) / 2).alias("js_divergence"), F.sum(F.least("d0", "d1")).alias("overlap")
    )
