"""Mixing sources to target weights by repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null and blank texts have none."""
    edges = text.rlike(r"\A[\x20\x09-\x0D]").cast("int") + text.rlike(r"[\x20\x09-\x0D]\z").cast("int")
    count = F.size(F.split(text, SEPARATORS)) - edges
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(count).cast("long")


def source_targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources from (source, source_size), one row for each source.

    Sources by code point, null last, weigh `weights` in turn and divide `share` times all sizes. A target stops at
    `most` times its source's size; what is over goes to the others by weight until none is above. A source is held
    back once the level (words for each unit of weight) reaches `most * size / weight`, so the sources held back are
    the first ones in that order and one pass finds the level. The window runs over one row for each source.
    """
    if share > most:
        raise ValueError("the sources can't be repeated often enough for this share")
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", weight.alias("weight"))
    ranked = ranked.withColumn("ceiling", F.col("source_size") * F.lit(most)).withColumn("full_at", F.col("ceiling") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, after, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    found = ranked.withColumn("level", (total - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    found = found.withColumn("shared", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
    target = F.when(F.col("shared").isNull() | (F.col("full_at") < F.col("shared")), F.col("ceiling")).otherwise(F.col("weight") * F.col("shared"))
    return found.select("source", "source_size", target.alias("target"))


def repetitions(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """Every row of `docs` (doc_id, text, source) with size, source_size, target and copies.

    A document is taken floor(rate) times, and once more if a number in [0, 1) drawn from its id and the seed by hash is
    under the fraction of the rate, where the rate is target / source_size of its source. So no order, partitioning
    or retry changes the mix, and none is taken more than ceil(most) times.

    Null texts have size 0; a source without words has target 0 and its documents are taken 0 times; a null source is a source of
    its own and a null id draws as one id. Equal rows draw alike. Sizes are summed before the shuffle, so a source that
    holds most rows costs no more than others. Columns of `docs` by these names are replaced.
    """
    made = ["size", "source_size", "target", "copies"]
    # The rows travel whole under `doc`, so that none of their columns can clash.
    whole = docs.drop(*made).select(F.struct("*").alias("doc"))
    own = whole.select("doc", F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("own_source"), word_count(F.col("doc.text")).alias("size"))
    sizes = own.groupBy(F.col("own_source").alias("source")).agg(F.sum("size").alias("source_size"))
    t = source_targets(sizes, weights, share, most)
    # One row for each source: adaptive execution broadcasts it by its measured size, else splits the large source.
    joined = own.join(t, F.col("own_source").eqNullSafe(F.col("source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    copies = (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")
    return joined.select("doc.*", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document of `docs` as often as `repetitions` says, with the number of the copy."""
    counted = repetitions(docs, **options).where(F.col("copies") > 0)
    columns = [c for c in docs.columns if c != "copy"]
    return counted.select(*(f"`{c}`" for c in columns), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
