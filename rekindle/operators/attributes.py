"""Item attributes: long name/value rows to one map per item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekindle.operators.filters import allowed_attributes, lowercase_strings
from rekindle.operators.topk import shortest_value

# --- fixed values ---------------------------------------------------------------------
VALID_NAMESPACES = ("df",)
BLOCKED_ATTRIBUTES = (
    "non-domestic product", "modified item", "upc", "ean", "gtin", "california prop 65 warning", "mpn",
    "manufacturer part number", "isbn-13", "isbn-10", "other part number", "oe/oem part number", "features", "model",
    "number in pack", "item height", "item length", "item width", "item weight", "number of items in set", "food aisle",
    "width", "length", "items included", "custom bundle", "volume", "period after opening (pao)", "set includes",
)  # a shop adds the names of its own ids, scores and flags through the `blocked` argument
# --------------------------------------------------------------------------------------


def item_attributes(
    attrs: DataFrame,
    items: DataFrame,
    namespaces: Sequence[str] = VALID_NAMESPACES,
    blocked: Sequence[str] = BLOCKED_ATTRIBUTES,
) -> DataFrame:
    """item_id → ``attributes`` map; of several values the shortest is kept.

    The shortest value is chosen first, over the raw spelling of the name; names are
    lower-cased and filtered afterwards. The longest map has one entry per attribute name.
    """
    needed = items.select("item_id", "end_date").distinct()
    mine = attrs.join(needed, ["item_id", "end_date"], "left_semi")
    best = mine.where(F.col("attr_value").isNotNull()).groupBy("item_id", "attr_name").agg(
        F.min(F.struct(F.length("attr_value").alias("n"), F.col("attr_value").alias("v"), F.col("namespace").alias("ns"))).alias("b")
    )
    best = best.select("item_id", "attr_name", F.col("b.v").alias("attr_value"), F.col("b.ns").alias("namespace"))
    best = allowed_attributes(lowercase_strings(best), namespaces, blocked)
    return _to_map(best, ["item_id"], "attributes")


def variation_attributes(attrs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, variation_id) → ``variation_attributes`` map."""
    needed = items.where(F.col("variation_id").isNotNull()).select("item_id", "end_date", "variation_id").distinct()
    mine = attrs.join(needed, ["item_id", "end_date", "variation_id"], "left_semi").dropna(subset=["attr_name", "attr_value"])
    best = lowercase_strings(shortest_value(mine, ["item_id", "variation_id", "attr_name"]))
    return _to_map(best, ["item_id", "variation_id"], "variation_attributes")


def _to_map(best: DataFrame, keys: list[str], name: str) -> DataFrame:
    # two spellings of a name can meet after lower-casing: the smaller value wins
    unique = best.groupBy(*keys, "attr_name").agg(F.min(F.struct(F.length("attr_value").alias("n"), F.col("attr_value").alias("v"))).alias("b"))
    entries = F.array_sort(F.collect_list(F.struct("attr_name", F.col("b.v").alias("attr_value"))))
    return unique.groupBy(*keys).agg(F.map_from_entries(entries).alias(name))
