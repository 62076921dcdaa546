"""Map and struct-array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_maps(maps: Column) -> Column:
    """array<map<string,string>> to one map; a later map wins over an earlier one.

    Keys are resolved before the map is built, so the result does not depend on
    ``spark.sql.mapKeyDedupPolicy``.
    """
    entries = F.flatten(F.transform(maps, lambda m: F.map_entries(m)))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(
        names, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    )
    return F.map_from_arrays(names, last)


def nested_events(columns: list[str], order_by: list[str]) -> Column:
    """Aggregate rows into an array of structs in a fixed order.

    Only ``order_by`` is compared, so the columns may be maps or arrays.
    """
    rows = F.collect_list(
        F.struct(F.struct(*[F.col(c) for c in order_by]).alias("_order"), F.struct(*[F.col(c) for c in columns]).alias("_row"))
    )
    ordered = F.array_sort(
        rows,
        lambda a, b: F.when(a["_order"] < b["_order"], -1).when(a["_order"] > b["_order"], 1).otherwise(0),
    )
    return F.transform(ordered, lambda s: s["_row"])
