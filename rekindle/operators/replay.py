"""Offline replay over logged recommendation impressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: positions in the ":"-packed log strings -------------------------------
ITEM_FIELD = 0
CLICK_ITEM_FIELD = 5
AMOUNT_ITEM_FIELD = 1
AMOUNT_VALUE_FIELD = 13
# ----------------------------------------------------------------------------------------


def _field(packed: Column, position: int) -> Column:
    return F.split(packed, ":")[position]


def _amounts(packed: Column) -> Column:
    """item → amount; the last entry of an item wins."""
    return F.transform(
        packed,
        lambda s: F.named_struct(
            F.lit("item"), F.split(_field(s, AMOUNT_ITEM_FIELD), r"\.")[0], F.lit("amount"), _field(s, AMOUNT_VALUE_FIELD)
        ),
    )


def _lookup(pairs: Column, item: Column) -> Column:
    mine = F.filter(pairs, lambda p: p["item"] == item)
    return F.coalesce(F.try_element_at(mine, F.lit(-1))["amount"], F.lit("0"))


def shown_items(log: DataFrame) -> DataFrame:
    """One row per shown item with rank, click flag and the two amounts (7 and 30 days).

    All lookups stay inside the row: lists are as long as one impression.
    """
    clicked = F.transform("clicks", lambda c: _field(c, CLICK_ITEM_FIELD))
    keep = [c for c in log.columns if c not in ("items", "clicks", "amt7", "amt30")]
    rows = log.select(
        *keep,
        clicked.alias("_clicked"),
        _amounts(F.col("amt7")).alias("_amt7"),
        _amounts(F.col("amt30")).alias("_amt30"),
        F.posexplode(F.transform("items", lambda i: _field(i, ITEM_FIELD))).alias("rank", "_item"),
    )
    return rows.select(
        *keep,
        "rank",
        F.col("_item").cast("bigint").alias("item_id"),
        F.array_contains("_clicked", F.col("_item")).cast("int").alias("clicked"),
        _lookup(F.col("_amt7"), F.col("_item")).cast("double").alias("amount_7d"),
        _lookup(F.col("_amt30"), F.col("_item")).cast("double").alias("amount_30d"),
    )


def packed_items(log: DataFrame) -> DataFrame:
    """The same facts as one ``rank:item:clicked:amt7:amt30`` string per item, re-packed per impression."""
    clicked = F.transform("clicks", lambda c: _field(c, CLICK_ITEM_FIELD))
    items = F.transform("items", lambda i: _field(i, ITEM_FIELD))
    packed = F.transform(
        items,
        lambda item, rank: F.concat_ws(
            ":",
            rank.cast("string"),
            item,
            F.array_contains(clicked, item).cast("int").cast("string"),
            _lookup(_amounts(F.col("amt7")), item),
            _lookup(_amounts(F.col("amt30")), item),
        ),
    )
    return log.withColumn("packed", packed)


def replay_lift(rows: DataFrame, pred: str = "pred", eligible: str = "apply_filter", clicked: str = "clicked", amount: str = "amount_7d") -> DataFrame:
    """What suppression keeps, and what refilling the freed slots at the average rate would add."""
    flag, kept = F.col(eligible), F.col(pred)
    sums = rows.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count(F.when(flag == 1, 1)).alias("eligible_items"),
        F.count(F.when((flag == 1) & (kept == 0), 1)).alias("suppressed"),
        F.count(F.when((flag == 1) & (kept == 1), 1)).alias("recommended"),
        F.coalesce(F.sum(F.col(clicked) * flag), F.lit(0)).cast("double").alias("clicks"),
        F.coalesce(F.sum(F.col(clicked) * flag * kept), F.lit(0)).cast("double").alias("kept_clicks"),
        F.coalesce(F.sum(F.col(amount) * flag), F.lit(0.0)).alias("amount"),
        F.coalesce(F.sum(F.col(amount) * flag * kept), F.lit(0.0)).alias("kept_amount"),
    )
    def per(total: str, whole: str) -> Column:
        return F.col(total) / F.when(F.col(whole) > 0, F.col(whole))

    rated = sums.withColumns({"ctr": per("clicks", "eligible_items"), "amount_rate": per("amount", "eligible_items")})
    refilled = rated.withColumns(
        {"expected_new_clicks": F.col("ctr") * F.col("suppressed"), "expected_new_amount": F.col("amount_rate") * F.col("suppressed")}
    )

    def lift(kept_col: str, extra: str, whole: str) -> Column:
        return ((F.col(kept_col) + F.col(extra)) / F.when(F.col(whole) != 0, F.col(whole)) - 1) * 100

    return refilled.withColumns(
        {
            "pct_eligible": per("eligible_items", "total_items") * 100,
            "pct_suppressed": per("suppressed", "eligible_items") * 100,
            "pct_recommended": per("recommended", "eligible_items") * 100,
            "click_lift_pct": lift("kept_clicks", "expected_new_clicks", "clicks"),
            "amount_lift_pct": lift("kept_amount", "expected_new_amount", "amount"),
        }
    )
