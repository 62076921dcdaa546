"""The supplied parquet tables as the logical frames of the package.

* ``events`` holds user actions in January 2024. ``props.k`` is the item; views, clicks,
  errors and signups stand for view, search, watch and home-page events.
* ``orders`` with ``lineitem`` is a denser purchase history with returns.
* ``part`` is the item dimension and the category tree: leaf = part, mid and top are
  coarser key ranges, named after the part that carries the range's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MID_WIDTH = 10
TOP_WIDTH = 50
PREMIUM_SITE = 3


class Supplied:
    """Lazily reads ``<folder>/<table>.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    # ---- user actions ------------------------------------------------------------------

    def actions(self) -> DataFrame:
        """user_id, item_id, event_ts, event_type, amount and category ids."""
        item = F.get_json_object("props", "$.k").cast("bigint")
        e = self.table("events").select(
            "event_id", "user_id", F.col("ts").alias("event_ts"), "event_type", F.col("value").alias("amount"), item.alias("item_id")
        )
        return e.select("*", *_tree(F.col("item_id")))

    def named_actions(self) -> DataFrame:
        """:meth:`actions` with category names and the item title."""
        names = self.category_names().withColumn("title", F.col("leaf_name")).drop("mid_id", "top_id")
        return self.actions().join(names, "leaf_id")

    def purchases(self) -> DataFrame:
        return self.actions().where(F.col("event_type") == "purchase").withColumn("event_date", F.to_date("event_ts"))

    def views(self) -> DataFrame:
        return self.actions().where(F.col("event_type") == "view")

    # ---- raw logs for the history builders ----------------------------------------------

    def _log(self, event_type: str) -> DataFrame:
        e = self.actions().where(F.col("event_type") == event_type)
        return e.withColumn("session_date", F.to_date("event_ts")).withColumn("site_id", F.lit(0))

    def view_log(self) -> DataFrame:
        return self._log("view").select("event_id", "user_id", "item_id", "event_ts", "session_date", "site_id")

    def watch_log(self) -> DataFrame:
        bot = (F.col("amount") > 90).cast("int")
        return self._log("error").select(
            "user_id", "item_id", "event_ts", "session_date", "site_id", "leaf_id", F.lit("Watch").alias("action"), bot.alias("is_bot"),
            F.when(F.col("amount") > 60, F.lit("gone")).alias("deleted_by"),
        )

    def search_log(self) -> DataFrame:
        names = self.table("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name"), F.col("p_brand"))
        e = self._log("click").join(names, "item_id")
        k = F.col("item_id")
        return e.select(
            "user_id", "leaf_id", "site_id", "session_date", F.col("event_id").alias("session_id"), F.lit(1).alias("seq"), "event_ts",
            F.when(F.col("amount") > 15, F.col("p_name")).otherwise("").alias("query"),
            F.when(F.col("amount") < 30, F.col("p_brand")).alias("query_attrs"),
            F.concat_ws(",", k, k + 1, k + 2).alias("result_items"),
        )

    def home_log(self) -> DataFrame:
        page = F.concat(F.lit("p"), F.col("mid_id"))
        return self._log("signup").select(
            "user_id", page.alias("page_id"), "session_date", "event_ts", F.date_format("event_ts", "yyyyMMdd").alias("dt")
        )

    # ---- orders as purchase history -----------------------------------------------------

    def order_lines(self) -> DataFrame:
        """Purchases from orders and lineitem."""
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        li = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_suppkey"
        )
        joined = li.join(o, li.l_orderkey == o.o_orderkey)
        site = F.when(F.col("o_orderpriority") == "5-LOW", PREMIUM_SITE).otherwise(0)
        return joined.select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("item_id"),
            F.col("l_orderkey").alias("txn_id"),
            F.col("l_linenumber").alias("line"),
            F.col("l_suppkey").alias("seller_id"),
            site.alias("site_id"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("qty"),
            F.col("o_orderdate").alias("event_ts"),
            F.to_date("o_orderdate").alias("event_date"),
            F.col("l_returnflag").alias("return_flag"),
            F.when(F.col("l_quantity") > 25, F.col("l_linenumber").cast("bigint")).alias("variation_id"),
            *_tree(F.col("l_partkey")),
        )

    def returns(self) -> DataFrame:
        li = self.table("lineitem").where(F.col("l_returnflag") == "R")
        return li.select(F.col("l_partkey").alias("item_id"), F.col("l_orderkey").alias("txn_id"))

    # ---- dimensions ---------------------------------------------------------------------

    def items(self) -> DataFrame:
        """Items; the end date spreads over 2023 and 2024 with the size."""
        p = self.table("part")
        return p.select(
            F.col("p_partkey").alias("item_id"),
            F.col("p_name").alias("title"),
            F.date_add(F.lit("2023-12-01").cast("date"), F.col("p_size")).alias("end_date"),
            F.col("p_partkey").alias("leaf_id"),
            F.lit(0).alias("site_id"),
            F.concat(F.lit("img/"), F.col("p_partkey"), F.lit(".jpg")).alias("image_url"),
        )

    def category_names(self) -> DataFrame:
        """leaf, mid and top ids with names, one row per part."""
        p = self.table("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"))
        tree = p.select(F.col("k").alias("leaf_id"), F.col("n").alias("leaf_name"), *[c for c in _tree(F.col("k"))[1:]])
        mids = p.select(F.col("k").alias("mid_id"), F.col("n").alias("mid_name"))
        tops = p.select(F.col("k").alias("top_id"), F.col("n").alias("top_name"))
        return tree.join(mids.hint("merge"), "mid_id").join(tops.hint("merge"), "top_id")  # a row per part on both sides

    def categories(self) -> DataFrame:
        """Category rows per site; the smallest items point to another category."""
        redirected = self.table("part").select(
            F.col("p_partkey").alias("leaf_id"),
            F.when(F.col("p_size") == 1, F.col("p_partkey") + 1).otherwise(F.col("p_partkey")).alias("redirect_leaf_id"),
        )
        sites = F.explode(F.array(F.lit(0), F.lit(PREMIUM_SITE))).alias("site_id")
        return self.category_names().join(redirected, "leaf_id").select("*", sites)

    def item_attrs(self) -> DataFrame:
        """Attribute rows unpivoted from part, several values for some names."""
        p = self.table("part")
        end = F.date_add(F.lit("2023-12-01").cast("date"), F.col("p_size"))
        pairs = F.expr(
            """inline(array(
                named_struct('namespace', 'DF', 'attr_name', 'Brand', 'attr_value', p_brand),
                named_struct('namespace', 'DF', 'attr_name', 'Type', 'attr_value', p_type),
                named_struct('namespace', 'DF', 'attr_name', 'Type', 'attr_value', p_name),
                named_struct('namespace', 'DF', 'attr_name', 'Size', 'attr_value', cast(p_size as string)),
                named_struct('namespace', 'DF', 'attr_name', 'UPC', 'attr_value', cast(p_partkey as string)),
                named_struct('namespace', 'XX', 'attr_name', 'Note', 'attr_value', p_name)))"""
        )
        return p.select(F.col("p_partkey").alias("item_id"), end.alias("end_date"), pairs)

    def variation_attrs(self) -> DataFrame:
        """Attributes of the item variations that order lines name."""
        lines = self.order_lines().where(F.col("variation_id").isNotNull())
        keys = lines.select("item_id", "variation_id").distinct()
        p = self.table("part").select(
            F.col("p_partkey").alias("item_id"), F.col("p_brand"), F.col("p_type"),
            F.date_add(F.lit("2023-12-01").cast("date"), F.col("p_size")).alias("end_date"),
        )
        pairs = F.expr(
            """inline(array(
                named_struct('attr_name', 'Colour', 'attr_value', concat(p_brand, '-', variation_id)),
                named_struct('attr_name', 'Colour', 'attr_value', concat('x', variation_id)),
                named_struct('attr_name', 'Style', 'attr_value', p_type)))"""
        )
        return keys.join(p, "item_id").select("item_id", "variation_id", "end_date", pairs)

    # ---- recommendation log -------------------------------------------------------------

    def rec_log(self) -> DataFrame:
        """Each order as one impression: its lines are the shown items, returned ones were clicked.

        Items, clicks and amounts are ``:``-packed strings as a serving log writes them.
        """
        li = self.table("lineitem")
        part = F.col("l_partkey").cast("string")
        rank = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        click = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("a:b:c:d:e:"), part))

        def amount(flag: str) -> Column:
            packed = F.concat(F.lit("x:"), part, F.lit(".0:2:3:4:5:6:7:8:9:10:11:12:"), F.format_string("%.2f", "l_extendedprice"))
            return F.when(F.col("l_linestatus") == flag, packed)

        shown = li.groupBy("l_orderkey").agg(
            F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.concat(part, F.lit(":s")).alias("v")))).alias("shown"),
            F.array_sort(F.collect_list(click)).alias("clicks"),
            F.array_sort(F.collect_list(amount("O"))).alias("amt7"),
            F.array_sort(F.collect_list(amount("F"))).alias("amt30"),
        )
        o = self.table("orders")
        return shown.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderkey").alias("impression_id"),
            F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss").alias("shown_at"),
            F.transform("shown", lambda s: s["v"]).alias("items"),
            "clicks",
            "amt7",
            "amt30",
            F.date_format("o_orderdate", "yyyyMMdd").alias("dt"),
            F.when(F.col("o_orderpriority") == "1-URGENT", 7).otherwise(8).alias("placement"),
            F.when(F.col("o_orderstatus") == "P", F.lit("01")).otherwise(F.lit("00")).alias("bot_flag"),
            F.lit("").alias("secondary_id"),
            F.lit(0).alias("site_id"),
        )


def _tree(item: Column) -> list[Column]:
    return [
        item.alias("leaf_id"),
        F.floor(item / MID_WIDTH).cast("bigint").alias("mid_id"),
        F.floor(item / TOP_WIDTH).cast("bigint").alias("top_id"),
    ]
