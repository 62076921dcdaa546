"""Reading tables and writing results."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rekindle.functions.hashing import stable_unit
from rekindle.operators.topk import take_by_hash


def catalog_scan(
    spark: SparkSession, table: str, columns: Sequence[str] | None = None, where: Column | str | None = None
) -> DataFrame:
    """Named table or parquet path, filtered and narrowed; both reach the scan."""
    df = spark.read.parquet(table) if "/" in table else spark.table(table)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def _versions(spark: SparkSession, name: str) -> list[str]:
    """The stored versions of a published table, oldest first."""
    database, _, plain = name.rpartition(".")
    tables = spark.catalog.listTables(database or None, f"{plain}__v*")
    return sorted(f"{database}.{t.name}" if database else t.name for t in tables if re.fullmatch(rf"{re.escape(plain.lower())}__v\d{{8}}_[0-9a-f]{{8}}", t.name))


def save_table(df: DataFrame, name: str, partition_by: Sequence[str] = (), keep: int = 2) -> DataFrame:
    """Publish the frame as the table ``name`` and return it.

    Rows go to a table of their own, a new version. Only when the stored rows are as many as were
    written does ``name``, a view, move on to it, in one step of the catalog. A write that
    fails or falls short leaves the earlier version in place. Readers that began on an
    older version keep it: the ``keep`` newest are there, the others go.
    """
    if keep < 1:
        raise ValueError("the published version has to be kept")
    spark = df.sparkSession
    earlier = _versions(spark, name)
    number = int(earlier[-1].rsplit("__v", 1)[1][:8]) + 1 if earlier else 1
    version = f"{name}__v{number:08d}_{uuid.uuid4().hex[:8]}"
    written = Observation()
    writer = df.observe(written, F.count(F.lit(1)).alias("rows")).write.format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.saveAsTable(version)
        stored = spark.table(version).count()
        if stored != written.get["rows"]:
            raise RuntimeError(f"{version} holds {stored} rows of {written.get['rows']}")
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {version}")
        raise
    for old in _versions(spark, name)[:-keep]:
        spark.sql(f"DROP TABLE IF EXISTS {old}")
    return spark.table(name)


def write_parquet(df: DataFrame, path: str, max_records_per_file: int | None = None) -> DataFrame:
    """Overwrite a parquet folder, optionally with capped rows per file."""
    writer = df.write.mode("overwrite")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


MANIFEST = "number bigint, folder string, rows bigint"


def _manifest(spark: SparkSession, path: str) -> list:
    """What has been published under ``path``, oldest first."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/published").orderBy("number", "folder").collect()  # a row per version
    except AnalysisException:  # nothing yet
        return []


def save_matrix(df: DataFrame, path: str) -> DataFrame:
    """Store a feature matrix as a new version under ``path``; :func:`load_matrix` reads the latest.

    The version has a folder of its own. When its rows are counted, one line is added to the list of
    published versions, a single small file that appears at once; so readers see the old matrix or
    the new one, and a failed write none of it.
    """
    spark = df.sparkSession
    earlier = _manifest(spark, path)
    number = earlier[-1].number + 1 if earlier else 1
    folder = f"v{number:08d}_{uuid.uuid4().hex[:8]}"
    written = Observation()
    stored = write_parquet(df.observe(written, F.count(F.lit(1)).alias("rows")), f"{path}/{folder}")
    rows = stored.count()
    if rows != written.get["rows"]:
        raise RuntimeError(f"{folder} holds {rows} rows of {written.get['rows']}")
    spark.createDataFrame([(number, folder, rows)], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/published")
    return stored


def load_matrix(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The latest published matrix under ``path``, or the one of that number."""
    published = [v for v in _manifest(spark, path) if version in (None, v.number)]
    if not published:
        raise ValueError(f"no such matrix under {path}")
    return spark.read.parquet(f"{path}/{published[-1].folder}")


def write_csv(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).schema(df.schema).csv(path)


def demo_extract(
    rows: DataFrame,
    events: DataFrame,
    items: DataFrame,
    fraction: float,
    limit: int,
    keys: Sequence[str] = ("user_id", "leaf_id", "event_ts"),
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """A small extract: a capped hash sample of scored rows, and the events of their users with images."""
    picked = rows.where(stable_unit(*keys, seed=seed) < fraction)
    picked = take_by_hash(picked, list(keys), limit, seed=seed)
    mine = events.join(picked.select("user_id").distinct(), "user_id", "left_semi")
    return picked, mine.join(items.select("item_id", "image_url"), "item_id")


def user_subset(frame: DataFrame, users: int, seed: int = 42) -> DataFrame:
    """Rows of at most ``users`` users, chosen by hash; nothing is collected."""
    chosen = take_by_hash(frame.select("user_id").distinct(), ["user_id"], users, seed=seed)
    return frame.join(chosen, "user_id", "left_semi")

