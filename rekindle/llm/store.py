"""Intermediate results on storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where `spark.checkpoint.dir` is unset, a local session gets a temporary folder; any other master is refused, since executors
    would write to their own disks.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Managed tables that live until the block ends. Build the result with `cut` before leaving it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.names: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self, names: list[str]) -> None:
        """Drops tables that no later step reads."""
        for name in list(names):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.names.remove(name)

    def table(self, df: DataFrame, bucket_by: str | None = None, **options) -> DataFrame:
        """`df` as a table; bucketed, a later join or grouping on `bucket_by` moves only the other side."""
        name = f"llm_{uuid.uuid4().hex}"
        self.names.append(name)
        writer = df.write.format("parquet").option("compression", "zstd").options(**options)
        if bucket_by:
            writer = writer.bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), bucket_by)
        writer.saveAsTable(name)
        return self.spark.table(name)
