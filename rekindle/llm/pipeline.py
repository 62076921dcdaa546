"""Cleaning a corpus: rejected documents leave, repeated lines, near copies and benchmark texts go, sources are mixed.

Every stage takes the documents that its predecessor kept, with the texts as it left them, and all but the last return
the columns of `documents`, whatever their names. Stages are written as Parquet and read again, so each starts from a stored table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rekindle.llm import decontam, linededup, mixing, quality, simhash
from rekindle.llm.store import shared_folder


def _aside(docs: DataFrame) -> DataFrame:
    """`docs` with all columns that no stage reads under names that no operator makes."""
    return docs.withColumnsRenamed({c: _aside_name(c) for c in docs.columns})


def _aside_name(column: str) -> str:
    return column if column in ("doc_id", "text", "source") else f"_docs_{column}"


def _restored(docs: DataFrame) -> list[Column]:
    """The columns of `docs` from what an operator made of `_aside(docs)`."""
    return [F.col(f"`{_aside_name(c)}`").alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and have enough content lines."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(_aside(docs), model).where("kept").select(*_restored(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; a document that has no line left goes."""
    out = linededup.remove_repeated_lines(_aside(docs))
    return out.where(~((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines")))).select(*_recounted(docs))


def _recounted(docs: DataFrame) -> list[Column]:
    """The columns of `docs`, with n_chars as the text now has them."""
    return [F.length("text").cast(docs.schema[name].dataType).alias(name) if name == "n_chars" else c for name, c in zip(docs.columns, _restored(docs))]


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near copies, by op1's shingles and bit distance."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each row judged by its own text."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by_row=True)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks, numbered by `copy` (in place of a column of that name)."""
    return mixing.mix(_aside(docs)).select(*_restored(docs.drop("copy")), "copy")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing_sources),
]

#: SQL can't decode the line field; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
