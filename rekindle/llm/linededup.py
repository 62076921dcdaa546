"""Removal of repeated line runs with a suffix array over line ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rekindle.llm.store import cut

MIN_LINES = 2
#: What tells documents apart and orders them: the id, null last, then the text's hash.
KEY = ["key_id", "key_text"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Equal rows get equal keys and are one document here."""
    return docs.withColumns({"key_id": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "key_text": F.xxhash64(F.coalesce("text", F.lit("")))})


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """`rows` (KEY, pos, and the columns of `by`) with `rank` in the order of `by`, equal only where these are equal.

    Rows whose value no other row has can't be part of a repeat and leave here. The distinct values are counted before
    the shuffle and sorted over all tasks by range, so a value that most lines have is one row of the sort; it meets its lines in a
    join that splits large keys.
    """
    values = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(*by)
    ordered = cut(values.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()))
    return cut(rows.join(ordered, by).select(*KEY, "pos", "rank"))


def _two(rows: DataFrame, ahead: int) -> DataFrame:
    """Each row with its own rank and the rank `ahead` lines on in the same document; rows without one leave."""
    other = rows.select(*KEY, (F.col("pos") - ahead).alias("pos"), F.col("rank").alias("second"))
    return rows.withColumnRenamed("rank", "first").join(other, [*KEY, "pos"])


def suffix_ranks(docs: DataFrame, depth: int) -> DataFrame:
    """The part of the suffix array that holds repeats: (KEY, pos, rank) for all suffixes of lines whose first `depth` lines occur elsewhere.

    `rank` orders suffixes by their first `depth` lines, and suffixes with equal rank are one interval of the array whose
    longest common prefix has at least `depth` lines. Lines are named by rank first; then each round doubles the compared length by ranking pairs of
    ranks (k lines and the k lines behind them). The last round overlaps where `depth` is no power of two.
    """
    lines = _keyed(docs.where(F.col("text").isNotNull())).select(*KEY, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # 128 bits name a line's content until ranks do, so no text is shuffled; equal rows become one document here.
    named = lines.select(*KEY, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2")).distinct()
    rows = _ranked(named, ["h1", "h2"])
    k = 1
    while k < depth:
        step = min(k, depth - k)
        rows = _ranked(_two(rows, step), ["first", "second"])
        k += step
    return rows


def later_copies(ranks: DataFrame) -> DataFrame:
    """(KEY, pos) of each member of an interval but the one that comes first in the corpus."""
    place = F.struct(*KEY, "pos")
    least = ranks.groupBy("rank").agg(F.min(place).alias("least"))
    return ranks.join(least, "rank").where(place > F.col("least")).select(*KEY, "pos")


def remove_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """All rows and columns of `docs` (doc_id, text, any others) with the text's later copies of repeated line runs removed, and
    n_lines, n_removed and n_runs (maximal removed runs).

    A run of at least `min_lines` lines (pieces between \\n, compared as they are) is a later copy if it also stands at an earlier place: in a document
    with a smaller id, or further up in its own. Its lines are removed whatever the length of the whole run: a line is in a maximal repeated
    run of `min_lines` or more just if one of the `min_lines`-line prefixes that cover it is a later member of its interval, so doubling ends at
    that depth. Runs are judged on the input, overlaps count, and the other lines are joined by \\n again.

    Null texts stay null and have no lines; an empty text has one empty line. Equal rows count as one document and get
    equal results; null ids come last, and among rows of one id the text's hash decides. Columns of `docs` by the names of results are replaced.
    """
    made = ["n_lines", "n_removed", "n_runs"]
    rest = docs.drop(*made, *KEY, "_starts")
    starts = later_copies(suffix_ranks(docs.select("doc_id", "text"), min_lines))
    by_doc = starts.groupBy(*KEY).agg(F.collect_set("pos").alias("_starts"))  # at most a document's lines
    joined = _keyed(rest).join(by_doc, KEY, "left").drop(*KEY)
    fields = [f for f in rest.schema.fields]
    schema = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in made)])
    at = rest.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(batch.num_columns - 1)
            texts, counts = [], []
            for text, where in zip(batch.column(at).to_pylist(), starts):
                kept, *count = _without(text, where.as_py(), min_lines)
                texts.append(kept)
                counts.append(count)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))], names=schema.names)

    return joined.mapInArrow(run, schema)


def _without(text: str | None, starts: list[int] | None, min_lines: int) -> tuple[str | None, int, int, int]:
    """The text without the lines that runs from `starts` cover; its lines, removed lines and removed runs."""
    if text is None:
        return None, 0, 0, 0
    if not starts:
        return text, text.count("\n") + 1, 0, 0
    lines = text.split("\n")
    edge = np.zeros(len(lines) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.array(starts) + min_lines, -1)
    gone = np.cumsum(edge)[:-1] > 0
    runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
    return "\n".join(x for x, g in zip(lines, gone.tolist()) if not g), len(lines), int(gone.sum()), runs


