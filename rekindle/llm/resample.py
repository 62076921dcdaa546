"""Documents drawn by importance weights towards a target distribution of hashed word runs."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rekindle.llm.store import cut

#: Length of the counted vectors: the only thing that passes through the driver and goes to every task.
BUCKETS = 10_000
MAX_RUN = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Halvings of the searched interval that one count job answers.
LEVELS = 4

_SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
#: A-Z lower-cased, everything that separates words a space.
_FOLD = bytes.maketrans(_SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)))


def word_pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text (runs of digits, letters and anything beyond ASCII, A-Z lower-cased), a bounded stretch at a time."""
    folded = (text or "").encode().translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE) if at + PIECE < len(folded) else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def feature_buckets(text: str | None, max_run: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) for each stretch of a text. Features are runs of 1 to `max_run` words, joined by a space."""
    crc, before = zlib.crc32, []
    for words in word_pieces(text):
        codes = [crc(w) for w in words]
        if max_run > 1:
            run = before + words
            for size in range(2, max_run + 1):
                first = max(0, len(before) - size + 1)
                codes += [crc(b" ".join(run[k : k + size])) for k in range(first, len(run) - size + 1)]
            before = run[len(run) - max_run + 1 :]
        yield len(words), np.array(codes, np.int64) % buckets


def bucket_counts(texts: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all of `texts` (text) in each bucket. Every task adds up its own vector; `buckets` sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, own in feature_buckets(text.as_py(), max_run, buckets):
                    total += np.bincount(own, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: a thousand times the logarithm of target over corpus frequency, each with one more count."""
    n, scale_corpus, scale_target = len(corpus), int(corpus.sum()) + len(corpus), int(target.sum()) + len(corpus)
    return np.array([math.floor(1000 * math.log((int(target[b]) + 1) * scale_corpus / ((int(corpus[b]) + 1) * scale_target))) for b in range(n)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """A thousand times a Gumbel draw that depends on the id alone."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, max_run: int = MAX_RUN, seed: int = SEED) -> DataFrame:
    """`docs` with row, n_words, n_features, weight and score; row tells apart rows that agree in everything.

    Columns other than doc_id and text come along under `rest`, whatever their names.
    """
    buckets = len(gain)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((4, batch.num_rows), np.int64)
            for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                for n, own in feature_buckets(text.as_py(), max_run, buckets):
                    out[:3, k] += n, len(own), gain[own].sum()
                out[3, k] = out[2, k] + noise(doc_id, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], names=[*batch.schema.names, "n_words", "n_features", "weight", "score"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.struct(*rest).alias("rest") if rest else F.lit(None).cast("string").alias("rest"))
    schema = f"{', '.join(f'{n} {t}' for n, t in own.dtypes)}, n_words long, n_features long, weight long, score long"
    return own.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def cutoff(rows: DataFrame, keys: Sequence[str], take: int) -> list[int]:
    """The longest needed prefix of `keys` values (whole numbers, none null) at which exactly `take` rows are at or before it, in ascending order.

    Each key is found by halving the interval of its values among the rows that tie in the earlier ones: a job counts the rows up to the
    midpoints of the next `LEVELS` halvings, exactly, wherever the rows are. It ends with the key whose ties are taken whole; the last key is to be unique.
    """
    found: list[int] = []
    for key in keys:
        low, high = rows.agg(F.min(key), F.max(key)).first()
        while low < high:
            points = sorted({low + (high - low) * k // (1 << LEVELS) for k in range(1 << LEVELS)} - {high})
            upto = rows.agg(*(F.count(F.when(F.col(key) <= p, 1)).alias(f"n{i}") for i, p in enumerate(points))).first()
            reached = [i for i, n in enumerate(upto) if n >= take]
            below = reached[0] if reached else len(points)
            high = points[below] if reached else high
            low = points[below - 1] + 1 if below else low
        found.append(low)
        before, ties = rows.agg(F.count(F.when(F.col(key) < low, 1)), F.count(F.when(F.col(key) == low, 1))).first()
        take -= before
        if ties == take:
            return found
        rows = rows.where(F.col(key) == low)
    return found


def _reached(keys: Sequence[str], limit: Sequence[int]) -> Column:
    """Whether a row is at or before `limit` in the order of `keys`."""
    out = F.lit(True)
    for key, value in reversed(list(zip(keys, limit))):
        out = (F.col(key) < value) | ((F.col(key) == value) & out)
    return out


def ranked(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`rows` with rank 1, 2, 3, ... in the order of `keys`: dealt out by range, each range sorted, numbered after the counts of the ranges before it."""
    spread = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()))
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = spread.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    ahead: dict[int, int] = {}  # one number for each range
    total = 0
    for r in sizes.orderBy("_part").collect():
        ahead[r._part] = total
        total += r._n
    if not ahead:
        return spread.drop("_place").withColumn("rank", F.lit(None).cast("long"))
    offsets = spread.sparkSession.createDataFrame(list(ahead.items()), "_part long, _ahead long")
    return spread.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_ahead") + within + 1).drop("_part", "_place", "_ahead")


def judged(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, max_run: int = MAX_RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, text, rest, n_words, n_features, weight, score, rank) of every row of `docs` (doc_id, text, any others) against `target` (text).

    Of the N rows with at least `min_words` words the floor(percent * N / 100) with the highest scores are drawn and ranked; ties go to the smaller doc_id,
    null ids last, then to the smaller row, so exactly that many are drawn however many tie. A score is the weight plus noise that depends on the id
    alone, which makes the draw one without replacement in proportion to the exponential of the weights. Null texts have no words; a null id takes
    part with the noise of an empty id. With an empty target a bucket's frequency there is uniform; without rows nothing is drawn.
    """
    gain = gains(bucket_counts(docs, max_run, buckets), bucket_counts(target, max_run, buckets))
    rows = cut(scored(docs, gain, max_run, seed).withColumns({"_down": -F.col("score"), "_nameless": F.col("doc_id").isNull().cast("int"), "_id": F.coalesce("doc_id", F.lit(0))}))
    keys, made = ["_down", "_nameless", "_id", "row"], ["_down", "_nameless", "_id", "row"]
    able = rows.where(F.col("n_words") >= min_words)
    take = percent * able.count() // 100
    if take == 0:
        return rows.drop(*made).withColumn("rank", F.lit(None).cast("long"))
    drawn = (F.col("n_words") >= min_words) & _reached(keys, cutoff(able, keys, take))
    rest = rows.where(~drawn).drop(*made).withColumn("rank", F.lit(None).cast("long"))
    return ranked(rows.where(drawn), keys).drop(*made).unionByName(rest)


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of `docs`, all columns as they are, and their rank under `rank` (in place of a column of that name)."""
    out = judged(docs, target, **options).where("rank is not null")
    return out.select(*(F.col("rank") if c == "rank" else F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c != "rank"), "rank")
