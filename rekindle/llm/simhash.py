"""Near-duplicate documents by SimHash and Hamming balls that meet in the middle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rekindle.llm.components import components
from rekindle.llm.store import cut

WIDTH = 4
RADIUS = 4
#: Bits of a variant that are its shuffle key.
PREFIX = 16
#: Rows of whole buckets that are taken together at least.
CHUNK = 20_000


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64-bit SimHash over word shingles, as an unsigned number; zero without words."""
    words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    first, last = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        h = np.array([digest(whole[s:e], 42) for s, e in zip(first[at : at + (1 << 15)], last[at : at + (1 << 15)])], np.uint64)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def text_key() -> Column:
    """Tells apart rows of one id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_key, fp) of every row of `docs` (doc_id, text): the text's hash and the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], names=["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text_key long, fp long")


@lru_cache
def _flips(bits: int, most: int) -> tuple[np.ndarray, ...]:
    """Masks over the lowest `bits` bits with exactly 0, 1, ... `most` bits set."""
    return tuple(np.array([sum(1 << b for b in c) for c in combinations(range(bits), k)], np.uint64) for k in range(most + 1))


def _meet(bucket: np.ndarray, fp: np.ndarray, prefix: int, half: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of whole buckets, as (fingerprint, smallest fingerprint linked with it here).

    In each of its buckets a fingerprint emits the variants within `half` bits that begin with the bucket's prefix. Fingerprints that share a variant
    are tied to the first of them (all of these are within 2 * half bits of each other), each tie is verified, and ties are
    followed within the buckets, so what leaves is one row for each fingerprint at most, however many copies meet.
    """
    rest = np.uint64(64 - prefix)
    found, owner = np.unique(fp, return_inverse=True)
    spent = np.bitwise_count((fp >> rest) ^ bucket)
    start = (bucket << rest) | (fp & np.uint64((1 << int(rest)) - 1))
    variants, owners = [], []
    for used in range(half + 1):
        own = np.flatnonzero(spent == used)
        for masks in _flips(int(rest), half - used):
            variants.append((start[own][:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(owner[own], len(masks)))
    v, o = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(v, kind="stable")
    v, o = v[order], o[order]
    new = np.concatenate(([True], v[1:] != v[:-1]))
    first = o[np.flatnonzero(new)][np.cumsum(new) - 1]
    tie = np.unique(np.stack([o, first])[:, o != first], axis=1) if (o != first).any() else np.zeros((2, 0), np.int64)
    tie = tie[:, np.bitwise_count(found[tie[0]] ^ found[tie[1]]) <= radius]
    label = np.arange(len(found))
    while True:
        least = np.minimum(label[tie[0]], label[tie[1]])
        after = label.copy()
        np.minimum.at(after, tie[0], least)
        np.minimum.at(after, tie[1], least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = np.flatnonzero(label != np.arange(len(found)))
    return found[moved], found[label[moved]]


def links(fps: DataFrame, radius: int = RADIUS, prefix: int = PREFIX) -> DataFrame:
    """Links (a, b) that connect just those of the distinct fingerprints `fps` (fp) that chains of at most `radius` bits connect.

    Fingerprints within `radius` bits share a variant within half of it (rounded up) of both. Variants are shuffled by their first `prefix` bits: a
    fingerprint goes once to each prefix within half the radius, and emits there the variants that begin so. So
    all variants meet, but only as many rows move as there are prefixes in the ball. A bucket should fit a task: with n fingerprints it holds
    about n / 480 for 16 bits, n / 32,000 for 24.
    """
    half = (radius + 1) // 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.concatenate(_flips(prefix, half))
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                fp = batch.column(0).slice(at, 10_000).to_numpy(zero_copy_only=False)
                bucket = (fp.view(np.uint64) >> np.uint64(64 - prefix))[:, None] ^ masks[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().astype(np.int64)), pa.array(np.repeat(fp, len(masks)))], names=["bucket", "fp"])

    def tied(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = _meet(bucket.view(np.uint64), fp.view(np.uint64), prefix, half, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            bucket = np.concatenate([bucket, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            whole = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            if whole >= CHUNK:
                yield tied(bucket[:whole], fp[:whole])
                bucket, fp = bucket[whole:], fp[whole:]
        if len(fp):
            yield tied(bucket, fp)

    buckets = fps.select("fp").mapInArrow(spread, "bucket long, fp long").repartition("bucket").sortWithinPartitions("bucket")
    return buckets.mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id, is_first) of every row of `docs` (doc_id, text).

    Fingerprints link at `radius` or fewer differing bits and components follow links; component_id is the smallest doc_id of the component. is_first
    marks the row with that id (and the smallest text_key, should several texts have it). Null, empty and blank texts have fingerprint zero and link
    like any other. Rows with a null id take part and come last; a component of null ids only has a null component_id. Equal rows are marked alike.
    Copies share a fingerprint, so the ball search and the components see each fingerprint once.
    """
    own = cut(fingerprints(docs, width))
    label = components(links(own.select("fp").distinct(), radius))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    least = own.groupBy("fp").agg(F.min(place).alias("least"))
    tied = least.join(label, least.fp == label.node, "left").select("fp", F.coalesce("label", "fp").alias("label"), "least")
    smallest = tied.groupBy("label").agg(F.min("least").alias("first"))
    by_fp = tied.join(smallest, "label").select(F.col("fp").alias("_fp"), "first")
    out = own.join(by_fp, F.col("fp") == F.col("_fp"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return out.select("doc_id", "text_key", text, F.col("first.doc_id").alias("component_id"), place.eqNullSafe(F.col("first")).alias("is_first"))


def one_of_each(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """The first row of each component of `docs` (doc_id, text, any others); of rows with equal id and text one stays."""
    first = near_duplicates(docs, width, radius).where("is_first").select(F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key")).distinct()
    whole = docs.select(F.struct("*").alias("doc"))  # so that no column can clash
    keyed = whole.select("doc", F.col("doc.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("doc.text", F.lit(""))).alias("text_key"))
    kept = keyed.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text_key"]).select("doc.*")
