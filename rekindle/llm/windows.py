"""Windows of consecutive tokens that other documents repeat, found through the anchors of a corpus.

Every window of `length` tokens has one anchor: the place in it whose `gram`-token string has the smallest hash (the first of equals).
Equal windows have their anchor at the same place with the same gram, so

1. grams of anchors (about one for each 13 tokens) are matched over the corpus, and those of one document only are dropped;
2. anchors left over send their context (all windows that have this anchor, in one string) to a shard by gram; equal contexts of a batch of
   documents travel once, with the smallest id. The shard says which windows of a context also stand in a document with a
   smaller id than the smallest of the context's own; in documents with larger ids all of them do;
3. every batch applies the answers to its texts.

Documents are packed into batches once, in a table bucketed by batch: matches, contexts and answers move, texts don't.
Step 1 compares 40 bits and the bucket's number; a chance match only adds a candidate, as step 2 compares the tokens themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekindle.llm.store import Scratch, cut

#: Bytes of text in a batch, about.
BATCH_BYTES = 4 << 20
#: Bytes of text whose anchors share a bucket, about; more buckets are used for more data.
PER_BUCKET = 24 << 20
LAST_ID = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15
_LOW40 = np.uint64((1 << 40) - 1)


@dataclass(frozen=True)
class Tokens:
    """How texts become tokens. All functions take the tokens of one document as `split` returns them."""

    length: int
    gram: int
    split: Callable  # bytes of a text -> tokens
    values: Callable  # tokens -> one uint64 for each
    piece: Callable  # tokens, from, to -> bytes of that stretch
    size: Callable  # bytes of a stretch -> number of its tokens
    kept: Callable  # tokens, boolean array -> bytes of the tokens it marks
    repeated: Callable  # contexts, their ids -> boolean array for each: windows that a smaller id has too
    per_shard: int  # bytes of text whose contexts share a shard, about


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(values: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and gram hash of each anchor of a document's tokens."""
    if len(values) < length:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    up, down = _powers(max(1 << 16, 1 << (len(values) - 1).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])))
    h = mixed((sums[gram:] - sums[:-gram]) * down[: len(values) - gram + 1])
    least, size, wide = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1, length - gram + 1
    while size * 2 <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if wide > size:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    owner = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    last = np.concatenate((first[1:] - 1, [len(owner) - 1]))
    return first, last, mixed(h[owner[first]] + np.uint64(1))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) as batches of documents."""
    number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary())), pa.array([size])], names=["batch", "ids", "texts", "size"])

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(i)
            texts.append((text.as_py() or "").encode())
            size += len(texts[-1])
            if size >= BATCH_BYTES:
                yield out()
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield out()


class _Batch:
    """The anchors of a batch's documents and, given the matches, their contexts."""

    def __init__(self, kind: Tokens, ids: list, texts: list, n_buckets: int):
        self.kind = kind
        self.ids = [LAST_ID if i is None else i for i in ids]
        self.tokens = [kind.split(t) for t in texts]
        found = [anchors(kind.values(t), kind.length, kind.gram) for t in self.tokens]
        self.doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        self.first, self.last, key = (np.concatenate([f[k] for f in found]) for k in range(3))
        self.shard_key = key >> np.uint64(8)
        place = (((key >> np.uint64(40)) % np.uint64(n_buckets)) << np.uint64(40)) | (key & _LOW40)
        self.places, self.which = np.unique(place, return_inverse=True)

    def sent(self) -> Iterator[tuple[int, bytes]]:
        """Buckets with the 40 bits of each distinct gram in them."""
        bucket = (self.places >> np.uint64(40)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
        for s, e in zip(starts, [*starts[1:], len(bucket)]):
            yield int(bucket[s]), np.ascontiguousarray(self.places[s:e].view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()

    def contexts(self, matches: list | None, n_shards: int):
        """The anchors with matches elsewhere, the context of each, and the contexts of each shard with their smallest ids."""
        if not len(self.places):
            return np.zeros(0, np.int64), [], {}
        elsewhere = np.zeros(len(self.places), bool)
        bucket = (self.places >> np.uint64(40)).astype(np.int64)
        for m in matches or []:
            s, e = np.searchsorted(bucket, [m["bucket"], m["bucket"] + 1])
            elsewhere[s:e] = np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=e - s)
        low, high = np.full(len(self.places), len(self.ids)), np.full(len(self.places), -1)
        np.minimum.at(low, self.which, self.doc)
        np.maximum.at(high, self.which, self.doc)
        live = np.flatnonzero((elsewhere | (low != high))[self.which])
        shards: dict[int, dict[bytes, list]] = {}
        of_anchor, piece, length, ids, tokens = [], self.kind.piece, self.kind.length, self.ids, self.tokens
        shard = (self.shard_key[live] % np.uint64(n_shards)).astype(np.int64).tolist()
        for s, d, a, b in zip(shard, self.doc[live].tolist(), self.first[live].tolist(), self.last[live].tolist()):
            own = shards.setdefault(s, {})
            text = piece(tokens[d], a, b + length)
            entry = own.get(text)
            if entry is None:
                entry = own[text] = [len(own), ids[d]]
            elif ids[d] < entry[1]:
                entry[1] = ids[d]
            of_anchor.append((s, entry[0]))
        return live, of_anchor, shards


def _rows(table: DataFrame, run: Callable, schema: str) -> DataFrame:
    """`run` over every row of `table`, as dictionaries; it yields tuples of `schema`."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                out = list(run(row))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=names)

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]
    return table.mapInArrow(each, schema)


def _shared_grams(_key, table):
    """For every batch of a bucket: which of the grams it sent came from another batch too."""
    sent = [np.frombuffer(g, np.uint8).reshape(-1, 5) for g in table.column("grams").to_pylist()]
    flat = np.zeros((sum(map(len, sent)), 8), np.uint8)
    flat[:, :5] = np.concatenate(sent)
    _, which, count = np.unique(flat.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    twice, ends = (count > 1)[which], np.cumsum([len(s) for s in sent])
    bits = [np.packbits(twice[e - len(s) : e]).tobytes() for s, e in zip(sent, ends)]
    return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def remove_repeats(docs: DataFrame, kind: Tokens) -> DataFrame:
    """(doc_id, n_tokens, n_removed, n_spans, kept_sha256) of each row of `docs` (doc_id, text).

    A token goes if a window that covers it also starts in a document with a smaller id; ids that are null count as the largest. Null texts
    are empty. Rows with one id do not repeat each other. Texts of any length are whole.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        pairs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        table = scratch.table(pairs.mapInArrow(_packed, "batch long, ids array<long>, texts array<binary>, size long"), bucket_by="batch")
        size = table.agg(F.sum("size")).first()[0] or 0
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        n_buckets = max(partitions, size // PER_BUCKET)
        n_shards = max(partitions, size // kind.per_shard)

        def send_grams(row):
            for bucket, grams in _Batch(kind, row["ids"], row["texts"], n_buckets).sent():
                yield row["batch"], bucket, grams

        def send_contexts(row):
            _, _, shards = _Batch(kind, row["ids"], row["texts"], n_buckets).contexts(row["matches"], n_shards)
            for shard, own in shards.items():
                yield row["batch"], shard, b"".join(own), np.array([len(t) for t in own], np.uint32).tobytes(), np.array([e[1] for e in own.values()], np.int64).tobytes()

        def answer(_key, part):
            """For every batch of a shard: the smallest id of each context it sent, and which windows of that id's go."""
            least: dict[bytes, int] = {}
            sent = []
            for text, lengths, ids in zip(*(part.column(c).to_pylist() for c in ("contexts", "lengths", "ids"))):
                ends = np.cumsum(np.frombuffer(lengths, np.uint32).astype(np.int64)).tolist()
                own = [text[s:e] for s, e in zip([0, *ends], ends)]
                sent.append(own)
                for t, i in zip(own, np.frombuffer(ids, np.int64).tolist()):
                    if i < least.get(t, LAST_ID + 1):
                        least[t] = i
            marks = dict(zip(least, kind.repeated(list(least), list(least.values()))))
            ids = [np.array([least[t] for t in own], np.int64).tobytes() for own in sent]
            gone = [np.packbits(np.concatenate([marks[t] for t in own])).tobytes() for own in sent]
            return pa.table({"batch": part.column("batch"), "shard": part.column("shard"), "ids": pa.array(ids, pa.binary()), "gone": pa.array(gone, pa.binary())})

        def apply(row):
            batch = _Batch(kind, row["ids"], row["texts"], n_buckets)
            live, of_anchor, shards = batch.contexts(row["matches"], n_shards)
            length = kind.length
            answers = {}
            for a in row["answers"] or []:
                windows = [kind.size(t) - length + 1 for t in shards[a["shard"]]]
                bits = np.unpackbits(np.frombuffer(a["gone"], np.uint8), count=sum(windows)).astype(bool)
                answers[a["shard"]] = np.frombuffer(a["ids"], np.int64).tolist(), np.concatenate(([0], np.cumsum(windows))).tolist(), bits
            edges = {}
            for d, first, last, (shard, k) in zip(batch.doc[live].tolist(), batch.first[live].tolist(), batch.last[live].tolist(), of_anchor):
                ids, ends, bits = answers[shard]
                if batch.ids[d] > ids[k]:
                    starts, stops = [first], [last + length]
                else:
                    starts = (np.flatnonzero(bits[ends[k] : ends[k + 1]]) + first).tolist()
                    stops = [s + length for s in starts]
                if starts:
                    edge = edges.setdefault(d, ([], []))
                    edge[0].extend(starts)
                    edge[1].extend(stops)
            for d, (doc_id, tokens) in enumerate(zip(row["ids"], batch.tokens)):
                n = len(tokens)
                gone = np.zeros(n, bool)
                if d in edges:
                    step = np.bincount(edges[d][0], minlength=n + 1) - np.bincount(edges[d][1], minlength=n + 1)
                    gone = np.cumsum(step)[:n] > 0
                spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
                yield doc_id, n, int(gone.sum()), spans, hashlib.sha256(kind.kept(tokens, ~gone)).hexdigest()

        grams = _rows(table.select("batch", "ids", "texts"), send_grams, "batch long, bucket long, grams binary")
        matches = grams.groupBy("bucket").applyInArrow(_shared_grams, "batch long, bucket long, bits binary")
        matches = cut(matches.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias("matches")))
        matched = table.select("batch", "ids", "texts").join(matches, "batch", "left")
        contexts = _rows(matched, send_contexts, "batch long, shard long, contexts binary, lengths binary, ids binary")
        answers = contexts.groupBy("shard").applyInArrow(answer, "batch long, shard long, ids binary, gone binary")
        answers = cut(answers.groupBy("batch").agg(F.collect_list(F.struct("shard", "ids", "gone")).alias("answers")))
        out = _rows(matched.join(answers, "batch", "left"), apply, "doc_id long, n_tokens long, n_removed long, n_spans long, kept_sha256 string")
        return cut(out)
