"""Token counts by a public tokenizer file; huge texts are encoded in overlapping chunks that are spliced where both agree."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Encoding, Tokenizer

from rekindle.llm.store import cut

#: Characters that one chunk of a huge text adds to the one before, and how far it reaches into the next.
STEP = 65_536
OVERLAP = 512
#: Factor by which chunks and overlaps grow where two chunks have no boundary in common.
WIDER = 8
#: Characters that go through the tokenizer at once, whatever the rows of a batch.
BATCH_CHARS = 200_000
#: Pieces of text whose token counts a task remembers.
KNOWN = 500_000

_CHUNKS = "key string, k int, is_last boolean, chunk string"
_MARKS = "key string, k int, is_last boolean, n_tokens long, marks array<struct<seam:int,place:long,side:int,before:long>>"


@lru_cache
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of the file at `path`, which every executor must have there; without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def _lookahead(own: Tokenizer) -> int:
    """Characters after a boundary that the choice of it can depend on: the longest special string or a contraction."""
    return 4 + max((len(t.content) for t in own.get_added_tokens_decoder().values()), default=0)


@lru_cache
def breaks_at_space(path: str) -> bool:
    """Whether ASCII white space is a boundary of the tokenizer at `path` wherever it stands: it leaves no token, and no special string holds or takes it."""
    own = tokenizer(path)
    for space in " \t\n\r\x0b\x0c":
        for text in (space, f"a{space}b", f"a{space}{space}!", f"!{space}a{space}"):
            if own.encode(text, add_special_tokens=False).tokens != [t for part in text.split(space) for t in own.encode(part, add_special_tokens=False).tokens]:
                return False
    return not any(t.lstrip or t.rstrip or t.normalized or len(t.content.split()) != 1 for t in own.get_added_tokens_decoder().values())


def _encoded_lengths(texts: list[str], own: Tokenizer) -> list[int]:
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_CHARS):
            size += len(texts[end])
            end += 1
        out += map(len, own.encode_batch_fast(texts[at:end], add_special_tokens=False))
        at = end
    return out


def counts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text.

    Where white space is a boundary, each piece between it is encoded once, however often the texts have it; up to KNOWN pieces are remembered at
    a time. Other tokenizers get each different text whole.
    """
    own = tokenizer(path)
    if not breaks_at_space(path):
        different = list(dict.fromkeys(texts))
        by_text = dict(zip(different, _encoded_lengths(different, own)))
        return [by_text[t] for t in texts]
    known: dict[bytes, int] = {}
    out, group, size = [], [], 0
    for k, text in enumerate(texts):
        group.append(text.encode().split())  # bytes: splits at ASCII white space only
        size += len(text)
        if size >= BATCH_CHARS or k == len(texts) - 1:
            new = list(dict.fromkeys(p for pieces in group for p in pieces if p not in known))
            known.update(zip(new, _encoded_lengths([p.decode() for p in new], own)))
            out += [sum(map(known.__getitem__, pieces)) for pieces in group]
            group, size = [], 0
            if len(known) > KNOWN:
                known.clear()
    return out


def chunks(text: str, step: int, overlap: int) -> list[str]:
    """Stretches of step + overlap characters that begin every `step`; the last one reaches the end."""
    n = max(1, -(-(len(text) - overlap) // step))
    return [text[k * step : (k + 1) * step + overlap] for k in range(n - 1)] + [text[(n - 1) * step :]]


def stable_starts(encoding: Encoding, chunk: str, begin: int, end: int) -> list[tuple[int, int]]:
    """(place, tokens before it) of the stable boundaries of `chunk` in [begin, end).

    A boundary is the start of a word of the tokenizer's splitter. The splitter matches from left to right and remembers nothing, so two encodings
    that both start a word at one place go on alike. It is stable if normalisation can't reach across it either: an ASCII character or a
    unified ideograph there is never composed with what stands before it, and nothing is composed with white space.
    """
    first = next((i for i in map(encoding.char_to_token, range(begin, end)) if i is not None), len(encoding))
    out, before, word = [], -1, None
    if first > 0:
        before, word = encoding.token_to_chars(first - 1)[0], encoding.token_to_word(first - 1)
    for i in range(first, len(encoding)):
        at, own = encoding.token_to_chars(i)[0], encoding.token_to_word(i)
        if at >= end:
            break
        if at >= begin and (i == 0 or own != word and before < at):  # a character can lower to two words
            c = chunk[at]
            if c < "\x80" or "㐀" <= c <= "鿿" or at and chunk[at - 1] in " \t\n\r\x0b\x0c":
                out.append((at, i))
        before, word = at, own
    return out


def _cut_up(texts: DataFrame, step: int, overlap: int) -> DataFrame:
    """The chunks of every distinct text of `texts` (key, text), dealt out anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = chunks(text.as_py(), step, overlap)
                for at in range(0, len(own), 64):
                    part = own[at : at + 64]
                    last = [at + k == len(own) - 1 for k in range(len(part))]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part)), pa.array(range(at, at + len(part)), pa.int32()), pa.array(last), pa.array(part)], names=["key", "k", "is_last", "chunk"])

    return texts.mapInArrow(run, _CHUNKS).groupBy("key", "k").agg(F.first("is_last").alias("is_last"), F.first("chunk").alias("chunk"))


def _encoded(pieces: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """Tokens of each chunk, and its stable boundaries in what it shares with its neighbours.

    seam k lies between the chunks k and k + 1, place counts from its begin, side is 1 in chunk k and -1 in chunk k + 1. The last characters of a chunk,
    whose tokens may depend on what it does not hold, give no boundary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        reach = _lookahead(own)
        for batch in batches:
            for key, k, is_last, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                got = own.encode(chunk, add_special_tokens=False)
                marks = [] if k == 0 else [(k - 1, p, -1, n) for p, n in stable_starts(got, chunk, 1, min(overlap, len(chunk)))]
                if not is_last:
                    marks += [(k, p - step, 1, n) for p, n in stable_starts(got, chunk, step, step + overlap - reach)]
                columns = dict(zip(("seam", "place", "side", "before"), zip(*marks))) if marks else dict.fromkeys(("seam", "place", "side", "before"), ())
                kinds = dict(seam=pa.int32(), place=pa.int64(), side=pa.int32(), before=pa.int64())
                fields = pa.StructArray.from_arrays([pa.array(columns[f], kinds[f]) for f in kinds], names=list(kinds))
                listed = pa.ListArray.from_arrays(pa.array(np.array([0, len(marks)]), pa.int32()), fields)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int32()), pa.array([is_last]), pa.array([len(got)], pa.int64()), listed], names=["key", "k", "is_last", "n_tokens", "marks"])

    return pieces.mapInArrow(run, _MARKS)


def _spliced(encoded: DataFrame) -> DataFrame:
    """(key, n_tokens) of every text; null where two of its chunks share no stable boundary.

    Up to the first boundary that both sides of a seam have, the left chunk's tokens count, from there on the right one's.
    """
    marks = encoded.select("key", F.explode("marks").alias("m")).select("key", "m.*")
    shared = marks.groupBy("key", "seam", "place").agg(F.count("*").alias("sides"), F.sum(F.col("side") * F.col("before")).alias("gain")).where("sides = 2")
    seams = shared.groupBy("key", "seam").agg(F.min_by("gain", "place").alias("gain"))
    joined = seams.groupBy("key").agg(F.count("*").alias("n_seams"), F.sum("gain").alias("gain"))
    ends = encoded.where("is_last").select("key", "k", "n_tokens")
    whole = F.coalesce("n_seams", F.lit(0)) == F.col("k")
    return ends.join(joined, "key", "left").select("key", F.when(whole, F.col("n_tokens") + F.coalesce("gain", F.lit(0))).alias("n_tokens"))


def long_counts(texts: DataFrame, path: str, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of every key of `texts` (key, text), equal keys with equal texts.

    All chunks of all texts are encoded side by side. Texts with a seam that shares no boundary (a word longer than the overlap, say) are cut again with
    chunks and overlaps `WIDER` times as long, until each seam has one or a text is one chunk; so the count is always that of the whole text.
    """
    if overlap >= step:
        raise ValueError("chunks must be longer than their overlap")
    done, left = None, texts
    while True:
        found = cut(_spliced(cut(_encoded(_cut_up(left, step, overlap), path, step, overlap))))
        ready = found.where("n_tokens is not null")
        done = ready if done is None else done.union(ready)
        failed = found.where("n_tokens is null").select("key")
        if failed.isEmpty():
            return done
        left = texts.join(failed, "key", "left_semi")
        step, overlap = step * WIDER, overlap * WIDER


def token_counts(docs: DataFrame, path: str, limit: int, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of `docs` (doc_id, text; other columns are not read).

    n_tokens is what the tokenizer file at `path` gives for the whole text, without tokens it would add itself; its special strings in a text count as
    it counts them. Null texts count as empty: no bytes, no tokens. Rows of null or repeated ids are counted one by one.
    Texts of up to one chunk are counted where they are read; only chunks of longer ones move, one copy of each text.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    longest = step + overlap
    size = F.octet_length("text").cast("long").alias("n_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array(counts(batch.column(2).to_pylist(), path), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], n], names=["doc_id", "n_bytes", "n_tokens"])

    short = rows.where(F.length("text") <= longest).select("doc_id", size, "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    keyed = rows.where(F.length("text") > longest).withColumn("key", F.sha2("text", 256))
    counted = long_counts(keyed.select("key", "text"), path, step, overlap)
    long = keyed.select("doc_id", size, "key").join(counted, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.union(long).withColumn("over_limit", F.col("n_tokens") > limit)
