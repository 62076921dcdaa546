"""Removal of repeated byte strings by a depth-limited radix sort of suffixes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from rekindle.llm.windows import Tokens, remove_repeats

LENGTH = 50
GRAM = 25
_VALUE = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64)


def equal_groups(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of `text` at `starts` that are alike for `length` bytes: (indexes into starts, group numbers), groups of one left out.

    Most significant digit first: a pass orders the suffixes of each group by their next eight bytes and splits it, and suffixes alone
    in a group leave. So no suffix is compared beyond `length` bytes, and most are given up after the first passes.
    """
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    live, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in range(0, length, 8):
        at = starts[live] + depth
        digit = np.zeros(len(live), np.uint64)
        for k in range(min(8, length - depth)):
            digit = (digit << np.uint64(8)) | padded[at + k]
        order = np.lexsort((digit, group))
        live, group, digit = live[order], group[order], digit[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])))
        ends = np.concatenate((new[1:], [True]))
        group = np.cumsum(new) - 1
        several = ~(new & ends)
        live, group = live[several], group[several]
        if not len(live):
            break
    return live, group


def _repeated(length: int):
    def run(contexts: list[bytes], ids: list[int]) -> list[np.ndarray]:
        sizes = np.array([len(c) for c in contexts])
        windows = sizes - length + 1
        ends = np.cumsum(windows)
        own = np.repeat(np.arange(len(contexts)), windows)
        starts = np.arange(ends[-1]) - np.repeat(ends - windows, windows) + np.repeat(np.cumsum(sizes) - sizes, windows)
        live, group = equal_groups(np.frombuffer(b"".join(contexts), np.uint8), starts, length)
        doc = np.array(ids, np.int64)[own]
        gone = np.zeros(len(starts), bool)
        if len(live):
            heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            least = np.minimum.reduceat(doc[live], heads)
            gone[live] = np.repeat(least, np.diff(np.concatenate((heads, [len(live)])))) < doc[live]
        return np.split(gone, ends[:-1])

    return run


def byte_tokens(length: int = LENGTH, gram: int = GRAM) -> Tokens:
    return Tokens(
        length,
        gram,
        split=lambda text: text,
        values=lambda text: _VALUE[np.frombuffer(text, np.uint8)],
        piece=lambda text, a, b: text[a:b],
        size=len,
        kept=lambda text, keep: np.frombuffer(text, np.uint8)[keep].tobytes(),
        repeated=_repeated(length),
        per_shard=16 << 20,
    )


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of `docs` (doc_id, text), a UTF-8 text.

    A byte is removed if a string of `length` bytes that covers it also starts in a document with a smaller id. Suffixes are ordered
    through `length` bytes only, and groups still together then are the repeated strings. Only suffixes near an anchor gram that two
    documents share are sorted (see `windows`); each other one is alone in the first pass already. Null texts are empty, and null ids count as
    the largest; rows with one id do not repeat each other.
    """
    return remove_repeats(docs, byte_tokens(length, length // 2)).withColumnRenamed("n_tokens", "n_bytes")
