"""Removal of repeated word sequences with suffix automata of reference shards."""

from __future__ import annotations

from array import array
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from rekindle.llm.windows import Tokens, remove_repeats

LENGTH = 50
GRAM = 25
#: Corpus text that a reference shard stands for, about.
SHARD_BYTES = 1 << 20
#: Word hashes that a worker remembers.
MEMO_WORDS = 500_000


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = array("q", [-1]), array("q", [0])

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, symbol, target: int) -> int:
        """The state for the longest string of `state` and the symbol, taken out of `target`."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def add(self, sequence) -> None:
        at = 0
        for symbol in sequence:
            known = self.next[at].get(symbol)
            if known is not None:
                at = self._split(at, symbol, known)
                continue
            new, state = self._state(self.length[at] + 1, {}, 0), at
            while state >= 0 and symbol not in self.next[state]:
                self.next[state][symbol] = new
                state = self.link[state]
            if state >= 0:
                self.link[new] = self._split(state, symbol, self.next[state][symbol])
            at = new

    def matching_statistics(self, sequence) -> list[int]:
        """For each place the length of the longest string that ends there and is a substring here."""
        out, at, size = [], 0, 0
        for symbol in sequence:
            while at and symbol not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            step = self.next[at].get(symbol)
            if step is not None:
                at, size = step, size + 1
            out.append(size)
        return out


def _repeated(length: int):
    def run(contexts: list[bytes], ids: list[int]) -> list[np.ndarray]:
        """Windows of each context that end where at least `length` words match a smaller id.

        The shard's contexts are its reference texts. They come in the order of ids: those of one id are streamed through the automaton of all smaller
        ids and then join it, so it never knows a later document.
        """
        out: list = [None] * len(contexts)
        automaton = SuffixAutomaton()
        for _, same in groupby(sorted(range(len(contexts)), key=ids.__getitem__), key=ids.__getitem__):
            own = {k: contexts[k].split(b" ") for k in same}
            for k, words in own.items():
                out[k] = np.array(automaton.matching_statistics(words)[length - 1 :]) >= length
            for words in own.values():
                automaton.add(words)
        return out

    return run


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def word_tokens(length: int = LENGTH, gram: int = GRAM) -> Tokens:
    return Tokens(
        length,
        gram,
        split=bytes.split,  # at ASCII white space only
        values=lambda words: np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)),
        piece=lambda words, a, b: b" ".join(words[a:b]),
        size=lambda piece: piece.count(b" ") + 1,
        kept=lambda words, keep: b" ".join(w for w, k in zip(words, keep.tolist()) if k),
        repeated=_repeated(length),
        per_shard=SHARD_BYTES,
    )


def remove_repeated_words(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256) of each row of `docs` (doc_id, text).

    Words stand between ASCII white space and are compared as they are. A word is removed if a window of `length` words that covers it also starts in a document
    with a smaller id. Whole automata of the corpus would have to meet every document; here reference shards are cut by
    content. All stretches with one anchor gram (see `windows`) are in one shard, a suffix automaton over them stays in its task, and only
    documents that have such a gram are streamed through it. Each shard stands for about SHARD_BYTES of the corpus,
    whatever its size, and copies of a stretch count once. n_spans counts maximal removed runs; the kept words are joined by one space. Null texts
    have no words, and null ids count as the largest; rows with one id do not repeat each other.
    """
    return remove_repeats(docs, word_tokens(length, length // 2)).withColumnRenamed("n_tokens", "n_words")
