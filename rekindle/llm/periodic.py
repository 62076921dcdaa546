"""Periodic runs of words, found in the grammar that repeated pairing makes of each text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 24
MIN_PERIODS = 3
#: Words whose texts go through the steps together, at least one text.
BATCH_WORDS = 200_000
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20

RUNS = "array<struct<start:long,length:long,period:long>>"


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text (stretches without ASCII white space), a bounded stretch at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end].split()
        at = end


def word_ids(text: bytes) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict[bytes, int] = {}
    parts = []
    for words in word_pieces(text):
        for w in dict.fromkeys(words):
            known.setdefault(w, len(known))
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


@dataclass
class Grammar:
    """Rules and what is left of the texts.

    Symbols from `first` on are rules: rule k makes `left[k]` and `right[k]`, is `length[k]` words long and stands at word `place[k]`, among others.
    `symbols` and `places` are the final sequences of all texts, `text` the text of each symbol.
    """

    first: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    place: np.ndarray
    symbols: np.ndarray
    places: np.ndarray
    text: np.ndarray


def pair_up(words: np.ndarray, text: np.ndarray) -> Grammar:
    """Re-Pair of texts whose words share no symbol, in rounds.

    A round counts all pairs of neighbours and replaces each occurrence that is more frequent than the pairs it overlaps, the most frequent pair everywhere
    (in a stretch of one symbol every second pair), until no pair is there twice. Only pairs that were repeated before, or
    hold a new symbol, can be repeated, so a round sorts no others.
    """
    first = nxt = int(words.max(initial=-1)) + 1
    symbols, places = words, np.arange(len(words))
    lengths = np.ones(first, np.int64)  # of all symbols
    left, right, place = [], [], []
    live = np.ones(max(0, len(symbols) - 1), bool)  # whether the pair at i and i + 1 can be repeated
    live &= text[1:] == text[:-1]
    while live.any():
        at = np.flatnonzero(live)
        code = symbols[at] * nxt + symbols[at + 1]
        _, pair, count = np.unique(code, return_inverse=True, return_counts=True)
        keep = count[pair] > 1
        live[at[~keep]] = False
        at, pair = at[keep], pair[keep]
        if not len(at):
            break
        by_count = np.empty(len(count), np.int64)
        by_count[np.lexsort((-np.arange(len(count)), count))] = np.arange(1, len(count) + 1)
        rank = np.zeros(len(symbols) + 1, np.int64)  # of the pair at i - 1, one place off so that both ends have a neighbour
        rank[at + 1] = by_count[pair]
        own, before, after = rank[at + 1], rank[at], rank[at + 2]
        opens = before != own  # else the pair before is the same: a stretch of one symbol
        start = np.maximum.accumulate(np.where(opens, at, 0))
        chosen = (before <= own) & (after <= own) & ((at - start) % 2 == 0)
        hit = at[chosen]
        made, where, which = np.unique(pair[chosen], return_index=True, return_inverse=True)
        left.append(symbols[hit[where]])
        right.append(symbols[hit[where] + 1])
        place.append(places[hit[where]])
        lengths = np.concatenate([lengths, lengths[left[-1]] + lengths[right[-1]]])
        symbols = symbols.copy()
        symbols[hit] = nxt + which
        nxt += len(made)
        rest = np.ones(len(symbols), bool)
        rest[hit + 1] = False
        fresh = np.zeros(len(symbols), bool)
        fresh[hit] = True
        live = np.concatenate([live, [False]])[rest][:-1]
        symbols, places, fresh = symbols[rest], places[rest], fresh[rest]
        joined = text[places[1:]] == text[places[:-1]]
        live = (live | fresh[1:] | fresh[:-1]) & joined
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Grammar(first, join(left), join(right), lengths[first:], join(place), symbols, places, text[places])


def boundaries(grammar: Grammar, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, middle, end) in words: a rule at its place, and the nodes of a balanced tree over each text's final sequence.

    The node at the j-th symbol of a text reaches as many symbols to either side as the largest power of two that divides j.
    """
    k = np.arange(len(grammar.left))
    left_length = np.where(grammar.left < grammar.first, 1, grammar.length[np.maximum(grammar.left - grammar.first, 0)] if len(k) else 1)
    rules = (grammar.place, grammar.place + left_length, grammar.place + grammar.length)
    m = len(grammar.symbols)
    new = np.flatnonzero(np.concatenate(([True], grammar.text[1:] != grammar.text[:-1]))) if m else np.zeros(0, np.int64)
    size = np.diff(np.append(new, m))
    opening, final = np.repeat(new, size), np.repeat(new + size, size)
    j = np.arange(m) - opening
    inner = np.flatnonzero(j > 0)
    reach = j & -j
    edge = np.append(grammar.places, n_words)
    tree = (edge[inner - reach[inner]], edge[inner], edge[np.minimum(inner + reach[inner], final[inner])])
    return tuple(np.concatenate(pair) for pair in zip(rules, tree))


class Matcher:
    """Longest common extensions of two places of one sequence, by hashes of two primes.

    Equal stretches always have equal hashes, so an extension is never too short; callers make sure that it isn't too long either.
    """

    PRIMES = (2_147_483_647, 2_147_483_629)

    def __init__(self, words: np.ndarray, seed: int = 0):
        self.size = len(words)
        rng = np.random.default_rng(seed)
        self.parts = []
        for p in self.PRIMES:
            base = int(rng.integers(1 << 20, p - 1))
            power = np.ones(1, np.uint64)
            while len(power) <= self.size:
                power = np.concatenate([power, power * np.uint64(pow(base, len(power), p)) % np.uint64(p)])
            value = rng.integers(1, p, int(words.max(initial=0)) + 1).astype(np.uint64)[words]
            total = np.concatenate([[np.uint64(0)], np.cumsum(value * power[: self.size] % np.uint64(p), dtype=np.uint64) % np.uint64(p)])
            self.parts.append((np.uint64(p), power, total))

    def _same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for p, power, total in self.parts:
            out &= (total[a + n] + p - total[a]) % p * power[b - a] % p == (total[b + n] + p - total[b]) % p
        return out

    def extend(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words agree from a and b (a < b) on, or before a and b, at most `most`."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) // 2
            off = mid if back else 0
            ok = self._same(a[open_] - off, b[open_] - off, mid)
            low[open_[ok]] = mid[ok]
            high[open_[~ok]] = mid[~ok] - 1
        return low


def _grams(words: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """A number for each window of `size` words (the last ones of a text have their own), equal for equal windows of one text."""
    n, name = len(words), words
    width = 1
    while width < size:
        step = min(width, size - width)
        nxt = np.append(name[step:], np.zeros(step, np.int64))[:n]
        inside = np.arange(n) + width + step <= n
        inside[inside] &= text[np.flatnonzero(inside) + width + step - 1] == text[inside]
        top = int(name.max(initial=0)) + 1
        code = np.where(inside, name * top + nxt, -1 - np.arange(n))
        _, name = np.unique(code, return_inverse=True)
        width += step
    return name


def _candidates(gram: np.ndarray, size: int, begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, period) such that the window at a node's middle has an equal one a period further on, or the one that ends behind it a period earlier.

    A run over a middle has half of its length on one side of it, so 1.5 periods and half of the shortest length L. From the word before the middle on
    (or back from the word behind it) max(L / 2, 1.5 q) - q + 1 words then agree with those a period away: never fewer than L / 6 + 1.
    """
    n = len(gram)
    order = np.lexsort((np.arange(n), gram))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    key = gram[order] * (n + 1) + order  # ascending
    nodes, periods = [], []
    for ahead in (True, False):
        at = middle - 1 if ahead else middle - size + 1
        node = np.flatnonzero((at >= begin) & (at + size <= end))
        if ahead:
            far = np.searchsorted(key, gram[at[node]] * (n + 1) + end[node] - size + 1) if n else node
            first = rank[at[node]] + 1
        else:
            first = np.searchsorted(key, gram[at[node]] * (n + 1) + begin[node]) if n else node
            far = rank[at[node]]
        many = np.maximum(far - first, 0)
        some = np.flatnonzero(many)
        node, first, many = node[some], first[some], many[some]
        own = np.repeat(node, many)
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        other = order[np.repeat(first, many) + step]
        q = np.abs(other - at[own])
        room = (end - middle)[own] if ahead else (middle - begin)[own]
        fits = 2 * room >= 3 * q
        nodes.append(own[fits])
        periods.append(q[fits])
    both = np.unique(np.concatenate(nodes) * (n + 1) + np.concatenate(periods))
    return both // (n + 1), both % (n + 1)


def _crossing(matcher: Matcher, which: np.ndarray, q: np.ndarray, node: tuple[np.ndarray, ...], min_length: int) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the stretches of three periods and `min_length` words over a node's middle, as far as the node shows them."""
    begin, middle, end = node
    out = []
    for ahead in (True, False):  # a period ahead of the word before the middle, or behind the word after it
        b = middle[which] - 1 + q if ahead else middle[which]
        a = b - q
        ok = (a >= begin[which]) & (b < end[which])
        k, a, b, period = which[ok], a[ok], b[ok], q[ok]
        on = matcher.extend(a, b, end[k] - b, False)
        back = matcher.extend(a, b, a - begin[k], True)
        start, stop = a - back, b + on
        long = (on > 0) & (stop - start >= np.maximum(min_length, MIN_PERIODS * period))
        out.append(np.stack([k[long], start[long], stop[long], period[long]]))
    found = np.concatenate(out, axis=1)
    found = found[:, np.lexsort((found[3], found[2], found[1], found[0]))]
    same = (found[:3, 1:] == found[:3, :-1]).all(axis=0) if found.shape[1] else np.zeros(0, bool)
    return tuple(found[:, np.concatenate(([True], ~same))[: found.shape[1]]])  # of equal stretches the smallest period: the others are its multiples


def _translated(grammar: Grammar, rule: np.ndarray, offset: np.ndarray, stop: np.ndarray, period: np.ndarray) -> Iterator[np.ndarray]:
    """The stretches (offset, stop, period) of rules at all places of the derivation, as rows of start, end, period. Rules that lead to none aren't opened."""
    n = len(grammar.left)
    order = np.argsort(rule, kind="stable")
    rule, offset, stop, period = rule[order], offset[order], stop[order], period[order]
    begin, far = np.searchsorted(rule, np.arange(n)), np.searchsorted(rule, np.arange(n), "right")
    leads = np.zeros(n + grammar.first, bool)
    leads[grammar.first + rule] = True
    if len(rule):
        own = leads.tolist()
        for k, (a, b) in enumerate(zip(grammar.left.tolist(), grammar.right.tolist()), grammar.first):  # a rule's parts come before it
            own[k] = own[k] or own[a] or own[b]
        leads = np.array(own)
    at = leads[grammar.symbols]
    symbols, places = grammar.symbols[at], grammar.places[at]
    while len(symbols):
        own = symbols - grammar.first
        many = far[own] - begin[own]
        row = np.repeat(begin[own], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        base = np.repeat(places, many)
        yield np.stack([base + offset[row], base + stop[row], period[row]])
        first, second = grammar.left[own], grammar.right[own]
        step = np.where(first < grammar.first, 1, grammar.length[np.maximum(first - grammar.first, 0)])
        symbols, places = np.concatenate([first, second]), np.concatenate([places, places + step])
        at = leads[symbols]
        symbols, places = symbols[at], places[at]


def _merged(found: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The maximal ones of the stretches of each period, and of equal stretches the smallest period; ordered by start, then period."""
    start, end, period = found
    order = np.lexsort((-end, start, period, text[start]))
    start, end, period = start[order], end[order], period[order]
    group = np.concatenate(([True], (period[1:] != period[:-1]) | (text[start[1:]] != text[start[:-1]])))[: len(start)]
    base = (np.cumsum(group) - 1) * (len(text) + 1)  # so that a running maximum starts anew in each group
    reach = np.maximum.accumulate(base + end) if len(start) else base
    inside = np.concatenate(([False], ~group[1:] & (base[1:] + end[1:] <= reach[:-1])))[: len(start)]
    start, end, period = start[~inside], end[~inside], period[~inside]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))[: len(start)]
    out = np.stack([start[least], end[least], period[least]])
    return out[:, np.lexsort((out[2], out[0]))]


def runs_of(texts: list[np.ndarray], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """Runs of each sequence of word numbers: rows of start, length and smallest period, by start, then period.

    Each rule of the grammar, and each node of the trees over what is left, is looked at once, for the runs that cross the middle between its two
    parts. A run lies across the middle of the smallest rule or node that holds it, and is found there whole. What rules hold is carried to all
    places that derive from them, and stretches inside a longer one of the same period go.
    """
    size = min_length // 6 + 1  # 5 for 24: see _candidates
    lengths = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), lengths)
    if not len(text):
        return [np.zeros((3, 0), np.int64) for _ in texts]
    top = np.array([int(t.max(initial=-1)) + 1 for t in texts], np.int64)
    words = np.concatenate(texts) + np.repeat(np.cumsum(top) - top, lengths)
    grammar = pair_up(words, text)
    node = boundaries(grammar, len(words))
    which, q = _candidates(_grams(words, text, size), size, *node)
    for seed in range(8):
        k, start, end, period = _crossing(Matcher(words, seed), which, q, node, min_length) if len(which) else np.zeros((4, 0), np.int64)
        rules = k < len(grammar.left)
        place = grammar.place[k[rules]]
        carried = _translated(grammar, k[rules], start[rules] - place, end[rules] - place, period[rules])
        found = _merged(np.concatenate([np.stack([start[~rules], end[~rules], period[~rules]]), *carried], axis=1), text)
        if all(np.array_equal(words[s : e - q], words[s + q : e]) for s, e, q in found.T):  # else two hashes clashed, and others are tried
            break
    else:
        raise RuntimeError("hashes of word stretches clash with every seed")
    base = np.cumsum(lengths) - lengths
    cut = np.searchsorted(text[found[0]], np.arange(len(texts) + 1))
    return [np.stack([s - base[i], e - s, q]) for i in range(len(texts)) for s, e, q in [found[:, cut[i] : cut[i + 1]]]]


def _collapsed(text: bytes, runs: np.ndarray) -> bytes:
    """The words of a text, joined by one space, without what a run holds after its first period."""
    starts, lengths, periods = runs
    drop_from, drop_to = starts + periods, starts + lengths
    order = np.argsort(drop_from, kind="stable")
    drop_from, reach = drop_from[order], np.maximum.accumulate(drop_to[order]) if len(order) else drop_to
    parts, at = [], 0
    for words in word_pieces(text):
        if len(starts):
            i = np.arange(at, at + len(words))
            before = np.searchsorted(drop_from, i, "right") - 1
            gone = (before >= 0) & (i < reach[before])
            at += len(words)
            words = [w for w, g in zip(words, gone.tolist()) if not g]
        if words:
            parts.append(b" ".join(words))
    return b" ".join(parts)


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """`docs` (doc_id, text) with runs and the collapsed text in place of the text; other columns are not read.

    A run is a stretch of words with smallest period q, of at least three periods and `min_length` words, that no neighbouring word extends; runs
    holds start, length and period of each, in words from 0, by start, then period. The collapsed text holds the words, joined by one space, that no run
    holds after its first q words. Null and blank texts have no runs and collapse to empty ones; rows of null or repeated ids are judged one by one.
    A text is one task's, at some 300 bytes of memory for each of its words; nothing is shuffled.
    """
    if min_length < 6:
        raise ValueError("runs of fewer than 6 words give no window to search by")

    def judged(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        found = runs_of([word_ids(t) for t in texts], min_length)
        fields = [pa.array(np.concatenate([f[k] for f in found])) for k in range(3)]
        listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(f.shape[1] for f in found)]), pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
        text = pa.array([_collapsed(t, f).decode() for t, f in zip(texts, found)], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), listed, text], names=["doc_id", "runs", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                texts.append((text.as_py() or "").encode())
                size += len(texts[-1])
                if size >= 6 * BATCH_WORDS:
                    yield judged(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield judged(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, runs {RUNS}, text string")
