"""A hierarchical Pitman-Yor language model, sampled over blocks of word pairs.

Every word has a context restaurant of its own, which serves the words that follow it, and all share the unigram restaurant as their
parent, whose own base is uniform over the known words and one unknown. Words are told apart by 64-bit hashes.

A dish is a pair of words. Pairs lie in the blocks of a grid: the row by the hash of the context, the column by that of the word, so that neither a frequent
context nor a frequent word stands in one block. What a block needs of the others, the totals of its contexts and words, is summed for each
of them elsewhere and comes back in the order in which the block sent its own part; it grows with the words of the corpus, and nothing of it goes through the driver.

A round of the Gibbs sampler lifts all customers of a dish out of their restaurant and seats them anew by the Chinese-restaurant rule, given everyone else, some
sweeps over; blocks sweep side by side and exchange their numbers of tables after each round. With the totals of a word its tables, which are the parent's customers, are seated likewise.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekindle.llm.store import Scratch, cut
from rekindle.session import freed_shuffles

#: Contexts of a block in tests. Blocks number their own contexts, however many they have.
CONTEXTS = 4096
#: Rounds thrown away and rounds whose predictive probabilities are averaged; sweeps in a round.
BURN_IN = 1
SAMPLES = 2
SWEEPS = 2
#: Concentrations of the context restaurants and of the parent.
CONCENTRATION = 10.0
ROOT_CONCENTRATION = 10.0
#: Tokens that a task takes together; bytes of text behind a shard, about; and the same for small corpora, which get up to SMALL_SHARDS.
BATCH_TOKENS = 900_000
PER_SHARD = 16 << 20
PER_SMALL_SHARD = 1 << 20
SMALL_SHARDS = 48
#: Pairs of words with more than one in HOT training tokens, so fewer than HOT pairs, are scored from a table that every task has.
HOT = 1_000
#: Customers seated one by one before the sampler leaps from new table to new table.
SINGLY = 8

END, START = b"", b"\n"  # neither is a word


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def seat(customers: np.ndarray, strength: np.ndarray, discount: float, base: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers came one by one.

    With i customers at t tables of the dish, the next one opens a table with the odds (strength + discount * t) * base : i - discount * t. Behind the first few
    customers the next opening is drawn at once from the chance that none happens up to it, a ratio of gamma functions, so a
    dish costs as many steps as it gets tables.
    """
    t = np.ones(len(customers))
    for i in range(1, SINGLY):
        on = np.flatnonzero(customers > i)
        a = (strength[on] + discount * t[on]) * base[on]
        t[on] += rng.random(len(on)) * (a + i - discount * t[on]) < a
    on, i = np.flatnonzero(customers > SINGLY), None
    i = np.full(len(on), float(SINGLY))
    while len(on):
        a = (strength[on] + discount * t[on]) * base[on]
        shift = (a - 1) / 2 - discount * t[on]
        with np.errstate(over="ignore"):
            opens = np.maximum(np.ceil((i + shift) * (1 - rng.random(len(on))) ** (-1 / a) - shift) - 1, i)
        more = opens < customers[on]
        on, i = on[more], opens[more] + 1
        t[on] += 1
    return t


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Batches:
    """Tokens of documents as numbers of the batch's own words."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.number = _Numbers({END: 0, START: 1})
        self.parts: list[np.ndarray] = []
        self.ids: list = []
        self.size = 0

    def add(self, doc_id, text) -> None:
        words = tokens(text)
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.ids.append(doc_id)
        self.size += len(words)

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[_Batches]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                self.add(doc_id, text.as_py())
                if self.size >= BATCH_TOKENS:
                    yield self
                    self.clear()
        if self.ids:
            yield self

    def arrays(self):
        """Hash of each word; word, previous word and document of each token."""
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.number], np.uint64)
        word = np.concatenate(self.parts).astype(np.int64)
        sizes = np.array([len(p) for p in self.parts])
        before = np.concatenate(([1], word[:-1]))
        before[np.cumsum(sizes)[:-1]] = 1
        return hashes, word, before, np.repeat(np.arange(len(sizes)), sizes)


def _blob(values, kind) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def _kind(n: int):
    """For numbers below n."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def _small(values: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs."""
    return _blob(values, np.min_scalar_type(int(values.max(initial=0))))


def _ints(blob: bytes, n: int) -> np.ndarray:
    """n numbers, in any number of bytes each."""
    return np.frombuffer(blob, f"u{len(blob) // n}" if n else np.uint8)


def _table(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows))


def _dealt(place: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each of n places that occurs, with the numbers of its entries in their order."""
    place = place.astype(_kind(n))  # 16 bits are sorted digit by digit
    order = np.argsort(place, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=n))))
    for k in np.flatnonzero(np.diff(ends)):
        yield int(k), order[ends[k] : ends[k + 1]]


PAIRS = "block long, names binary, followers binary, words binary, word binary, counts binary"


def _send_pairs(side: int):
    """To each block: the pairs of a batch and how often each occurs in training; pairs of held-out texts alone have a zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _Batches().read(batches):
            hashes, word, before, doc = batch.arrays()
            held, line = np.array([held_out(i) for i in batch.ids]), (hashes % np.uint64(side)).astype(np.int64)
            key, times = np.unique((before * len(hashes) + word) * 2 + held[doc], return_counts=True)
            first = np.flatnonzero(np.concatenate(([True], np.diff(key >> 1) > 0)))
            count, pair = np.add.reduceat(np.where(key & 1, 0, times), first), key[first] >> 1
            context, word = pair // len(hashes), pair % len(hashes)
            out = {c: [] for c in ("block", "names", "followers", "words", "word", "counts")}
            for block, own in _dealt(line[context] * side + line[word], side * side):
                names, followers = np.unique(context[own], return_counts=True)
                words, which = np.unique(word[own], return_inverse=True)
                for c, x in zip(out, (block, _blob(hashes[names], np.uint64), _blob(followers, np.uint32), _blob(hashes[words], np.uint64), _blob(which, _kind(len(words))), _blob(count[own], np.uint32))):
                    out[c].append(x)
            yield _table({c: (x, pa.int64() if c == "block" else pa.binary()) for c, x in out.items()})

    return run


#: What stays of a block; what a round leaves of it, and its own part of the totals, one row for each owner, of which a stored row has one; what stays of an owner.
BLOCK = "block long, names binary, words binary, dishes binary, contexts binary, counts binary, few array<long>, most long, key_bytes long"
ROUND = "block long, tables array<binary>, customers binary, word_customers binary, by_context array<binary>, by_word array<binary>, roots array<binary>"
PARTS = "block long, owner long, hashes binary, own_customers binary, own_tables binary, own_dishes binary, own_roots binary, own_few array<long>"
OWNER = "owner long, senders array<long>, sizes array<long>, which binary"
_ARROW = {"long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _both(a: str, b: str) -> str:
    """The columns of both, each once."""
    return ", ".join(dict.fromkeys([*a.split(", "), *b.split(", ")]))


def _filled(schema: str, rows: list[dict]) -> pa.Table:
    """Rows with the columns that they have, the others null."""
    return pa.table({c: pa.array([r.get(c) for r in rows], _ARROW[kind]) for c, kind in (x.split() for x in schema.split(", "))})


def _joined(rows: list[dict], column: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[column], kind) for r in rows])


def _open_block(key, sent):
    """All dishes of a block, word by word."""
    rows = sent.to_pylist()
    names, name_at = np.unique(_joined(rows, "names", np.uint64), return_inverse=True)
    words, word_at = np.unique(_joined(rows, "words", np.uint64), return_inverse=True)
    context = name_at[np.repeat(np.arange(len(name_at)), _joined(rows, "followers", np.uint32))]
    own = [len(r["words"]) // 8 for r in rows]
    word = word_at[np.concatenate([np.frombuffer(r["word"], _kind(n)).astype(np.int64) + at for r, n, at in zip(rows, own, np.cumsum(own) - own)])]
    pair, place = np.unique(word * len(names) + context, return_inverse=True)
    counts = np.bincount(place, _joined(rows, "counts", np.uint32).astype(float)).astype(np.int64)
    row = {
        "block": key[0].as_py(), "names": _blob(names, np.uint64), "words": _blob(words, np.uint64), "dishes": _small(np.bincount(pair // len(names), minlength=len(words))),
        "contexts": _small(pair % len(names)), "counts": _small(counts), "few": [int((counts == n).sum()) for n in (1, 2)], "most": int(counts.max()),
    }
    keys = np.sort(_pair_keys(names[pair % len(names)], words[pair // len(names)]))
    row["key_bytes"] = next((n for n in range(1, 8) if (np.diff(_leading(keys, n)) > 0).all()), 8)
    return _filled(BLOCK, [row])


class _Block:
    """A block's dishes as arrays."""

    def __init__(self, row: dict):
        self.number, self.few = row["block"], row["few"]
        self.names, self.words = np.frombuffer(row["names"], np.uint64), np.frombuffer(row["words"], np.uint64)
        dishes = _ints(row["dishes"], len(self.words))
        self.word = np.repeat(np.arange(len(dishes)), dishes)
        self.context, self.counts = (_ints(row[c], len(self.word)).astype(np.int64) for c in ("contexts", "counts"))

    def by_name(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, values, len(self.names))

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, values, len(self.words))


def _part_of(hashes: np.ndarray, side: int) -> np.ndarray:
    return (hashes // np.uint64(side) % np.uint64(side)).astype(np.int64)


def _parts(b: _Block, side: int, tables: np.ndarray | None = None, roots: np.ndarray | None = None) -> Iterator[dict]:
    """A block's part of the totals of its contexts, then of its words, to whoever sums them. A line of the grid is dealt to as many owners as it has blocks.

    Without `tables`, before the first round, dishes have one each.
    """
    first, few = tables is None, b.few
    tables = (b.counts > 0).astype(float) if first else tables
    for line, hashes, by in ((b.number // side, b.names, b.by_name), (side + b.number % side, b.words, b.by_word)):
        own_tables, customers, dishes = by(tables), by(b.counts) if first else None, by(b.counts > 0) if line >= side else None
        for part, own in _dealt(_part_of(hashes, side), side):
            of = lambda x, own=own: None if x is None else _small(x[own])
            row = {"block": b.number, "owner": line * side + part, "own_tables": of(own_tables)}
            if first:
                yield row | {"hashes": _blob(hashes[own], np.uint64), "own_customers": of(customers), "own_dishes": of(dishes), "own_few": few if line >= side else None}
                few = None if line >= side else few
            else:
                yield row | {"own_roots": of(roots) if line >= side else None}


def _first_parts(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield from _filled(PARTS, [*_parts(_Block(row), side)]).to_batches()

    return run


TOTALS = "block long, owner long, all_customers binary, all_tables binary, all_roots binary, sums array<double>"


def _replies(owner: int, senders, sizes, which: np.ndarray, sums: list, **totals) -> list[dict]:
    """The totals to each sender in its own order."""
    out = []
    for block, at in zip(senders, np.split(which, np.cumsum(sizes)[:-1])):
        out.append({"block": block, "owner": owner} | {f"all_{c}": None if x is None else _small(x[at]) for c, x in totals.items()})
    out[0]["sums"] = [float(x) for x in sums]
    return out


def _joined_ints(rows: list[dict], column: str, sizes) -> np.ndarray:
    return np.concatenate([_ints(r[column], n).astype(float) for r, n in zip(rows, sizes)])


def _first_total(side: int):
    """Totals of an owner's contexts or words over all blocks; its numbers for what each block sent stay, so that hashes move once. Each word has one table in the parent."""

    def run(key, sent):
        owner, rows = key[0].as_py(), sorted(sent.to_pylist(), key=lambda r: r["block"])
        _, which = np.unique(_joined(rows, "hashes", np.uint64), return_inverse=True)
        sizes = [len(r["hashes"]) // 8 for r in rows]
        add = lambda c: np.bincount(which, _joined_ints(rows, c, sizes))
        customers, tables, roots, sums = add("own_customers"), add("own_tables"), None, [0] * 8
        if owner >= side * side:
            dishes, roots = add("own_dishes"), np.minimum(tables, 1)
            sums = [customers.sum(), roots.sum(), tables.sum(), roots.sum(), *np.sum([r["own_few"] or [0, 0] for r in rows], 0), (dishes == 1).sum(), (dishes == 2).sum()]
        senders = [r["block"] for r in rows]
        own = {"owner": owner, "senders": senders, "sizes": sizes, "which": _blob(which, np.uint32)}
        return _filled(_both(TOTALS, OWNER), [own, *_replies(owner, senders, sizes, which, sums, customers=customers, tables=tables, roots=roots)])

    return run


def _total(shared: Shared, number: int, seed: int, side: int):
    """Totals of an owner's contexts or words after a round. The tables of a word are seated in the parent."""

    def run(own, sent):
        own, rows = own.to_pylist()[0], sorted(sent.to_pylist(), key=lambda r: r["block"])
        owner, senders, sizes, which = own["owner"], own["senders"], own["sizes"], np.frombuffer(own["which"], np.uint32)
        if [r["block"] for r in rows] != senders:
            raise ValueError("the blocks of this round are not those of the first")
        tables, roots, sums = np.bincount(which, _joined_ints(rows, "own_tables", sizes)), None, [0] * 4
        if owner >= side * side:
            k, on = np.zeros(len(tables)), np.flatnonzero(tables)
            k[which] = _joined_ints(rows, "own_roots", sizes)
            roots, strength = np.zeros(len(tables)), ROOT_CONCENTRATION + shared.root_discount * (shared.root_tables - k[on])
            rng = np.random.default_rng((seed, number, 1, owner))
            roots[on] = seat(tables[on], strength, shared.root_discount, np.full(len(on), 1 / (shared.vocabulary + 1)), rng)
            sums = [0, len(on), tables.sum(), roots.sum()]
        return _filled(TOTALS, _replies(owner, senders, sizes, which, sums, tables=tables, roots=roots))

    return run


class _Around:
    """What a block knows of the others, in its own order: the totals that came back, and what earlier rounds left."""

    def __init__(self, b: _Block, rows: list[dict], side: int):
        replies = [r for r in rows if r["owner"] is not None]
        words, names = ({r["owner"] % side: r for r in replies if (r["owner"] >= side * side) == w} for w in (True, False))
        by_name, by_word = ([*_dealt(_part_of(x, side), side)] for x in (b.names, b.words))

        def get(column: str, replies: dict, parts: list, n: int) -> np.ndarray:
            out = np.zeros(n, np.int64)
            for part, own in parts:
                out[own] = _ints(replies[part][column], len(own))
            return out

        old = next((r for r in rows if r["owner"] is None), None)
        n, n_words = len(b.names), len(b.words)
        self.customers = get("all_customers", names, by_name, n) if old is None else _ints(old["customers"], n).astype(np.int64)
        self.word_customers = get("all_customers", words, by_word, n_words) if old is None else _ints(old["word_customers"], n_words).astype(np.int64)
        now = {"by_context": get("all_tables", names, by_name, n), "by_word": get("all_tables", words, by_word, n_words), "roots": get("all_roots", words, by_word, n_words)}
        #: Of each sample kept, the last one now.
        self.by_context, self.by_word, self.roots = ([*(_ints(x, len(v)).astype(np.int64) for x in (old[c] if old else ())), v] for c, v in now.items())
        self.tables = [_ints(x, len(b.word)).astype(np.int64) for x in old["tables"]] if old else [(b.counts > 0).astype(np.int64)]


@dataclass
class Shared:
    """What a block knows of a sample: customers and tables of its contexts, and a few sums over the corpus."""

    customers: np.ndarray | None
    tables: np.ndarray | None
    root_customers: float
    root_tables: float
    vocabulary: int
    discount: float = 0.5
    root_discount: float = 0.5

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's predictive probability of words with so many customers and tables there."""
        rest = (ROOT_CONCENTRATION + self.root_discount * self.root_tables) / (self.vocabulary + 1)
        return (customers - self.root_discount * tables + rest) / (ROOT_CONCENTRATION + self.root_customers)

    def fresh(self) -> np.ndarray:
        """For each context the share that it leaves to the parent."""
        return (CONCENTRATION + self.discount * self.tables) / (CONCENTRATION + self.customers)


def _sweep(shared: Shared, number: int, seed: int, side: int):
    """A round of sweeps over one block; the last SAMPLES tables stay with it, with what it knew at those before the last."""

    def run(block, rest):
        b = _Block(block.to_pylist()[0])
        around = _Around(b, rest.to_pylist(), side)
        rng = np.random.default_rng((seed, number, 0, b.number))
        on = np.flatnonzero(b.counts)
        context, word, counts, t = b.context[on], b.word[on], b.counts[on], around.tables[-1][on].astype(float)
        total, of_word, roots = around.by_context[-1].astype(float), around.by_word[-1].astype(float), around.roots[-1]
        for _ in range(SWEEPS):
            base = shared.root(of_word, np.minimum(roots, of_word))
            new = seat(counts, CONCENTRATION + shared.discount * np.maximum(total[context] - t, 0), shared.discount, base[word], rng)
            total += np.bincount(context, new - t, len(total))
            of_word += np.bincount(word, new - t, len(of_word))
            t = new
        tables = np.zeros(len(b.counts))
        tables[on] = t
        row = {"block": b.number, "customers": _small(around.customers), "word_customers": _small(around.word_customers), "tables": [_small(x) for x in [*around.tables, tables][-SAMPLES:]]}
        row |= {c: [_small(x) for x in getattr(around, c)[-max(1, SAMPLES - 1) :]] for c in ("by_context", "by_word", "roots")}
        return _filled(_both(ROUND, PARTS), [row, *_parts(b, side, tables, roots)])

    return run


def _shared(replies: DataFrame, first: Shared | None = None) -> tuple[float, Shared]:
    """Training tokens, if these are the first replies, and the sums of a sample. Discounts come from the dishes, so they stay."""
    rows = replies.where("sums IS NOT NULL").select(*[F.sum(F.get("sums", F.lit(i))).alias(f"x{i}") for i in range(8)]).first()
    n, vocabulary, customers, tables, ones, twos, root_ones, root_twos = (x or 0.0 for x in rows)
    if first is not None:
        return n, replace(first, root_customers=customers, root_tables=tables)
    discount = lambda a, b: float(np.clip(a / (a + 2 * b), 0.1, 0.9)) if a + b else 0.5
    return n, Shared(None, None, customers, tables, int(vocabulary), discount(ones, twos), discount(root_ones, root_twos))


class _Model:
    """Averaged predictive probabilities of a block's words."""

    def __init__(self, row: dict, samples: list[Shared], word_tables: list[np.ndarray] | None = None):
        """`word_tables`: for each sample the tables of the words in all blocks, if there are others."""
        self.samples, self.n_contexts = samples, len(samples[0].customers)
        dishes = _ints(row["dishes"], len(row["words"]) // 8)
        word = np.repeat(np.arange(len(dishes)), dishes)
        context, counts = (_ints(row[c], len(word)).astype(np.int64) for c in ("contexts", "counts"))
        self.pairs = word * self.n_contexts + context  # in order
        self.own, self.root = np.zeros(len(word)), []
        for i, (s, tables, roots) in enumerate(zip(samples, row["tables"], row["roots"])):
            t = _ints(tables, len(word)).astype(float)
            self.own += (counts - s.discount * t) / (CONCENTRATION + s.customers[context]) / len(samples)
            # The last place is that of words which training did not have.
            of_word = np.bincount(word, t, len(dishes)) if word_tables is None else word_tables[i]
            self.root.append(np.append(s.root(of_word, _ints(roots, len(dishes)).astype(float)), s.root(np.zeros(1), np.zeros(1))))
        self.fresh = [s.fresh() for s in samples]

    def log10(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        pair = word * self.n_contexts + context
        at = np.searchsorted(self.pairs, pair)
        seen = at < len(self.pairs)
        seen[seen] = self.pairs[at[seen]] == pair[seen]
        p = np.zeros(len(word))
        p[seen] = self.own[at[seen]]
        for root, fresh in zip(self.root, self.fresh):
            p += fresh[context] * root[word] / len(self.samples)
        return np.log10(p)


def _pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64 bits for pairs of hashes."""
    x = (context ^ (word >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _leading(keys: np.ndarray, n_bytes: int) -> np.ndarray:
    return keys >> np.uint64(64 - 8 * n_bytes)


def _planes(values: np.ndarray, n_bytes: int = 8) -> bytes:
    """The last bytes of 64-bit values, all first bytes, then all second ones and so on: the leading ones change little."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :n_bytes].T).tobytes()


def _from_planes(blob: bytes, n_bytes: int = 8, kind=np.uint64) -> np.ndarray:
    out = np.zeros((len(blob) // n_bytes, 8), np.uint8)
    out[:, :n_bytes] = np.frombuffer(blob, np.uint8).reshape(n_bytes, -1).T
    return out.view(kind).ravel()


def _pair_scores(row: dict, rest: list[dict], samples: list[Shared], side: int):
    """Keys of a block's pairs in order, with the training tokens of each pair and of its word, and the pair's log10 probability."""
    b = _Block(row)
    around = _Around(b, rest, side)
    n = len(samples)
    own = [replace(s, customers=around.customers, tables=t.astype(float)) for s, t in zip(samples, around.by_context[-n:])]
    model = _Model(row | {c: [_small(x) for x in getattr(around, c)[-n:]] for c in ("tables", "roots")}, own, [x.astype(float) for x in around.by_word[-n:]])
    keys = _pair_keys(b.names[b.context], b.words[b.word])
    order = np.argsort(keys)
    return keys[order], b.counts[order], around.word_customers[b.word[order]], model.log10(b.word, b.context)[order]


def _send_tokens(side: int, key_bytes: int, hot: np.ndarray, hot_values: np.ndarray):
    """To each block the tokens of its pairs, and to one more row each document's own values with its hot pairs scored.

    Of a key go as many bytes as all blocks need to tell their own pairs apart; documents go as steps from one to the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in _Batches().read(batches):
            hashes, word, before, doc = batch.arrays()
            n, line = len(batch.ids), (hashes % np.uint64(side)).astype(np.int64)
            key, block = _pair_keys(hashes[before], hashes[word]), line[before] * side + line[word]
            out = {c: [] for c in _names(SENT)}
            sizes = np.bincount(doc, minlength=n)
            if len(hot):
                place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                on = hot[place] == key
                at, d, on = place[on], doc[on], ~on
                key, block, doc = key[on], block[on], doc[on]
            else:
                at, d = np.zeros(0, np.int64), np.zeros(0, np.int64)
            values = [np.bincount(d, hot_values[i, at], n) for i in (0, 1)]
            row = (-1 - number % (side * side), number, n, None, None, _small(np.diff(np.arange(n), prepend=0)), _small(sizes), _small(np.bincount(d, minlength=n)), _planes(np.concatenate(values)), batch.ids)
            for c, x in zip(out, row):
                out[c].append(x)
            for b, own in _dealt(block, side * side):
                keys, which = np.unique(_leading(key[own], key_bytes), return_inverse=True)
                docs, sizes = np.unique(doc[own], return_counts=True)
                for c, x in zip(out, (b, number, len(docs), _planes(keys, key_bytes), _blob(which, _kind(len(keys))), _small(np.diff(docs, prepend=0)), _small(sizes), None, None, None)):
                    out[c].append(x)
            yield _table({c: (out[c], _ARROW[kind]) for c, kind in (x.split() for x in SENT.split(", "))})
            number += 1

    return run


SENT = "block long, batch long, n_docs long, keys binary, key binary, docs binary, sizes binary, known binary, values binary, ids array<long>"
SUMS = "block long, batch long, n_docs long, docs binary, sizes binary, known binary, values binary, ids array<long>"


def _score(samples: list[Shared], base, side: int, key_bytes: int):
    """The sums that a block's tokens add to each document of each batch."""

    def run(sent, block):
        out, is_sent = {c: [] for c in _names(SUMS)}, pc.is_valid(sent.column("batch"))
        if block.num_rows:
            rest = sent.filter(pc.invert(is_sent)).select(dict.fromkeys(_names(_both(TOTALS, ROUND))))
            known, _, of_word, score = _pair_scores(block.to_pylist()[0], rest.to_pylist(), samples, side)
            known, likely = _leading(known, key_bytes), base(of_word)
        sent = sent.filter(is_sent).select(_names(SENT))
        for row in (sent.slice(k, 1).to_pylist()[0] for k in range(sent.num_rows)):
            if row["ids"] is None:
                keys = _from_planes(row["keys"], key_bytes)
                sizes = _ints(row["sizes"], row["n_docs"]).astype(np.int64)
                at = np.searchsorted(known, keys)[np.frombuffer(row["key"], _kind(len(keys)))]
                starts = np.cumsum(sizes) - sizes
                row["known"] = _small(np.add.reduceat((of_word[at] > 0).astype(np.int64), starts))
                row["values"] = _planes(np.concatenate([np.add.reduceat(x[at], starts) for x in (likely, score)]))
                row["sizes"] = None
            for c, x in out.items():
                x.append(row[c])
        return pa.table({c: pa.array(out[c], _ARROW[kind]) for c, kind in (x.split() for x in SUMS.split(", "))})

    return run


def _gather(_key, parts):
    rows = parts.to_pylist()
    own = next(r for r in rows if r["ids"] is not None)
    n = len(own["ids"])
    sums, known = np.zeros((2, n)), np.zeros(n, np.int64)
    for r in sorted(rows, key=lambda r: r["block"]):  # in one order, so that sums agree to the last bit
        docs = np.cumsum(_ints(r["docs"], r["n_docs"]).astype(np.int64))
        sums[:, docs] += _from_planes(r["values"], kind=np.float64).reshape(2, -1)
        known[docs] += _ints(r["known"], r["n_docs"]).astype(np.int64)
    return pa.table({
        "doc_id": pa.array(own["ids"], pa.int64()), "held_out": pa.array([held_out(i) for i in own["ids"]]), "n_tokens": pa.array(_ints(own["sizes"], n).astype(np.int64)),
        "n_known": pa.array(known), "base_score": pa.array(sums[0]), "score": pa.array(sums[1]),
    })


def shard_count(size: int) -> int:
    """Shards for so many bytes of text, of two blocks each. The text alone decides, not the session, as blocks draw their own random numbers."""
    return int(max(1, size // PER_SHARD, min(size // PER_SMALL_SHARD, SMALL_SHARDS)))


def grid_side(size: int) -> int:
    """Lines of the grid for so many bytes of text. A shard of text gets two blocks, so that a block's arrays stay small."""
    return math.isqrt(2 * shard_count(size) - 1) + 1 if size >= PER_SMALL_SHARD else 1


def scores(docs: DataFrame, seed: int = 5) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of `docs` (doc_id, text).

    Documents whose crc32 of the id as text, modulo 5, is not 1 are learned from; all are scored. Tokens are the words between ASCII white space with A-Z in
    lower case and one end for each text, so null and empty texts have one token; a null id counts as an empty text there. base_score is the sum of log10 of add-half
    unigram probabilities, score that of the model's probabilities averaged over samples. -score / n_tokens is the text's log10
    perplexity. Scores do not depend on partitioning. Rows are scored one by one, also those with equal ids. Without training documents all known sums are empty and every token has
    probability 1, as the one unknown word.

    Pairs of words by hash are dealt to blocks that grow in number with the text; counts are summed in each task before they move. Pairs with over one in HOT training tokens, of
    which there are fewer than HOT, are scored where they stand; so no block gets more than that share of tokens for one pair.
    """
    spark = docs.sparkSession
    pairs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = pairs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    side = grid_side(size)
    with Scratch(spark) as scratch, freed_shuffles(spark):

        def stored(df: DataFrame, **how) -> DataFrame:
            return scratch.table(df, **{"parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}, **how)

        sent = pairs.mapInArrow(_send_pairs(side), PAIRS)
        blocks = stored(sent.groupBy("block").applyInArrow(_open_block, BLOCK), bucket_by="block")
        parts = blocks.mapInArrow(_first_parts(side), PARTS)
        totals = stored(parts.groupBy("owner").applyInArrow(_first_total(side), _both(TOTALS, OWNER)), bucket_by="owner")
        rest, owners = (totals.where(f"block IS {x} NULL").select(*_names(y)) for x, y in (("NOT", TOTALS), ("", OWNER)))
        n, shared = _shared(rest)
        samples = []
        for number in range(BURN_IN + SAMPLES):
            old = scratch.names[2:]
            rows = stored(_with(blocks, rest, _sweep(shared, number, seed, side), _both(ROUND, PARTS)))
            parts = rows.where("owner IS NOT NULL").select(*_names(PARTS))
            replies = stored(owners.groupBy("owner").cogroup(parts.groupBy("owner")).applyInArrow(_total(shared, number, seed, side), TOTALS))
            scratch.drop(old)
            shared = _shared(replies, shared)[1]
            samples = [*samples, shared][-SAMPLES:]
            rest = replies.unionByName(rows.where("owner IS NULL").select(*_names(ROUND)), allowMissingColumns=True)
        scratch.drop(scratch.names[1:2])
        smooth = n + 0.5 * (shared.vocabulary + 1)
        base = lambda counts: np.log10((counts + 0.5) / smooth)
        key_bytes = blocks.agg(F.max("key_bytes")).first()[0] or 8
        hot, hot_values = _hot_pairs(blocks, rest, n, samples, base, side)
        sent = pairs.mapInArrow(_send_tokens(side, key_bytes, hot, hot_values), SENT).unionByName(rest, allowMissingColumns=True)
        values = sent.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_score(samples, base, side, key_bytes), SUMS)
        out = values.groupBy("batch").applyInArrow(_gather, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        return cut(out.withColumn("train_tokens", F.lit(int(n)).cast("long")))


def _with(blocks: DataFrame, rest: DataFrame, run, schema: str) -> DataFrame:
    """`run` over each block and what it knows of the others."""
    rest = rest.select(*[c if c in rest.columns else F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in _both(TOTALS, ROUND).split(", "))])
    return blocks.groupBy("block").cogroup(rest.groupBy("block")).applyInArrow(run, schema)


def _hot_pairs(blocks: DataFrame, rest: DataFrame, n: float, samples: list[Shared], base, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs with more than n / HOT training tokens, fewer than HOT, with the log10 probability of the word alone and that of the pair."""

    def run(block, rest):
        found = [np.zeros(0)] * 3
        if block.num_rows:
            keys, counts, of_word, score = _pair_scores(block.to_pylist()[0], rest.to_pylist(), samples, side)
            on = np.flatnonzero(counts * HOT > n)
            found = [keys[on].view(np.int64), base(of_word[on]), score[on]]
        return pa.table({"key": pa.array(found[0], pa.int64()), "base": pa.array(found[1], pa.float64()), "score": pa.array(found[2], pa.float64())})

    some = blocks.where(F.col("most") * HOT > n)
    rows = _with(some, rest.join(some.select("block"), "block", "left_semi"), run, "key long, base double, score double").collect()
    keys = np.array([r.key for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([[r.base for r in rows], [r.score for r in rows]], float)[:, order]
