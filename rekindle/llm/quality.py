"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents that the field is fitted on at most, taken in the order of their ids' hash.
MAX_LABELLED = 2_000
#: Lines of a chain in fitting; longer documents are fitted as several chains, so that no long one pads all others.
CHAIN = 256
#: Share of a document's words that must stand in content lines.
MIN_CONTENT = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept"]
_TYPES = [T.LongType()] * 5 + [T.DoubleType()] + [T.BooleanType()] * 2

# Classes of bytes: white space, lower case, upper case, digits, symbols, table bars, exclamation marks, other ASCII, parts of longer characters.
SPACE, LOWER, UPPER, DIGIT, SYMBOL, BAR, BANG, OTHER, WIDE = range(9)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
_CLASS[ord("a") : ord("z") + 1] = LOWER
_CLASS[ord("A") : ord("Z") + 1] = UPPER
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[list(b"#*$%&<>")] = SYMBOL
_CLASS[ord("|")] = BAR
_CLASS[ord("!")] = BANG
_CLASS[128:] = WIDE

N_FEATURES = 12


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with a word, and the words in it."""
    b = np.frombuffer(text.encode(), np.uint8)
    kind = _CLASS[b]
    newline = b == 10
    line = np.cumsum(newline) - newline
    n = int(newline.sum()) + 1
    counts = np.bincount(line * 9 + kind, minlength=n * 9).reshape(n, 9).astype(float)
    word = kind != SPACE
    opens = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    words = np.bincount(line[opens], minlength=n)
    ends = np.flatnonzero(word & np.concatenate((~word[1:], [True])))
    last = np.zeros(n, np.uint8)
    last[line[ends]] = b[ends]
    full = words > 0
    counts, words, last = counts[full], words[full], last[full]
    shown = counts[:, 1:].sum(axis=1)
    share = lambda c: counts[:, c] / shown
    letters = counts[:, LOWER] + counts[:, UPPER] + counts[:, WIDE]
    per_word = lambda c: np.minimum(counts[:, c] / words, 2.0)
    columns = [
        np.ones(len(words)), np.log1p(words) / 5, shown / words / 10, letters / shown, counts[:, UPPER] / np.maximum(letters, 1), share(DIGIT) * 4,
        per_word(SYMBOL), per_word(BAR), per_word(BANG), share(OTHER) * 4, np.isin(last, list(b".!?:;\"")).astype(float), (words <= 2).astype(float),
    ]
    return np.stack(columns, axis=1), words


class LineField:
    """A chain over the lines of a document with the states boilerplate (0) and content (1)."""

    def __init__(self, weights: np.ndarray, links: np.ndarray):
        self.weights, self.links = weights, links

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The likeliest states of a document's lines."""
        own, links = features @ self.weights, self.links
        best, back = own[0], np.zeros((len(own), 2), np.int8)
        for i in range(1, len(own)):
            ways = best[:, None] + links
            back[i] = ways.argmax(axis=0)
            best = ways.max(axis=0) + own[i]
        states = np.zeros(len(own), np.int8)
        states[-1] = best.argmax()
        for i in range(len(own) - 1, 0, -1):
            states[i - 1] = back[i, states[i]]
        return states

    @staticmethod
    def fit(documents: list[tuple[np.ndarray, int]], rounds: int = 200, rate: float = 0.2, decay: float = 1e-3) -> LineField:
        """Maximum likelihood with a penalty, by gradient steps over all documents (features, label of all lines) at once."""
        weights, links = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
        documents = sorted((d for d in documents if len(d[0])), key=lambda d: -len(d[0]))
        if not documents:
            weights[0, 1] = 1.0  # the feature that is one on every line
            return LineField(weights, links)
        lengths = np.array([len(x) for x, _ in documents])
        steps, total = lengths[0], lengths.sum()
        x = np.zeros((steps, len(documents), N_FEATURES))
        y = np.array([label for _, label in documents])
        for k, (features, _) in enumerate(documents):
            x[: len(features), k] = features
        alive = [int((lengths > i).sum()) for i in range(steps)]  # sorted by length: the documents that have a line i come first
        seen = np.zeros((N_FEATURES, 2))
        for label in (0, 1):
            seen[:, label] = x[:, y == label].sum(axis=(0, 1))
        seen_links = np.diag([(lengths[y == label] - 1).sum() for label in (0, 1)]).astype(float)
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, links)]
        for step in range(1, rounds + 1):
            own = x @ weights
            forward, backward = np.zeros_like(own), np.zeros_like(own)
            forward[0] = own[0]
            for i in range(1, steps):
                a = alive[i]
                forward[i, :a] = np.logaddexp.reduce(forward[i - 1, :a, :, None] + links, axis=1) + own[i, :a]
            for i in range(steps - 2, -1, -1):
                a = alive[i + 1]
                backward[i, :a] = np.logaddexp.reduce(links + (own[i + 1, :a] + backward[i + 1, :a])[:, None, :], axis=2)
            norm = np.logaddexp.reduce(forward[0] + backward[0], axis=1)
            expected, expected_links = np.zeros_like(weights), np.zeros_like(links)
            for i in range(steps):
                a = alive[i]
                expected += x[i, :a].T @ np.exp(forward[i, :a] + backward[i, :a] - norm[:a, None])
                if i:
                    pair = forward[i - 1, :a, :, None] + links + (own[i, :a] + backward[i, :a])[:, None, :]
                    expected_links += np.exp(pair - norm[:a, None, None]).sum(axis=0)
            for p, g, (m, v) in zip((weights, links), ((seen - expected) / total - decay * weights, (seen_links - expected_links) / total - decay * links), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return LineField(weights, links)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> LineField:
    """The field fitted on up to `max_labelled` documents of `labels` (doc_id, quality), a number that does not grow with the corpus.

    Every line of a document of quality 1 counts as content and every line of one of quality 0 as boilerplate; as plain lines are far more
    frequent in good documents, those in bad ones come out as content all the same. Labels that are null, neither 0 nor 1, or in conflict
    are not used, nor are those of documents without a line that has a word; a text is used once, whole, in chains of at most CHAIN lines. Without usable labels every line is content.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    agreed = usable.where(F.col("quality") == F.col("most")).select("doc_id", "quality")
    present = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id").distinct()
    picked = agreed.join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select(F.col("doc_id"), "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [line_features(t)[0].ravel().tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int64()), pa.array(made, pa.list_(pa.float32()))], names=["doc_id", "quality", "features"])

    sample = texts.mapInArrow(run, "doc_id long, quality long, features array<float>")
    rows = sorted({(r.doc_id, r.quality, tuple(r.features)) for r in sample.collect()})
    whole = [(np.array(f).reshape(-1, N_FEATURES), q) for _, q, f in rows]
    return LineField.fit([(x[at : at + CHAIN], q) for x, q in whole for at in range(0, len(x), CHAIN)])


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines, and words in three-word windows that the text has twice or more."""
    words = text.encode().split()  # at ASCII white space only
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeated = 0
    if n > 3:
        number = dict(zip(dict.fromkeys(words), range(n)))
        ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        key = pairs[:-1] * len(number) + ids[2:]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def judgement(text: str | None, model: LineField) -> tuple:
    """The values of MADE for one text."""
    text = text or ""
    n, chars, symbols, dup_lines, repeated = base_counts(text)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    share = 0.0
    if n:
        features, words = line_features(text)
        share = float(words[model.viterbi(features) == 1].sum() / words.sum())
    return n, chars, symbols, dup_lines, repeated, share, failed, not failed and share >= MIN_CONTENT


def judge(docs: DataFrame, model: LineField) -> DataFrame:
    """All rows and columns of `docs` (text, any others) with the columns of MADE.

    Words stand between ASCII white space. n_symbols counts the characters of #*$%&|<>, n_dup_lines the lines with a word that equal an earlier one.
    A text fails the base rules with fewer than 50 words or with over half of its words in repeated three-word windows; it is kept if it passes and
    at least half of its words stand in lines that Viterbi decoding marks as content. Null, empty and blank texts have no words and fail. Rows are judged one by one, so equal
    rows are judged alike. Columns of `docs` by the names of results are replaced.
    """
    rest = docs.drop(*MADE)
    schema = T.StructType([*rest.schema.fields, *(T.StructField(c, t) for c, t in zip(MADE, _TYPES))])
    at = rest.columns.index("text")
    kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.bool_()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [judgement(t.as_py(), model) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds))], names=schema.names)

    return rest.mapInArrow(run, schema)
