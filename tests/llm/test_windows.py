import hashlib
import random

import numpy as np
import pytest

from rekindle.llm.substring import SuffixAutomaton, remove_repeated_words
from rekindle.llm.suffixdedup import equal_groups, remove_repeated_bytes


def brute(rows, split, join, length):
    """(id, tokens, removed, spans, hash of the rest) from all windows of all smaller ids."""
    first: dict = {}
    docs = [(i, split((t or "").encode())) for i, t in rows]
    key = lambda i: (i is None, i or 0)
    for i, tokens in docs:
        for s in range(len(tokens) - length + 1):
            w = join(tokens[s : s + length])
            if w not in first or key(i) < first[w]:
                first[w] = key(i)
    out = []
    for i, tokens in docs:
        gone = [False] * len(tokens)
        for s in range(len(tokens) - length + 1):
            if first[join(tokens[s : s + length])] < key(i):
                gone[s : s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = join([t for t, g in zip(tokens, gone) if not g])
        out.append((i, len(tokens), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = [("é" if k % 7 == 0 else "") + "".join(rng.choices("abcde", k=rng.randint(1, 6))) for k in range(400)]
    passages = [" ".join(rng.choices(words, k=rng.choice([9, 30, 49, 50, 51, 80, 200]))) for _ in range(12)]
    out = []
    for i in range(n):
        parts = [rng.choice([" ".join(rng.choices(words, k=rng.randint(1, 90))), rng.choice(passages), rng.choice(passages)]) for _ in range(rng.randint(1, 5))]
        out.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    out += [(100, None), (101, ""), (102, " \n "), (103, "a " * 300), (104, "a " * 170), (105, out[3][1]), (105, out[5][1]), (7, out[7][1]), (None, out[9][1]), (None, out[9][1]), (-4, out[11][1]), (106, "x"), (107, "z" * 400), (108, "z" * 90)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_and_words(spark, seed, monkeypatch):
    rows = texts(seed)
    df = spark.createDataFrame([(i, t, "other", 3) for i, t in rows], "doc_id long, text string, ids string, batch int").repartition(3)
    got = sorted((tuple(r) for r in remove_repeated_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)
    assert got == brute(rows, lambda b: [b[k : k + 1] for k in range(len(b))], b"".join, 50)
    got = sorted((tuple(r) for r in remove_repeated_words(df).select("doc_id", "n_words", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)
    assert got == brute(rows, bytes.split, b" ".join, 50)


def test_empty_table_and_short_length(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_bytes(empty).count() == 0 and remove_repeated_words(empty).count() == 0
    rows = [(1, "a b c d e f"), (2, "x b c d e y"), (3, "b c d"), (4, "c d e f")]
    got = remove_repeated_words(spark.createDataFrame(rows, "doc_id long, text string"), 3)
    assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 0, 2: 4, 3: 3, 4: 4}


def test_no_tables_left(spark):
    before = {t.name for t in spark.catalog.listTables()}
    remove_repeated_words(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_equal_groups():
    text = np.frombuffer(b"abcabcabdabcabc" * 3, np.uint8)
    starts = np.arange(len(text) - 11)
    live, group = equal_groups(text, starts, 11)
    want: dict = {}
    for s in starts:
        want.setdefault(text[s : s + 11].tobytes(), []).append(s)
    got: dict = {}
    for s, g in zip(live, group):
        got.setdefault(int(g), []).append(int(s))
    assert sorted(map(sorted, got.values())) == sorted(v for v in want.values() if len(v) > 1)


def test_matching_statistics():
    rng = random.Random(5)
    for _ in range(30):
        refs = ["".join(rng.choices("ab", k=rng.randint(1, 15))) for _ in range(4)]
        a = SuffixAutomaton()
        for r in refs:
            a.add(r)
        q = "".join(rng.choices("abc", k=25))
        want = [max(n for n in range(e + 1) if any(q[e - n : e] in r for r in refs)) for e in range(1, len(q) + 1)]
        assert a.matching_statistics(q) == want
