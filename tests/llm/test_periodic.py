import random
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from rekindle.llm import periodic
from rekindle.llm.queries import QUERIES


def brute_runs(words, min_length):
    """Every period by itself: maximal stretches of words that equal those a period further on, but for those that a smaller period has too."""
    out, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(min_length, 3 * q):
                out.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def samples(rng):
    """Words in which runs of many kinds meet."""
    parts = []
    for _ in range(rng.randint(1, 6)):
        unit = rng.choices("abcdefgh"[: rng.choice([1, 2, 3, 8])], k=rng.choice([1, 1, 2, 3, 5, 9, 17]))
        if rng.random() < 0.3:
            unit = unit * rng.randint(2, 5) + rng.choices("abc", k=rng.randint(0, 3))
        parts += (unit * rng.randint(1, 12))[rng.randint(0, 3) :]
        parts += rng.choices("abcdefghijkl", k=rng.randint(0, 12))
    return parts


@pytest.mark.parametrize("min_length", [6, 10, 24, 25, 40])
def test_runs_against_all_periods(min_length):
    rng = random.Random(min_length)
    texts = [samples(rng) for _ in range(250)] + [[], ["a"], ["a"] * 500, list("ab") * 333, list("aab") * 100 + list("aabaabb") * 60]
    fib = ["a"], ["a", "b"]
    for _ in range(11):
        fib = fib[1], fib[1] + fib[0]
    texts += [fib[1], [str(k) for k in range(300)], [str(k) for k in range(40)] * 5, [str(k * k % 97) for k in range(400)]]
    texts.append(texts[3] + texts[3])
    at = 0
    while at < len(texts):
        some = texts[at : at + rng.randint(1, 40)]
        got = periodic.runs_of([periodic.word_ids(" ".join(t).encode()) for t in some], min_length)
        assert [list(zip(*g.tolist())) for g in got] == [brute_runs(t, min_length) for t in some]
        at += len(some)


def test_the_grammar_gives_back_its_texts():
    rng = random.Random(3)
    for _ in range(100):
        texts = [np.array([ord(w[0]) for w in samples(rng)]) + 1000 * k for k in range(rng.randint(1, 4))]
        words, text = np.concatenate(texts), np.repeat(np.arange(len(texts)), list(map(len, texts)))
        g = periodic.pair_up(words, text)

        def expand(s):
            return [s] if s < g.first else expand(g.left[s - g.first]) + expand(g.right[s - g.first])  # noqa: B023

        assert [w for s in g.symbols for w in expand(s)] == words.tolist()
        for k in range(len(g.left)):
            assert expand(g.first + k) == words[g.place[k] : g.place[k] + g.length[k]].tolist()
        pairs = [(a, b) for a, b, t, u in zip(g.symbols, g.symbols[1:], g.text, g.text[1:]) if t == u]
        for p in set(pairs):  # no pair is left twice, but within a stretch of one symbol
            assert pairs.count(p) == 1


def test_equal_stretches_extend_alike():
    rng = np.random.default_rng(1)
    words = np.tile(rng.integers(0, 3, 50), 8)
    a = rng.integers(0, 390, 300)
    b = np.minimum(a + 1 + rng.integers(0, 100, 300), 399)
    ok = a < b
    a, b = a[ok], b[ok]
    m = periodic.Matcher(words)
    count = lambda x, y, step, most: next((k for k in range(most) if words[x + step * k] != words[y + step * k]), most)
    assert m.extend(a, b, 400 - b, False).tolist() == [count(x, y, 1, 400 - y) for x, y in zip(a, b)]
    assert m.extend(a, b, a, True).tolist() == [count(x - 1, y - 1, -1, x) for x, y in zip(a, b)]


def test_operator_on_odd_rows(spark, monkeypatch):
    texts = [None, "", " \n\t", "one", "ha " * 30, "a b c " * 9 + "x", "no b run " + " ".join(map(str, range(50)))]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(None, texts[4], "n"), (4, texts[4], "n"), (4, "other", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    want = []
    for i, t, _ in rows:
        words = (t or "").split()
        runs = brute_runs(words, 24)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    got = periodic.collapse_runs(df).collect()
    assert sorted(repr((r.doc_id, [tuple(x) for x in r.runs], r.text)) for r in got) == sorted(map(repr, want))
    assert periodic.collapse_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.collapse_runs(df, 5)


def test_a_very_long_text(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE", 1000)
    rng = random.Random(2)
    unit = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    words = [f"v{k}" for k in range(30_000)] + unit * 6 + ["z"] * 300_000 + unit[:7000]
    runs = periodic.runs_of([periodic.word_ids(" ".join(words).encode())])[0]
    assert list(zip(*runs.tolist())) == [(30_000, 120_000, 20_000), (150_000, 300_000, 1)]
    kept = periodic._collapsed(" ".join(words).encode(), runs)
    assert kept.split() == [w.encode() for w in [*words[:30_000], *unit, "z", *unit[:7000]]]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(samples(rng)) if i % 3 else " ".join(f"{rng.randrange(999)}é" for _ in range(rng.randint(0, 300)))) for i in range(150)] + [(200, None), (201, "a  b\n"), (None, "x " * 40)]
    assert sum(i is not None and crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        words = (t or "").split()
        n = len(words)
        h = crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
        runs = brute_runs(words, 24)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        digest = lambda x: sha256(x.encode()).hexdigest()
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((i, len(runs), *best, milli, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone))))
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
