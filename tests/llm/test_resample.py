import math
import random
import re
import zlib
from hashlib import sha256

import pytest

from rekindle.llm import resample


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(rows, target, percent, min_words, max_run, buckets):
    def features(text):
        ws = words_of(text)
        return [zlib.crc32(b" ".join(ws[k : k + n])) % buckets for n in range(1, max_run + 1) for k in range(len(ws) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for b in features(text):
            s[b] += 1
    for text in target:
        for b in features(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out, able = [], []
    for i, (doc, text) in enumerate(rows):
        own = features(text)
        weight = sum(gain[b] for b in own)
        h = int(sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(own), weight, score, None])
        if len(words_of(text)) >= min_words:
            able.append(i)
    able.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    for rank, i in enumerate(able[: percent * len(able) // 100], 1):
        out[i][4] = rank
    return sorted(map(repr, out))


@pytest.mark.parametrize("max_run, percent, buckets", [(1, 10, 10_000), (1, 50, 7), (2, 30, 500), (3, 100, 50)])
def test_against_brute_force(spark, monkeypatch, max_run, percent, buckets):
    monkeypatch.setattr(resample, "PIECE", 64)  # texts go through in many stretches
    rng = random.Random(max_run * percent)
    vocabulary = ["alpha", "Beta", "GAMMA", "été", "x1", "中文", "don't", "a_b", "–", "É", " "]
    texts = [rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(150)] + [None, "", " \n", "w " * 5000]
    rows = list(enumerate(texts)) + [(None, texts[3]), (None, None), (None, texts[3])] + [(7, texts[7])] * 5 + [(-4, texts[9])]
    target = ["alpha alpha x1 " * 9, None, "", "été"]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, score string, row int").repartition(3)
    other = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.judged(df, other, percent=percent, max_run=max_run, buckets=buckets).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(repr(list(r)) for r in got) == brute(rows, target, percent, 20, max_run, buckets)
    drawn = resample.draw(df, other, percent=percent, max_run=max_run, buckets=buckets)
    assert drawn.columns == [*df.columns, "rank"]
    assert sorted(r.rank for r in drawn.collect()) == list(range(1, 1 + sum("None]" not in x for x in brute(rows, target, percent, 20, max_run, buckets))))


def test_a_tie_of_all_rows_is_cut_exactly(spark):
    """Rows that agree in everything: a third of the table, and then the whole of it."""
    text = "one two three " * 10
    for others in (200, 0):
        rows = [(None, text)] * 100 + [(k, f"w{k} " * 25) for k in range(others)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = resample.judged(df, df.limit(0), percent=37)
        assert sorted(r.rank for r in got.where("rank is not null").collect()) == list(range(1, 37 * len(rows) // 100 + 1))
        assert got.count() == len(rows)


def test_cutoff_against_sorting(spark):
    rng = random.Random(4)
    rows = [(rng.choice([-(2**40), -3, -3, 0, 5, 2**50]), rng.randint(-2, 2), k) for k in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    for take in (1, 2, 37, 150, 299, 300):
        limit = resample.cutoff(df, ["a", "b", "c"], take)
        assert {tuple(r) for r in df.where(resample._reached(["a", "b", "c"], limit)).collect()} == set(sorted(rows)[:take])


def test_nothing_to_draw(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "few words"), (2, None)], "doc_id long, text string")
    assert resample.judged(df, some).count() == 0
    assert [r.rank for r in resample.judged(some, df).collect()] == [None, None]
    assert resample.draw(some, df).count() == 0
