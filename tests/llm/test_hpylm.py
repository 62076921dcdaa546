import math
import zlib
from collections import Counter

import numpy as np
import pytest

from rekindle.llm import hpylm


def rows(n=400, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"W{k}" for k in range(300)]
    out = []
    for i in range(n):
        at, text = int(rng.integers(300)), []
        for _ in range(int(rng.integers(1, 120))):
            text.append(words[at])
            at = (at * 7 + int(rng.choice([1, 2, 3]))) % 300 if rng.random() < 0.8 else int(rng.zipf(1.5)) % 300
        out.append((i, " ".join(text) + (f" only{i}" if i % 10 == 0 else "")))
    return [*out, (400, None), (401, ""), (402, " \t"), (None, "w1 w2"), (3, out[3][1]), (403, "a " * 3000)]


@pytest.fixture(scope="module")
def made(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, word string, batch int")
    return data, hpylm.scores(df).collect()


def test_base_values(made):
    data, got = made
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = Counter(w for i, t in data if not held(i) for w in [*(t or "").lower().split(), ""])
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in data:
        words = [*(t or "").lower().split(), ""]
        want.append((str(i), held(i), len(words), sum(w in count for w in words), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), 6)))
    assert sorted(want) == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)


def test_scores_beat_the_base_on_held_out_texts(made):
    _, got = made
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)
    assert all(r.score < 0 for r in got)


def test_hot_words_score_like_others(spark, made, monkeypatch):
    monkeypatch.setattr(hpylm, "HOT", 1)  # no word is hot then
    again = hpylm.scores(spark.createDataFrame(rows(), "doc_id long, text string")).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens)
    for a, b in zip(sorted(made[1], key=key), sorted(again, key=key)):
        assert key(a) == key(b) and abs(a.score - b.score) < 1e-6


def test_scores_do_not_depend_on_partitions(spark, made, monkeypatch):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    assert hpylm.shard_count(5 * 10**8) == hpylm.SMALL_SHARDS and hpylm.shard_count(10**11) > 1000 and hpylm.shard_count(0) == 1
    monkeypatch.setattr(hpylm, "PER_SMALL_SHARD", 10_000)  # several shards
    before, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    for partitions in (3, 11):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        out.append(sorted(map(repr, hpylm.scores(df.repartition(partitions)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    words = np.arange(1, 21, dtype=np.uint64)
    pair = np.unique(rng.integers(0, 20 * hpylm.CONTEXTS, 500))
    pair = np.unique(np.concatenate((pair, np.arange(20) * hpylm.CONTEXTS + 5)))
    word, context = pair // hpylm.CONTEXTS, pair % hpylm.CONTEXTS
    counts = rng.integers(1, 9, len(pair))
    tables = np.minimum(counts, rng.integers(1, 4, len(pair))).astype(float)
    roots = np.ones(20)
    s = hpylm.Shared(np.bincount(context, counts, hpylm.CONTEXTS), np.bincount(context, tables, hpylm.CONTEXTS), tables.sum(), 20.0, 20)
    row = {"words": words.tobytes(), "dishes": np.bincount(word).astype(np.uint32).tobytes(), "contexts": context.astype(np.uint16).tobytes(), "counts": counts.astype(np.int64).tobytes(),
           "tables": [tables.astype(np.uint32).tobytes()], "roots": [roots.astype(np.uint32).tobytes()]}
    model = hpylm._Model(row, [s])
    for c in (5, int(context[0]), 4000):
        assert abs((10 ** model.log10(np.arange(21), np.full(21, c))).sum() - 1) < 1e-9  # 20 known words and the unknown one


def test_seating_follows_the_restaurant_rule():
    """Mean number of tables against customers that come one by one."""
    rng = np.random.default_rng(2)
    for customers, strength, discount, base in ((2, 5.0, 0.5, 0.3), (40, 20.0, 0.5, 0.1), (3000, 50.0, 0.7, 0.02)):
        leaps = hpylm.seat(np.full(4000, customers), np.full(4000, strength), discount, np.full(4000, base), rng)
        t = np.ones(4000)
        for i in range(1, customers):
            a = (strength + discount * t) * base
            t += rng.random(4000) * (a + i - discount * t) < a
        assert abs(leaps.mean() - t.mean()) < 5 * t.std() / math.sqrt(2000) + 1e-9 and leaps.min() >= 1 and leaps.max() <= customers


def test_empty(spark):
    assert hpylm.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(100) if hpylm.held_out(i)], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens) for r in hpylm.scores(only_held).collect()} == {(0, 0)}


def clashing_words():
    """Two words whose hashes agree modulo 4,096."""
    import xxhash

    seen = {}
    for k in range(10_000):
        if (other := seen.setdefault(xxhash.xxh64_intdigest(f"c{k}") % 4096, f"c{k}")) != f"c{k}":
            return other, f"c{k}"


def test_every_context_has_a_restaurant_of_its_own(spark):
    one, two = clashing_words()
    learned = [i for i in range(2000) if not hpylm.held_out(i)]
    held = [i for i in range(2000) if hpylm.held_out(i)][:4]
    texts = [(i, f"{one} xx" if n % 2 else f"{two} yy") for n, i in enumerate(learned)]
    asked = [f"{one} xx", f"{one} yy", f"{two} yy", f"{two} xx"]
    got = {r.doc_id: r.score for r in hpylm.scores(spark.createDataFrame([*texts, *zip(held, asked)], "doc_id long, text string")).collect()}
    right, wrong, right_too, wrong_too = (got[i] for i in held)
    assert right > wrong + 1 and right_too > wrong_too + 1


def test_totals_meet_those_of_all_pairs(spark):
    """What blocks know of their contexts and words after a round is what a plain count over all of them gives."""
    import pyarrow as pa

    side, text = 3, " ".join(f"w{k * k % 37} w{k % 11}" for k in range(500))
    docs = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3]), pa.array([text, None, "w1 w1 new", text[::-1]])], names=["doc_id", "text"])
    sent = pa.Table.from_batches([*hpylm._send_pairs(side)(iter([docs]))])
    blocks = [hpylm._open_block([pa.scalar(b)], sent.filter(pa.compute.equal(sent.column("block"), b))).to_pylist()[0] for b in sorted(set(sent.column("block").to_pylist()))]
    parts = pa.Table.from_pylist([p for b in blocks for p in hpylm._parts(hpylm._Block(b), side)], schema=hpylm._filled(hpylm.PARTS, []).schema)
    replies = [r for o in sorted(set(parts.column("owner").to_pylist())) for r in hpylm._first_total(side)([pa.scalar(o)], parts.filter(pa.compute.equal(parts.column("owner"), o))).to_pylist() if r["block"] is not None]
    follow, heads, tails = Counter(), Counter(), Counter()
    for i, t in enumerate(docs.column("text").to_pylist()):
        if not hpylm.held_out(i):
            words = [b"\n", *hpylm.tokens(t)]
            follow.update(zip(words, words[1:]))
    for (u, w), c in follow.items():
        heads[hash_(u)] += c
        tails[hash_(w)] += c
    for b in blocks:
        block = hpylm._Block(b)
        around = hpylm._Around(block, [r for r in replies if r["block"] == b["block"]], side)
        assert around.customers.tolist() == [heads[u] for u in block.names.tolist()] and around.word_customers.tolist() == [tails[w] for w in block.words.tolist()]
        assert around.by_word[-1].tolist() == [sum(hash_(w) == x for _, w in follow) for x in block.words.tolist()]
    assert sum(int(hpylm._Block(b).counts.sum()) for b in blocks) == sum(follow.values())


def hash_(word):
    import xxhash

    return xxhash.xxh64_intdigest(word)


def test_a_frequent_context_or_word_is_dealt_to_many_blocks(spark):
    import pyarrow as pa

    side, words = 8, [f"v{k}" for k in range(4000)]
    docs = pa.RecordBatch.from_arrays([pa.array([0, 2]), pa.array([" ".join(f"the {w}" for w in words), " ".join(f"{w} of" for w in words)])], names=["doc_id", "text"])
    pairs = {b: len(n) // 4 for batch in hpylm._send_pairs(side)(iter([docs])) for b, n in zip(*(batch.column(c).to_pylist() for c in ("block", "counts")))}
    assert max(pairs.values()) < sum(pairs.values()) / side  # either stands in one line of eight blocks


def test_blocks_are_small_and_shuffles_are_freed(spark):
    from rekindle.session import freed_shuffles

    assert hpylm.grid_side(0) == 1 and all(hpylm.grid_side(n) ** 2 >= 2 * hpylm.shard_count(n) for n in (10**9, 10**10, 10**11))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with freed_shuffles(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before
