"""The pipeline against its stages written out in plain Python."""

import random
import re
from collections import Counter, defaultdict
from hashlib import md5
from itertools import product

import pytest
import xxhash

import corpus_pipeline
from rekindle.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, copies int"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def repeated_words(ws):
    grams = Counter(zip(ws, ws[1:], ws[2:]))
    return len({k + j for k in range(len(ws) - 2) if grams[ws[k], ws[k + 1], ws[k + 2]] > 1 for j in range(3)})


def content_share(text, model):
    """Share of words in content lines, by the best of all paths; for texts of few lines."""
    features, words = quality.line_features(text)
    own = features @ model.weights
    value = lambda s: sum(own[k][s[k]] for k in range(len(s))) + sum(model.links[a, b] for a, b in zip(s, s[1:]))
    best = max(product((0, 1), repeat=len(words)), key=value)
    return sum(int(w) for w, s in zip(words, best) if s) / sum(words)


def good(rows, model):
    out = []
    for r in rows:
        ws = words_of(r[1])
        if len(ws) >= 50 and 2 * repeated_words(ws) <= len(ws) and content_share(r[1], model) >= 0.5:
            out.append(r)
    return out


def without_repeated_lines(rows):
    seen, out = {}, []
    for r in sorted(rows, key=lambda r: r[0]):
        lines = r[1].split("\n")
        gone = set()
        for p, pair in enumerate(zip(lines, lines[1:])):
            if seen.setdefault(pair, (r[0], p)) != (r[0], p):
                gone |= {p, p + 1}
        if len(gone) < len(lines):
            text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
            out.append((r[0], text, *r[2:4], len(text), *r[5:]))
    return out


def first_of_near_copies(rows):
    fps = {}
    for r in rows:
        ws = words_of(lowered(r[1]))
        hs = [xxhash.xxh64_intdigest(" ".join(ws[k : k + 4]).encode(), 42) for k in range(max(1, len(ws) - 3))] if ws else []
        fps[r[0]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    group = {i: i for i in fps}
    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 4 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    return [r for r in rows if group[r[0]] == r[0]]


def clean_of(rows, items):
    shingles = lambda t: {tuple(ws[k : k + 5]) for ws in [words_of(lowered(t))] for k in range(max(1, len(ws) - 4))}
    wanted = [shingles(t) for t in items if words_of(t)]
    return [r for r in rows if not any(len(shingles(r[1]) & s) / len(s) >= 0.8 for s in wanted)]


def mixed(rows, weights=(3.0, 1.0, 2.0)):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, left = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values())
    while left > 1e-9:
        free = [s for s in order if target[s] < 2 * sizes[s]]
        total, over = sum(weight[s] for s in free), 0.0
        for s in free:
            target[s] += left * weight[s] / total
            over += max(0.0, target[s] - 2 * sizes[s])
            target[s] = min(target[s], 2.0 * sizes[s])
        left = over
    out = []
    for r in rows:
        rate = target[r[3]] / sizes[r[3]]
        draw = int(md5(f"mix:{r[0]}".encode()).hexdigest()[:12], 16) / 2**48
        out += [(*r, k + 1) for k in range(int(rate) + (draw < rate - int(rate)))]
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("aeioulnrst", k=6)) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n)).capitalize() + "."
    prose = lambda: "\n".join(sentence(14) for _ in range(6))
    junk = lambda: "\n".join(" | ".join(f"X{rng.randrange(10**6)}" for _ in range(12)) + " |" for _ in range(6))
    texts = [junk() if i % 5 == 0 else prose() for i in range(60)]
    texts.append(texts[1].upper())  # a copy but for case
    texts.append(texts[2])  # an exact copy: its lines go
    texts.append("\n".join([*texts[3].split("\n")[:2], prose()]))  # opens with lines that stand earlier
    items = [sentence(20), sentence(30), "", None]
    texts += [f"{prose()}\n{items[0]}", f"{items[1].upper()}\n{prose()}", None, "", "too short", "again and " * 60]
    sources = ["a", "a", "b", None, "c", "a"]
    rows = [(i, t, "en", sources[i % 6], len(t or ""), "k", 9) for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, items


def test_pipeline_against_brute_force(spark, corpus):
    folder, rows, items = corpus
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    model = quality.train(read("documents"), read("labels"))
    kept = good(rows, model)
    lined = without_repeated_lines(kept)
    single = first_of_near_copies(lined)
    clean = clean_of(single, items)
    assert len(rows) > len(kept) > len(lined) > len(single) > len(clean)  # every stage has something to do
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")] + ["copy"]
    assert Counter(map(tuple, got.collect())) == Counter(mixed(clean))


def test_stages_on_an_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus[0])
        assert out.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
