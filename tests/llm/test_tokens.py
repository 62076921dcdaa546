import random

import public_tokenizers
import pytest

from rekindle.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    return len(tokens.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids)


def mixed_text(rng, n):
    parts = ["hello", "wörld", "it's", "we'll", "''re", "<|endoftext|>", "<|startoftext|>", "<|endof", "123", "中文，世界", "x́y", "́", "각", "Σας", "!!", "...", " ", "  ", "\n", "\t", " ", " ", " ", "İstanbul", "a" * 40, "!!\x1c!!", "\x85", "<| endoftext|>", "\x0b", "\x0c", "\U0001f600"]
    return "".join(rng.choices(parts, k=n))


@pytest.mark.parametrize("step, overlap", [(40, 30), (100, 40), (64, 63), (1000, 200)])
def test_counts_are_those_of_whole_texts(spark, step, overlap):
    rng = random.Random(step)
    texts = [mixed_text(rng, rng.randint(0, 400)) for _ in range(60)]
    texts += ["z" * 5000, "中" * 3000, "é" * 2000, "- " * 1500, "<|endoftext|>" * 200, "́" * 900, " " * 3000, "", None]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[0], 1), (3, texts[60], 1), (3, texts[60], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = tokens.token_counts(df, PATH, 100, step, overlap)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), whole(t), whole(t) > 100) for i, t, _ in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_production_chunks_and_a_very_long_text(spark):
    rng = random.Random(1)
    texts = [mixed_text(rng, 60_000), " ".join("w%d" % rng.randrange(10**6) for _ in range(150_000)), "q" * 700_000, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df, PATH, 2048).collect()} == {i: whole(t) for i, t in enumerate(texts)}


def test_pieces_are_encoded_once_and_forgotten(monkeypatch):
    assert tokens.breaks_at_space(PATH) and not tokens.breaks_at_space(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(7)
    texts = [mixed_text(rng, rng.randint(0, 80)) for _ in range(300)] + ["", " ", "same words again"] * 3
    monkeypatch.setattr(tokens, "BATCH_CHARS", 500)
    monkeypatch.setattr(tokens, "KNOWN", 100)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        assert tokens.counts(texts, path) == [len(tokens.tokenizer(path).encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunks_cover_a_text_and_overlap():
    for n in range(0, 200, 7):
        text = "".join(chr(97 + k % 26) for k in range(n))
        own = tokens.chunks(text, 20, 6)
        assert "".join(c[:20] for c in own[:-1]) + own[-1] == text
        assert all(len(c) == 26 for c in own[:-1])


def test_empty_table_and_bad_overlap(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.token_counts(df, PATH, 5).count() == 0
    with pytest.raises(ValueError):
        tokens.long_counts(df, PATH, 10, 10)
