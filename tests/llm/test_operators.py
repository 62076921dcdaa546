import random
import re
from collections import Counter

import numpy as np
import xxhash

from rekindle.llm import decontam, linededup, mixing, pipeline, quality, simhash, urlfilter, warc


def test_simhash_against_all_pairs(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(200)]
    base = [rng.choices(words, k=150) for _ in range(8)]
    data = []
    for i in range(120):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(150)] = rng.choice(words)
        data.append((i, " ".join(own)))
    data += [(200, None), (201, ""), (202, " \n"), (203, "A b"), (204, "a  B"), (5, data[5][1]), (None, data[7][1]), (None, "alone by itself")]
    fps = []
    for i, t in data:
        ws = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        hs = [xxhash.xxh64_intdigest(b" ".join(ws[k : k + 4]), 42) for k in range(max(1, len(ws) - 3))] if ws else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    group = list(range(len(data)))
    for a in range(len(data)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    least = {g: min((i for (i, _), h in zip(data, group) if h == g and i is not None), default=None) for g in group}
    df = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, f"{f:016x}", least[g])) for (i, _), f, g in zip(data, fps, group))
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == len(set(group))


def test_simhash_links_random_fingerprints(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(10)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(20)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), prefix=8).collect()
    group = {f: f for f in fps}
    find = lambda x: x if group[x] == x else find(group[x])
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                group[find(a)] = find(b)
    mine = {f: f for f in fps}
    look = lambda x: x if mine[x] == x else look(mine[x])
    for r in got:
        mine[look(r.a % (1 << 64))] = look(r.b % (1 << 64))
    parts = lambda f: sorted(sorted(g for g in fps if f(g) == f(h)) for h in fps)
    assert parts(find) == parts(look)


def brute_lines(rows, n):
    docs = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda d: (d[0], d[1]))
    seen, out = {}, {}
    for d in docs:
        lines = d[2].split("\n")
        for p in range(len(lines) - n + 1):
            seen.setdefault(tuple(lines[p : p + n]), (d, p))
        gone = set()
        for p in range(len(lines) - n + 1):
            if seen[tuple(lines[p : p + n])] != (d, p):
                gone |= set(range(p, p + n))
        out[d] = "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone), sum(k - 1 not in gone for k in gone)
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    lines = [f"line {k}" for k in range(25)] + ["", " "]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 25)))) for i in range(60)] + [(70, None), (71, ""), (72, "a\na\na\na\na"), (None, "line 1\nline 2\nline 3")]
    rows += [rows[4], rows[-2]]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n_lines string")
    for n in (1, 2, 3, 5):
        want = brute_lines(rows, n)
        got = linededup.remove_repeated_lines(df, n).select("doc_id", "text", "n_lines", "n_removed", "n_runs").collect()
        assert Counter(map(repr, map(tuple, got))) == Counter(repr((i, *(want[i is None, i or 0, t] if t is not None else (None, 0, 0, 0)))) for i, t in rows)
    assert linededup.remove_repeated_lines(df.limit(0)).count() == 0


def test_quality_base_counts():
    def brute(text):
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(zip(ws, ws[1:], ws[2:]))
        hit = {k + j for k in range(len(ws) - 2) if grams[ws[k], ws[k + 1], ws[k + 2]] > 1 for j in range(3)}
        full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(hit)

    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices(["a ", "b ", "é ", "\n", "\u00a0", "#x ", "\r", "| "], k=rng.randint(0, 40)))
        assert quality.base_counts(text) == brute(text)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    for n in (1, 2, 6):
        x = rng.normal(size=(n, quality.N_FEATURES))
        f = quality.LineField(rng.normal(size=(quality.N_FEATURES, 2)), rng.normal(size=(2, 2)))
        value = lambda s: sum(x[k] @ f.weights[:, s[k]] for k in range(n)) + sum(f.links[s[k - 1], s[k]] for k in range(1, n))  # noqa: B023, E731
        best = max(([b >> k & 1 for k in range(n)] for b in range(1 << n)), key=value)
        assert f.viterbi(x).tolist() == best


def test_quality_keeps_prose_and_rejects_junk(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("aeioulnrst", k=5)) for _ in range(80)]  # enough that three-word windows hardly repeat
    prose = lambda: "\n".join(" ".join(rng.choices(words, k=12)).capitalize() + f" {rng.random()}." for _ in range(12))
    junk = lambda: "\n".join(" | ".join(f"x{rng.random()}" for _ in range(12)) + " |" for _ in range(12))
    rows = [(i, junk() if i % 4 == 0 else prose(), 1) for i in range(80)]
    docs = spark.createDataFrame([*rows, (None, None, 1), (90, "", 1)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(60)] + [(61, None, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.judge(docs, quality.train(docs, labels)).collect()}
    assert got == {**{i: i % 4 > 0 for i in range(80)}, None: False, 90: False}
    assert quality.judge(docs.limit(0), quality.train(docs.limit(0), labels.limit(0))).count() == 0


def test_quality_without_usable_labels_keeps_what_passes_the_base_rules(spark):
    rng = random.Random(8)
    prose = lambda: "\n".join(" ".join(f"w{rng.randrange(9999)}" for _ in range(12)) for _ in range(6))
    docs = spark.createDataFrame([(i, prose()) for i in range(6)] + [(6, "too short"), (7, None)], "doc_id long, text string")
    for labels in ([], [(1, None)], [(1, 0), (1, 1)], [(100, 0)], [(7, 0)]):
        model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = {r.doc_id: (r.content_share, r.kept) for r in quality.judge(docs, model).collect()}
        assert got == {**dict.fromkeys(range(6), (1.0, True)), 6: (1.0, False), 7: (0.0, False)}


def test_quality_sample_skips_labels_of_absent_documents(spark):
    docs = spark.createDataFrame([(i, "some words here\nand | there |") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(40)] + [(i, 1) for i in range(1000, 3000)], "doc_id long, quality int")
    model = quality.train(docs, labels, max_labelled=20)
    assert model.links.any()  # fitted
    assert {r.content_share for r in quality.judge(docs, model).collect()} == {0.0}  # every labelled text is boilerplate


def test_decontamination_at_the_threshold(spark):
    item = [f"t{k}" for k in range(39)]  # 35 shingles
    near = [*item[:32], *["other"] * 7]  # 28 of them: 0.8
    below = [*item[:31], *["other"] * 8]
    filler = " ".join(f"f{k}" for k in range(3000))
    docs = [(1, f"{filler} {' '.join(item).upper()} {filler}"), (2, " ".join(near)), (3, " ".join(below)), (4, None), (5, ""), (6, "One Two"), (None, " ".join(item)), (7, "one  two three"), (2, " ".join(near))]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, h int")
    b = spark.createDataFrame([(0, " ".join(item), 1), (1, "one two", 1), (2, None, 1), (3, " ", 1), (4, " ".join(item), 1)], "item_id long, text string, words int")
    got = {(r.doc_id, r.item_id) for r in decontam.contamination(d, b).collect()}
    assert got == {(1, 0), (2, 0), (6, 1), (1, 4), (2, 4)}
    assert sorted(str(r.doc_id) for r in decontam.decontaminate(d, b).collect()) == ["3", "4", "5", "7", "None"]
    assert decontam.contamination(d.limit(0), b).count() == 0 and decontam.contamination(d, b.limit(0)).count() == 0


def test_decontamination_stage_judges_rows_whatever_their_ids(spark, tmp_path):
    item, unnamed = [f"t{k}" for k in range(40)], [f"u{k}" for k in range(40)]
    halves = [" ".join([*item[:22], *["x"] * 9]), " ".join([*["y"] * 9, *item[18:]])]  # 18 of 36 shingles each, together all
    docs = [(None, " ".join(item)), (None, "clean by itself"), (1, " ".join(item)), (1, "a clean row of the same id"), *((2, h) for h in halves), (3, " ".join(unnamed)), (4, None), (5, "")]
    spark.createDataFrame([(0, " ".join(item)), (None, " ".join(unnamed)), (0, "other text of that id " * 9), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = pipeline.decontamination(spark, df, str(tmp_path))
    assert got.columns == df.columns
    assert Counter(map(tuple, got.collect())) == Counter([docs[k] for k in (1, 3, 4, 5, 7, 8)])


def test_fixity_audit_finds_each_damage(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i}" * (i % 5)) for i in range(2300)] + [(None, None, None), (None, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    damaged = spark.createDataFrame([(i, u, "<q>" + h[3:] if i in (3, 1007, 2299) else h) for i, u, h in rows], "page_id long, url string, html string")
    leaves = lambda p: warc.leaves(warc.archive_records(p))
    assert {r.page_id for r in warc.audit(leaves(pages), leaves(damaged)).collect()} == {3, 1007, 2299}
    assert warc.audit(leaves(pages), leaves(pages.repartition(5))).count() == 0
    short = warc.audit(leaves(pages), leaves(pages.where("page_id is null or page_id <> 2298"))).collect()
    assert {(r.seq, r.found is None) for r in short} == {(298, False), (299, True)}
    assert warc.audit(leaves(pages.limit(0)), leaves(pages.limit(0))).count() == 0


def test_url_rules(spark):
    rules = urlfilter.rule_table(spark, [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/")])
    cases = {
        "http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"), "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "x://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "http://a.org": ("a.org", "", None, "allow"), "http://a.org?x/": ("a.org", "", None, "allow"), "http://b.com/FR/": ("b.com", "/FR/", None, "allow"),
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/org/": ("", "", None, "allow"), "a://b.c.com/fr/" + "x" * 5000: ("b.c.com", "/fr/" + "x" * 5000, "com/fr/", "allow"),
    }
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate([*cases, *cases])], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.apply_rules(pages, rules).collect()}
    assert got == dict(enumerate([*cases.values(), *cases.values()]))
    assert urlfilter.apply_rules(pages.limit(0), rules).count() == 0


#: Names that the operators use for columns of their own.
CLASHING = ["_id", "_key", "_own_key", "_source", "own_source", "_url", "_verdict", "doc", "page", "digest", "first_id", "text_key", "fp", "fingerprint", "is_first", "best", "item_id", "row", "copy number", "a.b"]


def test_extra_columns_by_any_name_come_through(spark, tmp_path):
    text = "some clean words of a text that nothing else repeats at all"
    rows = [(1, text, "s", *CLASHING), (None, f"{text} but a little longer than it", None, *CLASHING), (2, "benchmark item words here in a row", "s", *CLASHING)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    df = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([(0, "benchmark item words here in a row")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    single = simhash.one_of_each(df)
    assert single.columns == df.columns and Counter(map(tuple, single.collect())) == Counter(rows)
    for clean in (decontam.decontaminate(df, bench, by_row=True), decontam.decontaminate(df, bench)):
        assert clean.columns == df.columns and Counter(map(tuple, clean.collect())) == Counter(rows[:2])
    mixed = mixing.mix(df).select(*(f"`{c}`" for c in df.columns)).distinct()
    assert set(map(tuple, mixed.collect())) <= set(rows)
    pages = df.withColumnsRenamed({"doc_id": "page_id", "text": "url"})
    judged = urlfilter.apply_rules(pages, urlfilter.rule_table(spark, [("block", "x.org", "/")]))
    assert Counter(map(tuple, judged.select(*(f"`{c}`" for c in pages.columns)).collect())) == Counter(rows)
    for name, stage in pipeline.STAGES[2:4]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns, name
