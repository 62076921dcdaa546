"""The registered queries of this package, each next to its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rekindle.llm import decontam, hpylm, linededup, mixing, periodic, quality, resample, simhash, substring, suffixdedup, tokens, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_simhash_near_dedup")
def op1(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


@query(
    "op2_line_dedup",
    """WITH l AS (SELECT doc_id, lines, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, pos, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS win FROM l),
c AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM w WHERE win IS NOT NULL),
g AS (SELECT l.doc_id, l.pos, l.line, max(coalesce(a.nth, 1)) > 1 OR max(coalesce(b.nth, 1)) > 1 AS gone
    FROM l LEFT JOIN c a ON a.doc_id = l.doc_id AND a.pos = l.pos LEFT JOIN c b ON b.doc_id = l.doc_id AND b.pos = l.pos - 1 GROUP BY ALL),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM g)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_runs,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM r GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, 0, NULL FROM documents WHERE text IS NULL""",
)
def op2(spark, folder):
    out = linededup.remove_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


@query("op3_quality_rules")
def op3(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(documents, table(spark, folder, "labels"))
    return quality.judge(documents, model).select("doc_id", *quality.MADE)


@query("op4_suffix_array_dedup")
def op4(spark, folder):
    out = suffixdedup.remove_repeated_bytes(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op5_hpylm_scores")
def op5(spark, folder):
    out = hpylm.scores(table(spark, folder, "documents"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(
    "op6_benchmark_decontamination",
    r"""WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
bp AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0),
dp AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM bp),
ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM dp) WHERE s IN (SELECT s FROM bs)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment FROM p JOIN n USING (item_id) WHERE n_shared / n_shingles >= 0.8::DOUBLE""",
)
def op6(spark, folder):
    return decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: Record text of a page, and whether the second replica has it damaged.
_RECORD = """'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce({html}, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce({html}, '') || chr(13) || chr(10) || chr(13) || chr(10)"""


@query(
    "op7_warc_fixity_audit",
    f"""WITH r AS (
    SELECT page_id, page_id // 1000 AS file, {_RECORD.format(html="html")} AS record,
        {_RECORD.format(html="'#' || substr(html, 2)")} AS damaged, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) = '00' AND length(html) > 0 AS hit FROM pages),
l AS (SELECT *, row_number() OVER w - 1 AS seq, CAST(sum(strlen(record)) OVER w AS BIGINT) - strlen(record) AS record_offset FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id))
SELECT file, seq, page_id, record_offset, strlen(record) AS record_length, sha256(record) AS expected, sha256(damaged) AS found FROM l WHERE hit AND record <> damaged""",
)
def op7(spark, folder):
    """The second replica is the same archive after one byte of about every 256th record was overwritten."""
    pages = table(spark, folder, "pages")
    hit = (F.substring(F.md5(F.col("page_id").cast("string")), 1, 2) == "00") & (F.length("html") > 0)
    damaged = pages.withColumn("html", F.when(hit, F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    return warc.audit(warc.leaves(warc.archive_records(pages)), warc.leaves(warc.archive_records(damaged)))


@query(
    "op8_mix_sources",
    r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
f AS (SELECT *, source_size * 2.0::DOUBLE AS ceiling, source_size * 2.0::DOUBLE / weight AS full_at FROM w),
v AS (SELECT *, ((SELECT sum(source_size) FROM f) * 1.5::DOUBLE - coalesce(sum(ceiling) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN full_at < (SELECT max(level) FROM v WHERE level <= full_at) THEN ceiling ELSE weight * (SELECT max(level) FROM v WHERE level <= full_at) END AS target FROM v),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix:' || d.doc_id), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r""",
)
def op8(spark, folder):
    counted = mixing.repetitions(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)


@query(
    "op9_url_filter",
    rf"""WITH p AS (SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM p),
x AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT x.page_id, max({{'n': length(r.host) + length(r.path), 'h': length(r.host), 'verdict': r.verdict, 'rule': r.host || r.path}}) AS best
    FROM x JOIN (VALUES {_RULES_SQL}) r(verdict, host, path) ON (x.host = r.host OR ends_with(x.host, '.' || r.host)) AND starts_with(x.path, r.path) GROUP BY x.page_id)
SELECT x.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM x LEFT JOIN m USING (page_id)""",
)
def op9(spark, folder):
    judged = urlfilter.apply_rules(table(spark, folder, "pages").select("page_id", "url"), urlfilter.rule_table(spark, RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op10_substring_dedup")
def op10(spark, folder):
    out = substring.remove_repeated_words(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document by the checksum of its id, from some word on, goes on repeating a few of its words."""
    checked = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.expr(r"CASE WHEN h % 10 = 0 THEN regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0) END")
    split = checked.withColumn("words", words).withColumns({"n": F.size("words"), "g": F.expr("h div 10")})
    placed = split.withColumns({"a": F.expr("CASE WHEN n > 0 THEN cast(g % n as int) END")}).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    planted = F.expr("concat_ws(' ', slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast((n - a + p - 1) div p as int))), 1, n - a))")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark, folder):
    out = periodic.collapse_runs(with_planted_runs(table(spark, folder, "documents")))
    by_exponent = "(l, r) -> CASE WHEN l.length * r.period <> r.length * l.period THEN CASE WHEN l.length * r.period > r.length * l.period THEN -1 ELSE 1 END WHEN l.start <> r.start THEN CASE WHEN l.start < r.start THEN -1 ELSE 1 END ELSE CASE WHEN l.period < r.period THEN -1 WHEN l.period > r.period THEN 1 ELSE 0 END END"
    best = out.withColumn("best", F.expr(f"get(array_sort(runs, {by_exponent}), 0)"))
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op12_importance_resampling",
    f"""WITH c AS (SELECT i, list_reduce([i] || range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)),
tab AS (SELECT list(v ORDER BY i) AS tab FROM c),
d AS (SELECT doc_id, {_WORDS_SQL} AS words FROM documents),
dw AS (SELECT doc_id, unnest(words) AS w FROM d),
bw AS (SELECT unnest({_WORDS_SQL}) AS w FROM benchmark),
code AS (SELECT w, xor(list_reduce([4294967295] || list_transform(range(strlen(w)), lambda k: CAST('0x' || substr(hex(w), 2 * k + 1, 2) AS BIGINT)), lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)), tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN code USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN code USING (w) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM dw) + 10000 AS s_all, (SELECT count(*) FROM bw) + 10000 AS t_all),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * s_all / ((coalesce(s, 0) + 1)::DOUBLE * t_all))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket), n),
f AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN code USING (w) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM x WHERE n_features >= 20)
SELECT x.*, CASE WHEN rank <= 10 * able // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)""",
)
def op12(spark, folder):
    out = resample.judged(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_token_counts")
def op13(spark, folder):
    return tokens.token_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)
