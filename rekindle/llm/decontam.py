"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rekindle.llm.store import cut

WIDTH = 5
CONTAINMENT = 0.8


def _words(text: Column) -> Column:
    """Words of a text with A-Z in lower case."""
    lower = F.translate(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(lower) > 0, F.split(lower, " ", -1)).otherwise(F.array().cast("array<string>"))


def text_digest(text: Column) -> Column:
    """128 bits that stand for a text; null texts count as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _windows(width: int) -> str:
    """SQL of the word windows of `words`, as starting places; one window where there are fewer words, none without words."""
    return f"CASE WHEN size(words) = 0 THEN array() ELSE sequence(0, greatest(size(words) - {width}, 0)) END"


def _shingle_hashes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, h) of the distinct shingle hashes of each row of `docs` (doc_id, words)."""
    taken = ", ".join(f"get(words, i + {k})" for k in range(width))
    return docs.select("doc_id", F.explode(F.expr(f"array_distinct(transform({_windows(width)}, i -> xxhash64({taken})))")).alias("h"))


def _shingles(docs: DataFrame, key: str, width: int) -> DataFrame:
    """(key, shingle) of the distinct shingles themselves."""
    return docs.select(key, F.explode(F.expr(f"array_distinct(transform({_windows(width)}, i -> array_join(slice(words, i + 1, {width}), ' ')))")).alias("shingle"))


def item_sketches(items: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, n_shingles, size_class, h): the MinHash sketch of each item of `items` (item_id, words).

    Items are partitioned by shingle count in powers of two, and a class keeps as many of an item's smallest shingle hashes as its largest
    size needs: of n shingles a document must hold at least `containment` * n, so it can miss n - ceil(containment * n), and one of the
    smallest n - ceil(containment * n) + 1 is in it for certain, however long the document is. No true pair is lost, as it would be
    by comparing whole signatures of a short item and a long document.
    """
    hashed = _shingle_hashes(items.select(F.col("item_id").alias("doc_id"), "words"), width).withColumnRenamed("doc_id", "item_id")
    listed = hashed.groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("hs"))  # a test item's own shingles
    n = F.size("hs")
    top = F.pow(F.lit(2), F.ceil(F.log2(n))).cast("int")
    spare = top - F.ceil(F.lit(containment) * top).cast("int") + 1
    kept = listed.select("item_id", n.alias("n_shingles"), F.ceil(F.log2(n)).cast("int").alias("size_class"), F.slice("hs", 1, F.least(n, spare)).alias("hs"))
    return kept.select("item_id", "n_shingles", "size_class", F.explode("hs").alias("h"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of all pairs in which `docs` (doc_id, text) hold `benchmark` (item_id, text).

    A document holds an item if it has at least the share `containment` of the item's distinct `width`-word shingles (A-Z in lower case; words between
    ASCII white space; an item with fewer words is one shorter shingle, so only documents as short can hold it). Candidates meet in an equi-join of
    document shingle hashes with the items' sketches, and the shingles themselves decide.

    Null and blank texts hold nothing and are not held; null ids are left out, as a pair could not name them. Rows with an id in common are
    judged together. Items of equal text are each reported.
    """
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    own = texts.select("doc_id", _words(F.col("text")).alias("words"))
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", _words(F.col("text")).alias("words"))
    # Most items share no hash with one another; a hash on most documents meets each document once. Spark broadcasts the sketches
    # while their measured size is under its limit and splits large keys of the shuffled join beyond.
    sketches = item_sketches(items, width, containment)
    candidates = cut(_shingle_hashes(own, width).join(sketches.select("item_id", "h"), "h").select("doc_id", "item_id").distinct())
    # Ids first: only the texts of candidates are split into words again.
    near = texts.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", _words(F.col("text")).alias("words"))
    of_docs = _shingles(near, "doc_id", width).distinct()
    of_items = _shingles(items, "item_id", width).distinct()
    counts = of_items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shingles"))
    # Only the candidates' own items meet a document's shingles: item and document are both in the key.
    wanted = candidates.join(of_items, "item_id")
    shared = wanted.join(of_docs, ["doc_id", "shingle"]).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    found = shared.join(counts, "item_id").withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    return found.where(F.col("containment") >= containment).select("doc_id", "item_id", "n_shared", "n_shingles", "containment")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT, by_row: bool = False) -> DataFrame:
    """The rows of `docs` that hold no benchmark item; rows with a null id are kept.

    With `by_row` ids play no part: every row is judged by its own text, also one whose id is null or shared, and every text of
    `benchmark` is an item of its own.
    """
    if by_row:
        keyed = docs.select(F.struct("*").alias("doc")).select("doc", text_digest(F.col("doc.text")).alias("digest"))
        items = benchmark.select(text_digest(F.col("text")).alias("item_id"), "text")
        dirty = contamination(keyed.select(F.col("digest").alias("doc_id"), "doc.text"), items, width, containment).select(F.col("doc_id").alias("digest")).distinct()
        return keyed.join(dirty, "digest", "left_anti").select("doc.*")
    dirty = contamination(docs.select("doc_id", "text"), benchmark, width, containment).select(F.col("doc_id").alias("dirty_id")).distinct()
    return docs.join(dirty, docs["doc_id"] == dirty["dirty_id"], "left_anti")
