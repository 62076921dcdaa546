"""URL filters by hashed host suffixes and path prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, with A-Z in lower case; empty without ://."""
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, *LETTERS), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) of each rule from plain values."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def apply_rules(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """Every row of `pages` (page_id, url) with host, path, rule and verdict.

    `rules` (verdict, host, path) fit their host and all its subdomains where the path of the url starts with theirs. The
    longest rule (host and path together) wins, then the one with the longer host; between equal rules a block wins. A page that no
    rule fits, as one with a null url or without ://, has a null rule and the verdict `otherwise`. Columns of `pages` by the names of results are replaced.

    Each url is expanded into its host suffixes, and those into the path prefixes of the lengths that rules of the same host
    have; each expression meets the rules in an equi-join on 32 bits of its SHA-256, and the full digests decide. Only
    expressions of hosts that have rules reach the second step, so long paths of other hosts cost nothing. Urls that occur
    on several pages are judged once, and a host on most pages once for each distinct host.
    """
    url = F.col("url")
    judged = pages.select(url).where(url.isNotNull()).distinct().withColumn("host", host_of(url)).withColumn("path", path_of(url))
    judged = judged.where(F.col("host") != "")
    short = lambda digest: F.substring(digest, 1, 8)

    own = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"
    own = own.select("verdict", F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.sha2("host", 256).alias("host_digest"), F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("full_digest"))
    lengths = own.groupBy("host_digest").agg(F.collect_set(F.length("r_path")).alias("lengths"))

    # Suffixes of each distinct host that some rule names.
    parts = F.split("host", r"\.")
    suffix = F.expr("explode(transform(sequence(1, size(parts)), i -> array_join(slice(parts, i, size(parts)), '.')))")
    suffixes = judged.select("host").distinct().withColumn("parts", parts).select("host", suffix.alias("suffix")).withColumn("digest", F.sha2("suffix", 256))
    known = suffixes.join(lengths, short(F.col("digest")) == short(F.col("host_digest"))).where(F.col("digest") == F.col("host_digest"))

    # Prefixes of the paths of those hosts, by the lengths that occur.
    expanded = judged.join(known.select("host", "suffix", "lengths"), "host").select("url", "suffix", "path", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("path"))
    expanded = expanded.withColumn("prefix", F.expr("substring(path, 1, n)")).withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256))
    hits = expanded.join(own, short(F.col("digest")) == short(F.col("full_digest"))).where(F.col("digest") == F.col("full_digest"))
    precedence = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("verdict"), F.concat("r_host", "r_path").alias("rule"))
    best = hits.groupBy("url").agg(F.max(precedence).alias("best"))

    whole = pages.drop("host", "path", "rule", "verdict").select(F.struct("*").alias("page"))  # so that no column can clash
    out = whole.join(best, F.col("page.url") == F.col("url"), "left")
    own = F.col("page.url")
    return out.select("page.*", host_of(own).alias("host"), path_of(own).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
