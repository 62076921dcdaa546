"""Fixity audit of web archives with Merkle trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rekindle.llm.store import cut

FAN_OUT = 16
PER_FILE = 1000


def archive_records(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """WARC resource records of `pages` (page_id, url, html) laid out in files.

    Returns file, seq (place in the file), page_id, record_offset, record_length, record (the text) and digest (its SHA-256). A file holds `per_file`
    consecutive ids in their order, equal ids ordered by content. Null url and html are empty; null ids share one file of their own,
    numbered -1, ordered by content.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return _laid_out(pages.select("page_id", F.concat(head, html, F.lit("\r\n\r\n")).alias("record")), per_file)


def _laid_out(rows: DataFrame, per_file: int) -> DataFrame:
    """`rows` (page_id, record) with their file and place in it. Hashes and lengths are taken before the rows move."""
    rows = rows.withColumn("file", F.coalesce(F.floor(F.col("page_id") / F.lit(per_file)), F.lit(-1)).cast("long"))
    rows = rows.withColumn("digest", F.sha2("record", 256)).withColumn("record_length", F.octet_length("record").cast("long"))
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    rows = rows.withColumn("seq", (F.row_number().over(order) - 1).cast("long"))
    return rows.withColumn("record_offset", F.sum("record_length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("record_length"))


def leaves(records: DataFrame) -> DataFrame:
    """A leaf for each record of `archive_records`: its range of the file and the hash of its bytes. The records themselves are not shuffled for it."""
    return records.select("file", "seq", "page_id", "record_offset", "record_length", "digest")


def _parent(children: DataFrame, keys: list[Column], parts: list[str]) -> DataFrame:
    """Nodes over up to FAN_OUT children each; a node hashes its children's numbers, ranges and hashes in order."""
    listed = F.array_sort(F.collect_list(F.struct("number", *parts, "digest")))
    text = F.transform(listed, lambda x: F.concat_ws(":", *[x[p].cast("string") for p in ("number", *parts, "digest")]))
    agg = [F.sha2(F.concat_ws(",", text), 256).alias("digest")]
    if parts:
        agg += [F.min("from_byte").alias("from_byte"), F.max("to_byte").alias("to_byte")]
    return children.groupBy("replica", *keys).agg(*agg)


def tree(own_leaves: DataFrame, record_levels: int, file_levels: int) -> list[DataFrame]:
    """Levels of nodes (replica, file, number, digest) from the records up to the archive's root, for all replicas of `own_leaves` at once.

    Up to level `record_levels` nodes cover offset ranges within a file, the last one the whole file; above they cover ranges of
    files. A group never holds more than FAN_OUT nodes, whatever the size of files or archive. Each level above the records is stored, a sixteenth
    of the one below, so that no level hashes those below it again.
    """
    ends = (F.col("record_offset") + F.col("record_length")).alias("to_byte")
    level = own_leaves.select("replica", "file", F.col("seq").alias("number"), F.col("record_offset").alias("from_byte"), ends, "digest")
    out = [own_leaves.withColumnRenamed("seq", "number")]
    up = F.floor(F.col("number") / F.lit(FAN_OUT)).cast("long")
    for k in range(record_levels):
        level = _parent(level, [F.col("file"), up.alias("number")], ["from_byte", "to_byte"])
        if k == record_levels - 1:
            level = level.select("replica", F.lit(0).cast("long").alias("file"), F.col("file").alias("number"), "digest")
        level = cut(level)
        out.append(level)
    for _ in range(file_levels):
        level = cut(_parent(level, [F.col("file"), up.alias("number")], []))
        out.append(level)
    return out


def _depth(most: int) -> int:
    """Levels over the numbers 0 to `most` until one node is left."""
    levels = 0
    while most > 0:
        most //= FAN_OUT
        levels += 1
    return levels


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records in which two replicas differ, both given as `leaves`.

    Both trees are built and their roots compared; from each level only children of mismatching nodes are compared, so a sound archive
    ends at the root and damage costs its branches. Returns file, seq, page_id, record_offset, record_length, expected and found (hashes; null where one
    side has no such record). A lost or added record moves the offsets behind it, so the rest of its file is reported too.
    Two empty archives do not differ.
    """
    sides = [x.select("file", "seq", "page_id", "record_offset", "record_length", "digest", F.lit(side).alias("replica")) for side, x in enumerate((primary, replica))]
    stored = cut(sides[0].unionByName(sides[1]))
    sizes = stored.agg(F.max("seq"), F.max("file"), F.min("file")).first()
    if sizes[0] is None:
        record_levels, file_levels = 1, 1
    else:
        record_levels, file_levels = max(1, _depth(sizes[0])), max(1, _depth(sizes[1])) + (1 if sizes[2] < 0 else 0)
    levels = tree(stored, record_levels, file_levels)
    up = F.floor(F.col("number") / F.lit(FAN_OUT)).cast("long")
    hashes = [F.max(F.when(F.col("replica") == side, F.col("digest"))).alias(name) for side, name in enumerate(("expected", "found"))]
    wrong = None
    for k in range(record_levels + file_levels, -1, -1):
        nodes = levels[k]
        if wrong is not None:
            # At the level of whole files a node's number is the file's; below, records are numbered within their file.
            if k == record_levels - 1:
                inside = wrong.select(F.col("number").alias("file"), F.lit(0).cast("long").alias("parent"))
            else:
                inside = wrong.select("file", F.col("number").alias("parent"))
            nodes = nodes.withColumn("parent", up).join(inside, ["file", "parent"], "left_semi")
        place = [] if k else [F.min(c).alias(c) for c in ("page_id", "record_offset", "record_length")]
        wrong = cut(nodes.groupBy("file", "number").agg(*place, *hashes).where(~F.col("expected").eqNullSafe(F.col("found"))))
    return wrong.select("file", F.col("number").alias("seq"), "page_id", "record_offset", "record_length", "expected", "found")
