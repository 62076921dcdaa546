"""Text expressions: tokens, token-count cosine, token-set Jaccard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_WORD = r"(?U)\W+"  # fixed value; (?U) makes \W Unicode-aware


def tokens(text: Column, granularity: str = "word") -> Column:
    """Lower-case tokens in text order.

    ``word`` splits at runs of non-word characters; ``char`` yields every word
    character on its own.
    """
    if granularity == "word":
        pieces = F.split(F.lower(F.regexp_replace(text, NON_WORD, " ")), " ")
    elif granularity == "char":
        pieces = F.split(F.lower(F.regexp_replace(text, NON_WORD, "")), "")
    else:
        raise ValueError(f"unknown granularity {granularity!r}")
    return F.filter(pieces, lambda t: t != "")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is made once per row however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_counts(words: Column) -> Column:
    """array<struct<token, n>> with one entry per distinct token, sorted by token: lengths of the stretches of the sorted tokens."""

    def stretches(s: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return _bound(opens, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("bigint").alias("n"))))

    none = F.array().cast("array<struct<token:string,n:bigint>>")
    return F.when(F.size(words) == 0, none).when(words.isNotNull(), _bound(F.array_sort(words), stretches))


def squared_norm(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, c: acc + c["n"] * c["n"])


def cosine_counts(left: Column, right: Column) -> Column:
    """Cosine of two token-count vectors; 0 when one of them has no tokens.

    Counts are made once per row. The dot product needs no search: of the squared counts of both
    texts put together, what is more than those of each is twice the dot product.
    """
    sides = F.struct(squared_norm(token_counts(left)).alias("left"), squared_norm(token_counts(right)).alias("right"), squared_norm(token_counts(F.concat(left, right))).alias("both"))

    def cosine(s: Column) -> Column:
        norm = F.sqrt(s["left"].cast("double")) * F.sqrt(s["right"].cast("double"))
        return F.when(norm > 0, (s["both"] - s["left"] - s["right"]) / 2 / norm).otherwise(0.0)

    return _bound(sides, cosine)


def jaccard_sets(left: Column, right: Column) -> Column:
    """Shared distinct tokens over all distinct tokens; 0 when either side is empty or null."""
    usable = (F.size(left) > 0) & (F.size(right) > 0)
    shared = F.size(F.array_intersect(left, right))
    return F.when(usable, shared / F.size(F.array_union(left, right))).otherwise(0.0)


def category_path(name: Column) -> Column:
    """Readable category path: ``a:b`` becomes ``a / b``."""
    return F.regexp_replace(name, ":", " / ")
