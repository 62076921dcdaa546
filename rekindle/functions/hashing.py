"""Engine-independent hashing for reproducible sampling, splitting and salting.

``md5`` gives the same answer in any engine and after any task retry, unlike
``rand()`` or ``DataFrame.sample``, whose rows depend on the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 48


def stable_hash(*keys: str | Column, seed: int = 42) -> Column:
    """48-bit non-negative integer from the keys."""
    parts = [F.lit(str(seed))]
    parts += [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def stable_unit(*keys: str | Column, seed: int = 42) -> Column:
    """Uniform number in [0, 1) from the keys."""
    return stable_hash(*keys, seed=seed) / F.lit(float(2**HASH_BITS))


def salt(n: int, *cols: str | Column) -> Column:
    """Deterministic salt in [0, n): a retried task produces the same one."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
