"""Numeric array and scalar expressions; all of them run inside the JVM.

Nulls inside an array are ignored, an empty or null array gives null unless the
function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def _total(values: Column, f=lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + f(v.cast("double")))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, not once per element inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shannon_entropy(proportions: Column) -> Column:
    """Entropy in bits, rounded to 4 places; -1 for a null or empty array."""
    bits = _total(_present(proportions), lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    empty = proportions.isNull() | (F.size(proportions) == 0)
    return F.when(empty, F.lit(-1.0)).otherwise(F.round(F.abs(bits), 4))


def array_mean(values: Column) -> Column:
    kept = _present(values)
    return F.when(F.size(kept) > 0, _total(kept) / F.size(kept))


def array_var(values: Column) -> Column:
    """Population variance."""
    kept = _present(values)
    squares = _bound(array_mean(values), lambda mean: _total(kept, lambda v: (v - mean) * (v - mean)))
    return F.when(F.size(kept) > 0, squares / F.size(kept))


def array_percentile(values: Column, percent: float) -> Column:
    """Linear interpolation between the closest ranks; -1 when only nulls are left."""
    kept = F.array_sort(_present(values))
    position = (F.size(kept) - 1) * F.lit(percent / 100.0)
    low = F.floor(position).cast("int")
    high = F.ceil(position).cast("int")
    low_value = F.get(kept, low).cast("double")
    high_value = F.get(kept, high).cast("double")
    interpolated = low_value + (high_value - low_value) * (position - low)
    return (
        F.when(values.isNull() | (F.size(values) == 0), F.lit(None).cast("double"))
        .when(F.size(kept) == 0, F.lit(-1.0))
        .otherwise(interpolated)
    )


def l2_normalise(values: Column) -> Column:
    """Vector divided by its Euclidean norm; a zero vector gives NaN elements."""
    scaled = _bound(
        F.sqrt(_total(values, lambda v: v * v)),
        lambda norm: F.transform(values, lambda v: F.when(norm > 0, v.cast("double") / norm).otherwise(F.lit(float("nan")))),
    )
    return F.when(F.size(values) > 0, scaled)


def score_ratio(smallest: Column, largest: Column) -> Column:
    """largest / smallest; 0 when the smallest is not positive, null when either is null."""
    return F.when(smallest.isNull() | largest.isNull(), F.lit(None).cast("double")).otherwise(
        F.when(smallest > 0, largest / smallest).otherwise(0.0)
    )


def poisson_once(mean: Column) -> Column:
    """Poisson probability of exactly one event; 0 for a null mean."""
    return F.coalesce(mean * F.exp(-mean), F.lit(0.0))


def array_min_max(values: Column) -> tuple[Column, Column]:
    return F.array_min(values), F.array_max(values)
