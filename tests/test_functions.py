import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rekindle.functions import arrays, maps, text
from rekindle.functions.hashing import stable_hash, stable_unit
from rekindle.functions.special import student_two_sided


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def vec(*values):
    return F.array(*[F.lit(v).cast("double") for v in values])


def test_entropy(spark):
    assert one(spark, arrays.shannon_entropy(vec(0.5, 0.25, 0.25))) == 1.5
    assert one(spark, arrays.shannon_entropy(vec(1.0))) == 0.0
    assert one(spark, arrays.shannon_entropy(vec(0.5, 0.5, 0.0))) == 1.0
    assert one(spark, arrays.shannon_entropy(F.expr("cast(array() as array<double>)"))) == -1.0
    assert one(spark, arrays.shannon_entropy(F.expr("cast(null as array<double>)"))) == -1.0


def test_array_statistics_ignore_nulls(spark):
    values = F.expr("array(1D, null, 3D, 8D)")
    assert one(spark, arrays.array_mean(values)) == 4.0
    assert one(spark, arrays.array_var(values)) == pytest.approx(26 / 3)
    assert one(spark, arrays.array_percentile(values, 25)) == 2.0
    assert one(spark, arrays.array_percentile(values, 50)) == 3.0
    assert one(spark, arrays.array_percentile(values, 100)) == 8.0
    assert one(spark, arrays.array_percentile(F.expr("array(cast(null as double))"), 50)) == -1.0
    assert one(spark, arrays.array_percentile(F.expr("cast(null as array<double>)"), 50)) is None
    assert one(spark, arrays.array_mean(F.expr("cast(array() as array<double>)"))) is None


def test_l2_normalise(spark):
    assert one(spark, arrays.l2_normalise(vec(3, 4))) == pytest.approx([0.6, 0.8])
    assert all(math.isnan(v) for v in one(spark, arrays.l2_normalise(vec(0, 0))))
    assert one(spark, arrays.l2_normalise(F.expr("cast(array() as array<double>)"))) is None


def test_ratio_and_poisson(spark):
    assert one(spark, arrays.score_ratio(F.lit(2.0), F.lit(5.0))) == 2.5
    assert one(spark, arrays.score_ratio(F.lit(0.0), F.lit(5.0))) == 0.0
    assert one(spark, arrays.score_ratio(F.lit(None).cast("double"), F.lit(5.0))) is None
    assert one(spark, arrays.poisson_once(F.lit(2.0))) == pytest.approx(2 * math.exp(-2))
    assert one(spark, arrays.poisson_once(F.lit(None).cast("double"))) == 0.0


def test_tokens(spark):
    assert one(spark, text.tokens(F.lit("  Home & Garden: Été-lamp "))) == ["home", "garden", "été", "lamp"]
    assert one(spark, text.tokens(F.lit("Ab-c a"), "char")) == ["a", "b", "c", "a"]
    assert one(spark, text.tokens(F.lit("?!"))) == []
    assert one(spark, text.tokens(F.lit(""))) == []
    with pytest.raises(ValueError):
        text.tokens(F.lit("x"), "line")


def test_pair_similarity(spark):
    def both(a, b):
        left, right = text.tokens(F.lit(a)), text.tokens(F.lit(b))
        return one(spark, text.cosine_counts(left, right)), one(spark, text.jaccard_sets(left, right))

    assert both("red ring", "Red Ring") == pytest.approx((1.0, 1.0))
    assert both("red red ring", "red hat") == pytest.approx((2 / (math.sqrt(5) * math.sqrt(2)), 1 / 3))
    assert both("red", "blue") == (0.0, 0.0)
    assert both("?", "red") == (0.0, 0.0)


def test_category_path(spark):
    assert one(spark, text.category_path(F.lit("a:b:c"))) == "a / b / c"


def test_merge_maps_last_wins(spark):
    merged = maps.merge_maps(F.expr("array(map('a','1'), map('b','2'), map('a','3'))"))
    assert one(spark, merged) == {"a": "3", "b": "2"}


def test_hash_is_stable(spark):
    h = one(spark, stable_hash(F.lit(7), F.lit("x")))
    import hashlib

    assert h == int(hashlib.md5(b"42|7|x").hexdigest()[:12], 16)
    spread = spark.range(4000).select(stable_unit("id").alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(spread[0] - 0.5) < 0.03 and 0 <= spread[1] and spread[2] < 1


def tail_by_integration(t, freedom, steps=200_000):
    """Share of cos(w)^(freedom - 1) beyond atan(|t| / sqrt(freedom)), by the midpoint rule."""
    end = math.pi / 2
    begin = math.atan(abs(t) / math.sqrt(freedom))

    def area(a):
        width = (min(end, a + 60 / math.sqrt(freedom)) - a) / steps
        w = a + (np.arange(steps) + 0.5) * width
        return float(np.exp((freedom - 1) * np.log(np.cos(w))).sum() * width)

    return area(begin) / area(0.0)


def test_student_tail(spark):
    rows = [(t, f) for f in (1, 2, 3, 10, 57, 1000, 10**6) for t in (0.0, 1e-6, 0.3, -1.0, 1.96, 2.0, 7.5, 30.0)]
    df = spark.createDataFrame([(float(t), float(f)) for t, f in rows] + [(None, 3.0), (1.0, 0.0), (1.0, None), (1.96, 1e10), (6.0, 3e9)], "t double, f double")
    out = [r.p for r in df.select(student_two_sided(F.col("t"), F.col("f")).alias("p")).collect()]
    for (t, f), p in zip(rows, out):
        assert p == pytest.approx(tail_by_integration(t, f), rel=1e-5, abs=1e-300), (t, f)
    assert out[len(rows) : len(rows) + 3] == [None, None, None]
    assert out[-2:] == [pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-6) for t in (1.96, 6.0)]
