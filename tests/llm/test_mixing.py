import pytest
from pyspark.sql import functions as F

from rekindle.llm.mixing import mix, repetitions, source_targets, word_count


def brute_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    """Give out shares by weight and take back what is over, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left = share * sum(sizes.values())
    for _ in range(1000):
        free = [s for s in order if target[s] < most * sizes[s]]
        if left < 1e-9 or not free:
            break
        total = sum(weight[s] for s in free)
        over = 0.0
        for s in free:
            target[s] += left * weight[s] / total
            if target[s] > most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
        left = over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, "d": 0, None: 7}, {"x": 5}, {"é": 50, "z": 3, "a": 900, "b": 20, "c": 1, "d": 300}, {"a": 0, "b": 0}])
def test_targets_equal_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_words(spark):
    texts = [None, "", " ", "  ", "a", " a", "a ", "a b\n c\t\x0bd\r\n", "a b", "\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(word_count(F.col("text"))).collect()] == [0, 0, 0, 0, 1, 1, 1, 4, 1, 0]


def test_copies_near_targets_and_reruns(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}" if i % 5 else None, 7) for i in range(4000)] + [(None, "x y", "s1", 7), (3, "w w w w", "s3", 7)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = repetitions(df).withColumn("taken", F.col("size") * F.col("copies"))
    sums = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert len(sums) == 5
    for r in sums:
        assert abs(r.taken - r.target) < 0.1 * r.target and r.most <= 2
    assert sorted(map(repr, got.collect())) == sorted(map(repr, repetitions(df.repartition(7)).withColumn("taken", F.col("size") * F.col("copies")).collect()))
    mixed = mix(df)
    assert mixed.columns == [*df.columns, "copy"] and mixed.count() == got.agg(F.sum("copies")).first()[0]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert repetitions(df).count() == 0 and mix(df).count() == 0
