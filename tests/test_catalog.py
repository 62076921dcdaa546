"""Publishing by version."""

import pytest
from pyspark.sql import functions as F

from rekindle.operators import topk
from rekindle.sources import catalog


@pytest.fixture
def name(spark, tmp_path):
    made = f"published_{tmp_path.name.replace('-', '_')}".lower()
    yield made
    spark.sql(f"DROP VIEW IF EXISTS {made}")
    for v in catalog._versions(spark, made):
        spark.sql(f"DROP TABLE IF EXISTS {v}")


def broken(spark):
    return spark.range(100).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("torn"))).otherwise(F.col("id")).cast("bigint"))


def test_a_failed_write_leaves_the_old_table(spark, name):
    catalog.save_table(spark.range(5), name)
    reader = spark.table(name)
    with pytest.raises(Exception, match="torn"):
        catalog.save_table(broken(spark), name)
    assert reader.count() == spark.table(name).count() == 5 and len(catalog._versions(spark, name)) == 1


def test_readers_keep_their_version_until_it_expires(spark, name):
    catalog.save_table(spark.range(1), name)
    first = spark.table(name)
    assert catalog.save_table(spark.range(2).withColumn("more", F.lit(1)), name, partition_by=["more"]).count() == 2
    assert first.count() == 1 and spark.table(name).columns == ["id", "more"]
    for rows in (3, 4):
        catalog.save_table(spark.range(rows), name)
    assert spark.table(name).count() == 4 and len(catalog._versions(spark, name)) == 2
    assert sorted(spark.table(v).count() for v in catalog._versions(spark, name)) == [3, 4]
    catalog.save_table(spark.table(name).where("id > 0"), name, keep=1)  # from itself
    assert spark.table(name).count() == 3 and len(catalog._versions(spark, name)) == 1
    with pytest.raises(ValueError):
        catalog.save_table(spark.range(1), name, keep=0)


def test_matrix_versions(spark, tmp_path):
    path = f"{tmp_path}/matrix"
    with pytest.raises(ValueError):
        catalog.load_matrix(spark, path)
    catalog.save_matrix(spark.range(3), path)
    old = catalog.load_matrix(spark, path)
    with pytest.raises(Exception, match="torn"):
        catalog.save_matrix(broken(spark), path)
    assert catalog.load_matrix(spark, path).count() == 3
    catalog.save_matrix(old.union(old), path)
    assert (catalog.load_matrix(spark, path).count(), catalog.load_matrix(spark, path, 1).count(), old.count()) == (6, 3, 3)


def test_a_cap_evaluates_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def watched(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(1000, numPartitions=3).mapInArrow(watched, "id bigint")
    assert topk.take_by_hash(df, ["id"], 300).count() == 300
    assert seen.value == 1000
