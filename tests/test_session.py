"""Where stored steps go."""

from types import SimpleNamespace

import pytest

from rekindle.session import shared_folder


def _session(master: str, folder: str | None):
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda key, default: folder))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_cluster_without_shared_folder_is_refused(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(_session(master, None))
    assert shared_folder(_session(master, "hdfs://store/ckpt/")).startswith("hdfs://store/ckpt/rekindle-")


@pytest.mark.parametrize("master", ["local", "local[8]"])
def test_local_session_gets_a_folder(master):
    assert shared_folder(_session(master, None))


def test_a_stored_step_leaves_no_shuffle_files(spark):
    import glob
    import time

    from rekindle.session import cut_lineage

    dirs = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}

    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    kept = cut_lineage(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert kept.count() == 7 and spark.conf.get(key) == setting
