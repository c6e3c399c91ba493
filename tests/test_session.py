import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tunestrata import session as ss


def test_shared_paths_follow_the_session(spark):
    root = ss.shared_root(spark)
    first, second = ss.shared_path(spark, "x"), ss.shared_path(spark, "x")
    assert first != second and first.startswith(f"{root}/x-")
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert root == named.rstrip("/")


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ss.shared_root(Session())


def test_discard_keeps_to_the_shared_folder(spark):
    path = ss.shared_path(spark, "gone")
    spark.range(3).write.parquet(path)
    ss.discard(spark, path)
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)
    with pytest.raises(ValueError, match="not under"):
        ss.discard(spark, "/elsewhere/table")


def test_pin_keeps_random_draws(spark):
    df = ss.pin(spark.range(100).withColumn("x", F.rand()))
    assert df.collect() == df.collect()
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def test_held_lets_go(spark):
    df = spark.range(10)
    with ss.held(df) as cached:
        assert cached.is_cached and cached.count() == 10
    assert not df.is_cached


def test_partitions(spark):
    assert ss.cluster_slots(spark) == 8
    df = ss.spread(spark.range(1000), 5)
    assert ss.partition_sizes(df).count() == 5
    assert ss.spread(spark.range(1000)).rdd.getNumPartitions() == 32


def test_skew_settings(spark):
    ss.apply_skew_settings(spark)
    assert all(spark.conf.get(k) == v for k, v in ss.SKEW_SETTINGS.items())


def test_shuffle_size(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        assert ss.size_shuffles(spark) == 32
        assert ss.size_shuffles(spark, input_bytes=100 << 40) == 204_800
        assert spark.conf.get(key) == "204800"
    finally:
        spark.conf.unset(key)


def test_merged_partitions_stay_small(spark):
    """A task sorts a multiple of the compressed bytes it was dealt, so merging stops before Spark's 64 MB."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        assert spark.conf.get(key) == "67108864b"
        ss.apply_skew_settings(spark)
        assert spark.conf.get(key) == str(ss.MERGED_BYTES)
        spark.conf.set(key, "8m")
        ss.apply_skew_settings(spark)
        assert spark.conf.get(key) == "8m"
    finally:
        spark.conf.set(key, before)
