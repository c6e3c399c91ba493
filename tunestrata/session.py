"""Session helpers: shared storage, lineage cuts, partition counts, cluster shape."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Adaptive execution splits a join partition that holds a hot key. By default it leaves
# the split out where a later grouping would then need a shuffle of its own; one more
# shuffle of the joined rows is far cheaper than one task that holds a third of them.
SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Bytes that adaptive execution merges shuffle partitions up to. Shuffled bytes are compressed, the rows a
# task sorts are not: at Spark's 64 MB a task that ranks short rows sorts over a GB.
MERGED_BYTES = 8 << 20
_MERGED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def apply_skew_settings(spark: SparkSession) -> SparkSession:
    for key, value in SKEW_SETTINGS.items():
        spark.conf.set(key, value)
    limit_merging(spark)
    return spark


def limit_merging(spark: SparkSession, merged_bytes: int = MERGED_BYTES) -> None:
    """Merge shuffle partitions up to ``merged_bytes`` only, so that a growing input gets more of them before
    they get larger; a smaller size that was set stays."""
    said = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_MERGED))
    if said > merged_bytes:
        spark.conf.set(_MERGED, str(merged_bytes))


def use_local_scratch(spark: SparkSession) -> SparkSession:
    """Give a local session without a shared folder a temporary one. For tests and benches.

    A local session's executors are the driver, so they share its disk; any other session has to
    name a folder in ``spark.checkpoint.dir``.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and spark.sparkContext.master.split("[")[0] == "local":
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tunestrata-"))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path for one run's table; never handed out twice."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove tables that nothing reads any more; only what lies under the shared folder."""
    hadoop, root = spark.sparkContext._jvm.org.apache.hadoop.fs, shared_root(spark)
    for path in paths:
        if not path.startswith(f"{root}/"):
            raise ValueError(f"{path} is not under {root}")
        place = hadoop.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def settle(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nothing refers to any more.

    Its cleaner only learns of them from a garbage collection on the driver, which may be half an
    hour away; a job that stores large intermediates calls this once it has gone on from one. The
    first collection finds what Python has let go, the second what only that still referred to.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage.

    Needed wherever a value depends on how rows were laid out (partition numbers, random
    draws): after a lost executor the rows are read back, not drawn again.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


@contextmanager
def held(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Cache a frame that an iterative step reads many times, and let it go afterwards."""
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()


def cluster_slots(spark: SparkSession) -> int:
    """Tasks the cluster can run at once (executors x cores)."""
    return spark.sparkContext.defaultParallelism


def size_shuffles(
    spark: SparkSession,
    input_bytes: int | None = None,
    per_slot: int = 4,
    partition_bytes: int = 512 << 20,
) -> int:
    """Set how many partitions a shuffle has before adaptive execution merges small ones.

    Merging works in one direction only, so this has to suit the largest shuffle: a few
    tasks per slot, and partitions that fit into memory for the given input.
    """
    partitions = per_slot * cluster_slots(spark)
    if input_bytes is not None:
        partitions = max(partitions, -(-input_bytes // partition_bytes))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
    return partitions


def spread(df: DataFrame, partitions: int | None = None, per_slot: int = 4) -> DataFrame:
    """Repartition a training input; a multiple of the task slots unless told otherwise."""
    return df.repartition(partitions or per_slot * cluster_slots(df.sparkSession))


def partition_sizes(df: DataFrame) -> DataFrame:
    """Rows per partition, so that both the partition count and any skew can be seen."""
    return df.groupBy(F.spark_partition_id().alias("partition_id")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
