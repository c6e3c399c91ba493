"""A content-addressed ledger: what has been worked out about a content is kept under its digest."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunestrata.llm.common import written
from tunestrata.operators.joins import per_key


class Ledger:
    """A Parquet table that is only added to.

    Each ``append`` is a folder of its own under a name never given twice, written by Spark's commit
    protocol: a lost executor repeats its tasks, a run that dies leaves no part of its rows behind,
    and runs that write at the same time add to the ledger side by side. A ledger reads what was
    there when it was opened and what it added itself.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self.parts: list[str] = []
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(files):
            found = sorted(s.getPath().getName() for s in system.listStatus(files))
            self.parts = [
                f"{path}/{name}"
                for name in found
                if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS"))
            ]

    def read(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.parts)

    def append(self, rows: DataFrame) -> None:
        part = f"{self.path}/part-{uuid.uuid4().hex}"
        rows.write.parquet(part)
        self.parts.append(part)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest`` of every row, stored: the SHA-256 of the text's bytes."""
    return written(docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")


def unseen(docs: DataFrame, paths: DataFrame, ledger: DataFrame, version: str) -> DataFrame:
    """``digest, text`` once for every content that the ledger lacks under this version.

    ``docs`` has ``doc_id, text``, ``paths`` the stored digests. One row stands for all copies of
    a content: the one with the smallest id. Grouping and anti-join only move digests; texts move
    once, by digest and id, so a content that a third of all rows share is no hot key. Rows that
    repeat both id and text come out as often as they occur; readers of a ledger fold by digest.
    """
    first = per_key(paths, ["digest"], F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first"))
    known = ledger.where(F.col("version") == version).select("digest")
    wanted = first.join(known, "digest", "left_anti").select("digest", F.col("first.doc_id").alias("doc_id"))
    texts = docs.withColumn("digest", F.unhex(F.sha2("text", 256)))
    same = (texts["digest"] == wanted["digest"]) & texts["doc_id"].eqNullSafe(wanted["doc_id"])
    picked = texts.join(wanted.hint("shuffle_hash"), same, "left_semi")
    return picked.select("digest", "text")


def paths_with(paths: DataFrame, stored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every row of ``paths`` (``doc_id, digest``) with what is stored under its digest.

    A digest that is stored twice, by two runs at a time, counts once; one that is not raises.
    """
    known = per_key(stored, ["digest"], F.first(F.struct(*columns)).alias("known"))
    lost = F.raise_error(F.concat(F.lit("not in the ledger: "), F.hex("digest")))
    kept = F.when(F.col("known").isNull(), lost).otherwise(F.col("known"))
    return paths.join(known, "digest", "left").withColumn("known", kept).select("doc_id", "digest", "known.*")
