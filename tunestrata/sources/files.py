"""Delimited text, Parquet and raw line sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ","
) -> DataFrame:
    """Headerless delimited text with a known schema; compression follows the extension.

    A gzip file cannot be split, so each one is a single task. Many files read in
    parallel; a few large ones are best written once with ``sinks.checkpoint`` and read
    as Parquet afterwards.
    """
    return spark.read.schema(schema).csv(path, sep=sep, header=False)


def read_inferred(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV with a header. Types are inferred (one more pass) unless a schema is given."""
    if schema is not None:
        return spark.read.schema(schema).csv(path, header=True)
    return spark.read.csv(path, header=True, inferSchema=True)


def read_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return spark.read.parquet(*paths)


def line_count(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n_lines"))


def preview(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows; with an order given, always the same ones."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def storage_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files and bytes per folder under ``root``. Only the listing is read, no content."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ).select("path", "length")
    return (
        listing.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"))
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
    )
