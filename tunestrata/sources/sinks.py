"""Writers: Parquet intermediates, CSV exports, fitted models."""

from __future__ import annotations

from pyspark.ml.util import JavaMLReadable, JavaMLWritable
from pyspark.sql import DataFrame


def checkpoint(df: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    """Write a Parquet intermediate and go on from the written table; ``codec`` in place of the session's."""
    df.write.mode("overwrite").parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with a header, written by the executors."""
    df.write.mode("overwrite").csv(path, header=True)


def save_model(model: JavaMLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind: type[JavaMLReadable], path: str):
    """Read a model back with the class that wrote it, e.g. ``LogisticRegressionModel``."""
    return kind.load(path)
