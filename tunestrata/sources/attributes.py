"""Schemas that come from a side file of ``name,type`` lines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type words the attribute files use.
TYPE_WORDS: dict[str, T.DataType] = {
    "NUMERIC": T.DoubleType(),
    "real": T.DoubleType(),
    "string": T.StringType(),
    "STRING": T.StringType(),
}

ATTRIBUTE_SCHEMA = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]
)


def read_attributes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``name, type`` rows, surrounding blanks removed.

    The file path comes along: rows of several files can be told apart, and within one
    file the order is that of the lines.
    """
    return spark.read.schema(ATTRIBUTE_SCHEMA).csv(path).select(
        F.trim("name").alias("name"),
        F.trim("type").alias("type"),
        F.input_file_name().alias("file"),
    )


def schema_from_attributes(
    attributes: DataFrame, mapping: Mapping[str, T.DataType] = TYPE_WORDS
) -> T.StructType:
    """The schema one attribute file describes.

    The rows are metadata, one per column of a table, and a schema lives on the driver,
    so they are collected. A type word without a mapping is an error, not a guess.
    """
    fields = []
    for row in attributes.select("name", "type").collect():
        if row["type"] not in mapping:
            raise ValueError(f"unknown type word {row['type']!r} for column {row['name']!r}")
        fields.append(T.StructField(row["name"], mapping[row["type"]], True))
    return T.StructType(fields)


def attribute_type_census(attributes: DataFrame) -> DataFrame:
    """Which type words occur, and how often."""
    return attributes.groupBy("type").agg(F.count(F.lit(1)).alias("n_columns"))
