"""Logical dataset names and where their files lie."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tunestrata.sources.attributes import read_attributes, schema_from_attributes
from tunestrata.sources.files import read_delimited

# The published names of the thirteen audio feature sets.
AUDIO_FEATURE_SETS = (
    "msd-jmir-area-of-moments-all-v1.0",
    "msd-jmir-lpc-all-v1.0",
    "msd-jmir-methods-of-moments-all-v1.0",
    "msd-jmir-mfcc-all-v1.0",
    "msd-jmir-spectral-all-all-v1.0",
    "msd-jmir-spectral-derivatives-all-all-v1.0",
    "msd-marsyas-timbral-v1.0",
    "msd-mvd-v1.0",
    "msd-rh-v1.0",
    "msd-rp-v1.0",
    "msd-ssd-v1.0",
    "msd-trh-v1.0",
    "msd-tssd-v1.0",
)


@dataclass(frozen=True)
class Catalog:
    """Feature sets under one root: ``features/<name>.csv``, ``attributes/<name>.attributes.csv``."""

    root: str
    names: tuple[str, ...] = AUDIO_FEATURE_SETS

    def _known(self, name: str) -> str:
        if name not in self.names:
            raise KeyError(name)
        return name

    def path(self, name: str) -> str:
        return f"{self.root}/features/{self._known(name)}.csv"

    def attributes_path(self, name: str) -> str:
        return f"{self.root}/attributes/{self._known(name)}.attributes.csv"

    def schema(self, spark: SparkSession, name: str) -> T.StructType:
        return schema_from_attributes(read_attributes(spark, self.attributes_path(name)))

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return read_delimited(spark, self.path(name), self.schema(spark, name))

    def register(self, spark: SparkSession, name: str, view: str) -> DataFrame:
        df = self.read(spark, name)
        df.createOrReplaceTempView(view)
        return df
