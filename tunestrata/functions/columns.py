"""Scalar expressions. All stay inside the JVM; there is no Python UDF in the library."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_quotes(c: Column | str) -> Column:
    """Remove single quotes from an id. Null stays null."""
    return F.translate(_col(c), "'", "")


def binarize_label(c: Column | str, positive: str, other: str = "Other") -> Column:
    """Keep one category, fold every other value and null into ``other``."""
    return F.when(_col(c) == positive, F.lit(positive)).otherwise(F.lit(other))


def hash_bucket(key: Column | str, seed: int) -> Column:
    """A 32-bit number that depends on seed and key alone.

    The same key gets the same number on every run, executor and engine, so a split made
    with it can be repeated, survives recomputation and does not hinder filter pushdown.
    A null key is hashed as an empty one, so that no row gets lost between two filters.
    """
    text = F.coalesce(_col(key).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), text))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_fraction(key: Column | str, seed: int) -> Column:
    """``hash_bucket`` scaled to [0, 1)."""
    return hash_bucket(key, seed) / F.lit(float(2**32))


def drop_nan(df: DataFrame, c: str) -> DataFrame:
    """Rows whose value is a number: neither NaN nor null."""
    return df.where(F.col(c).isNotNull() & ~F.isnan(c))


def count_nan(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.count_if(F.isnan(c)).alias("n_nan"), F.count(F.lit(1)).alias("n_rows"))


def feature_columns(df: DataFrame, exclude: Iterable[str]) -> list[str]:
    """All columns but the excluded ones, in table order."""
    left_out = set(exclude)
    return [c for c in df.columns if c not in left_out]
