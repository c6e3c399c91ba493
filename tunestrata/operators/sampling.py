"""Splits, resampling and random picks. A seed is always required.

``method="hash"`` decides by the row's key alone: repeatable anywhere, and train and test
are two plain filters. ``method="rng"`` uses Spark's random numbers; the draw is written
to the checkpoint folder, since a recomputed partition may otherwise draw differently and
let a row fall into both parts or neither.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunestrata.functions import hash_bucket, hash_fraction
from tunestrata.operators.joins import exclude
from tunestrata.session import pin

_DRAW = "_draw"


def key_of(*columns: str) -> Column:
    """One hash key from several columns: lengths in front keep different rows apart, as does a mark for null."""
    parts = (F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")) for c in columns)
    return F.concat(*(F.coalesce(p, F.lit("-")) for p in parts))


def _drawn(df: DataFrame, key: Column | str, seed: int, method: str) -> DataFrame:
    if method == "hash":
        return df.withColumn(_DRAW, hash_fraction(key, seed))
    if method == "rng":
        return pin(df.withColumn(_DRAW, F.rand(seed)))
    raise ValueError(f"unknown method {method!r}")


def _rate(strata: str | None, fractions: float | Mapping[object, float]) -> Column:
    if not isinstance(fractions, Mapping):
        return F.lit(float(fractions))
    rate = F.lit(0.0)
    for value, fraction in fractions.items():
        rate = F.when(F.col(strata) == F.lit(value), float(fraction)).otherwise(rate)
    return rate


def in_sample(key: Column | str, seed: int, fraction: float) -> Column:
    """Whether ``stratified_split`` by hash, with one fraction for all, takes a row into the sample."""
    return hash_fraction(key, seed) < F.lit(float(fraction))


def stratified_split(
    df: DataFrame,
    key: Column | str,
    seed: int,
    fractions: float | Mapping[object, float],
    strata: str | None = None,
    method: str = "hash",
) -> tuple[DataFrame, DataFrame]:
    """(sample, rest). Strata missing from a mapping are not sampled.

    One fraction for every stratum needs no list of strata: each row is drawn with the
    same probability whatever its stratum is.
    """
    drawn = _drawn(df, key, seed, method)
    taken = F.col(_DRAW) < _rate(strata, fractions)
    return drawn.where(taken).drop(_DRAW), drawn.where(~taken).drop(_DRAW)


def holdout(df: DataFrame, sample: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """The rows a sample given from elsewhere left out; ``keys`` identify a row."""
    return exclude(df, sample, keys, unique=True)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _sizes(df: DataFrame, label: str, minority: object) -> Column:
    """Struct of both class sizes as a scalar subquery: one row, one pass."""
    small = F.col(label) == F.lit(minority)
    return df.agg(
        F.struct(
            F.count_if(small).cast("double").alias("small"),
            F.count_if(~small).cast("double").alias("large"),
        )
    ).scalar()


def undersample(
    df: DataFrame,
    label: str,
    minority: object,
    key: Column | str,
    seed: int,
    fraction: float | None = None,
    method: str = "hash",
) -> DataFrame:
    """All minority rows, and majority rows at a rate that evens out the classes."""
    rate = F.lit(float(fraction)) if fraction is not None else F.col("_size.small") / F.col("_size.large")
    sized = df if fraction is not None else df.withColumn("_size", _sizes(df, label, minority))
    small = F.col(label) == F.lit(minority)
    drawn = _drawn(sized, key, seed, method)
    return drawn.where(small | (~small & (F.col(_DRAW) < rate))).select(*df.columns)


def oversample(
    df: DataFrame,
    label: str,
    minority: object,
    key: Column | str,
    seed: int,
    rate: float | None = None,
    method: str = "hash",
) -> DataFrame:
    """All majority rows, and minority rows repeated to even out the classes.

    With ``hash``, a rate of 9.35 gives each row 9 copies and 35 in 100 rows one more.
    With ``rng``, copies follow a Poisson law, as sampling with replacement does.
    """
    small = F.col(label) == F.lit(minority)
    if method == "rng":
        if rate is None:
            n = df.agg(F.count_if(small).alias("s"), F.count_if(~small).alias("l")).first()
            rate = n["l"] / n["s"] if n["s"] else 0.0  # without a minority there is nothing to repeat
        return pin(
            df.where(small).sample(True, float(rate), seed).unionByName(df.where(~small))
        )
    sized = df if rate is not None else df.withColumn("_size", _sizes(df, label, minority))
    times = F.lit(float(rate)) if rate is not None else F.col("_size.large") / F.col("_size.small")
    whole = F.floor(times)
    more = F.when(hash_fraction(key, seed) < times - whole, 1).otherwise(0)
    copies = F.when(small, whole + more).when(~small, 1).otherwise(0).cast("int")
    return (
        sized.withColumn("_copies", copies)
        .where(F.col("_copies") > 0)
        .select(*df.columns, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy"))
        .drop("_copy")
    )


def random_rows(df: DataFrame, k: int, key: Column | str, seed: int, method: str = "hash") -> DataFrame:
    """``k`` rows in random order of their hash (or of Spark's random numbers)."""
    if method == "rng":
        return df.orderBy(F.rand(seed)).limit(k)
    tie = F.col(key) if isinstance(key, str) else key
    return df.orderBy(hash_bucket(key, seed), tie).limit(k)


def sample_heavy_users(triplets: DataFrame, more_than: int, k: int, seed: int) -> DataFrame:
    """``k`` random users among those with more than so many songs."""
    heavy = (
        triplets.groupBy("user_id")
        .agg(F.count("song_id").alias("n_songs"))
        .where(F.col("n_songs") > more_than)
    )
    return random_rows(heavy, k, "user_id", seed)
