"""Profiles: counts, totals, descriptive statistics, correlations, quantiles, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunestrata.operators.ordering import number_digits


def count_by(df: DataFrame, key: str, counted: str | None = None, name: str = "n") -> DataFrame:
    """Non-null values of ``counted`` (by default the key itself) per key, largest first."""
    return (
        df.groupBy(key)
        .agg(F.count(counted or key).alias(name))
        .orderBy(F.col(name).desc(), F.col(key).asc())
    )


def plays_by_user(triplets: DataFrame) -> DataFrame:
    return triplets.groupBy("user_id").agg(F.sum("plays").alias("total_plays"))


def plays_by_song(triplets: DataFrame) -> DataFrame:
    return triplets.groupBy("song_id").agg(F.sum("plays").alias("total_plays"))


def distinct_songs_by_user(triplets: DataFrame) -> DataFrame:
    return triplets.groupBy("user_id").agg(F.countDistinct("song_id").alias("n_songs"))


def distinct_count(df: DataFrame, columns: str | Sequence[str], name: str = "n") -> DataFrame:
    """Distinct combinations over all rows; null counts as a value of its own."""
    names = [columns] if isinstance(columns, str) else list(columns)
    return df.select(*names).distinct().agg(F.count(F.lit(1)).alias(name))


def distinct_by_bitmap(df: DataFrame, keys: Sequence[str], number: str, name: str = "n") -> DataFrame:
    """Distinct numbers (from 0 on, as ``features.index_table`` deals them) per group, without a shuffle of pairs.

    Each task sets one bit a number and hands on bitmaps of 4 KB for every 32,768 numbers of a group, so
    it pays where groups have many rows to each distinct number; for many small groups ``countDistinct``
    moves less. Null numbers do not count.
    """
    place = F.col(number).cast("bigint") + 1
    bits = (
        df.where(F.col(number).isNotNull())
        .groupBy(*keys, F.bitmap_bucket_number(place).alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    )
    return bits.groupBy(*keys).agg(F.sum(F.bitmap_count("_bits")).alias(name))


def having_below(df: DataFrame, key: str, value: Column, limit: float, name: str = "n") -> DataFrame:
    """Groups whose aggregate lies under a limit."""
    return df.groupBy(key).agg(value.alias(name)).where(F.col(name) < limit)


def having_above(df: DataFrame, key: str, value: Column, limit: float, name: str = "n") -> DataFrame:
    """Groups whose aggregate lies over a limit."""
    return df.groupBy(key).agg(value.alias(name)).where(F.col(name) > limit)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def drill_down(df: DataFrame, **keys: object) -> DataFrame:
    """Point lookup by typed literals, so that the filter reaches the scan."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def describe_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum per column, in one pass.

    Numbers fill ``mean, stddev, min_value, max_value``; strings fill ``min_text, max_text``.
    """
    names = list(columns or df.columns)
    stats, rows = [], []
    for i, name in enumerate(names):
        numeric = isinstance(df.schema[name].dataType, T.NumericType)
        c = F.col(name)
        stats += [
            F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
        ]
        if numeric:
            stats += [F.avg(c).alias(f"mean{i}"), F.stddev_samp(c).alias(f"sd{i}")]
        no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.col(f"n{i}").alias("n"),
                (F.col(f"mean{i}").cast("double") if numeric else no_number).alias("mean"),
                (F.col(f"sd{i}") if numeric else no_number).alias("stddev"),
                (F.col(f"lo{i}").cast("double") if numeric else no_number).alias("min_value"),
                (F.col(f"hi{i}").cast("double") if numeric else no_number).alias("max_value"),
                (no_text if numeric else F.col(f"lo{i}").cast("string")).alias("min_text"),
                (no_text if numeric else F.col(f"hi{i}").cast("string")).alias("max_text"),
            )
        )
    return df.agg(*stats).select(F.inline(F.array(*rows)))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns as ``row, col, r``.

    Rows with a null are left out. A constant column correlates NaN with the others; the diagonal is
    1. Fewer than two rows give NaN. One lazy plan for every width: the means come first, as one
    row; then each row adds its centred values times those of one column to that column's sums, a
    row per column, in every task before the shuffle. Products of centred values lose no digits to
    large means.
    """
    names = list(columns)
    k = len(names)
    complete = df.select(*(F.col(c).cast("double").alias(c) for c in names)).dropna()
    constant = F.min("x") == F.max("x")
    cells = complete.select(F.posexplode(F.array(*names)).alias("j", "x")).groupBy("j")
    profile = cells.agg(F.avg("x").alias("mean"), F.coalesce(constant, F.lit(True)).alias("flat"))
    facts = profile.agg(F.array_sort(F.collect_list(F.struct("j", "mean", "flat"))).alias("facts")).scalar()
    centred = F.transform(F.array(*names), lambda x, j: x - F.col("_facts")[j]["mean"])
    rows = complete.withColumn("_facts", facts).select(centred.alias("v")).select("v", F.posexplode("v").alias("i", "x"))
    sums = rows.groupBy("i").agg(*(F.sum(F.col("x") * F.col("v")[j]).alias(f"s{j}") for j in range(k)))
    table = sums.agg(F.array_sort(F.collect_list(F.struct("i", F.array(*(f"s{j}" for j in range(k))).alias("s")))).alias("t"))
    # What is left has a row per pair of columns.
    labels = F.array(*map(F.lit, names))
    pairs = df.sparkSession.range(1).select(F.posexplode(labels).alias("i", "row"))
    pairs = pairs.select("i", "row", F.posexplode(labels).alias("j", "col"))
    pairs = pairs.withColumns({"t": table.scalar(), "f": facts})
    flat = F.get(F.col("f"), F.col("i"))["flat"] | F.get(F.col("f"), F.col("j"))["flat"]
    entry = lambda a, b: F.get(F.get(F.col("t"), F.col(a))["s"], F.col(b))
    spread = F.sqrt(entry("i", "i")) * F.sqrt(entry("j", "j"))
    r = F.when(F.col("i") == F.col("j"), 1.0).when(F.coalesce(flat, F.lit(True)), float("nan"))
    return pairs.select("row", "col", r.otherwise(F.coalesce(F.try_divide(entry("i", "j"), spread), F.lit(float("nan")))).alias("r"))


def quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, as ``prob, value``.

    A selection, not a sort: rows are counted by the first digit of the value's order, the digits that
    hold the wanted places are kept, their rows counted by the second digit, and by the third. Counts
    are added up in every task before the shuffle and are no more than a digit has values; the wanted
    places, two for each quantile, are all that is broadcast. Nulls and NaN are left out.
    """
    name = "value"
    x = F.col(column).cast("double")
    values = df.where(x.isNotNull() & ~F.isnan(x)).select((x + 0.0).alias(name))
    digits = number_digits(values, name, descending=False)
    values = values.withColumns(digits)
    places = F.array(*(F.lit(float(p)) * F.col("last") for p in probs))
    wanted = df.sparkSession.range(1).select((values.agg(F.count(F.lit(1)) - 1).scalar()).alias("last"))
    wanted = wanted.where("last >= 0").select(F.posexplode(places).alias("i", "place"))
    wanted = wanted.select("i", "place", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("at")).distinct()
    found = wanted.withColumn("rest", F.col("at"))
    kept: list[str] = []
    for digit in digits:
        rows = values
        if kept:
            rows = values.join(F.broadcast(found.select(*kept).distinct()), kept, "left_semi")
        counts = rows.groupBy(*kept, digit).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias(name))
        earlier = Window.partitionBy(*kept).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        named = counts.withColumnsRenamed({c: f"_{c}" for c in kept})
        holds = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n"))
        for c in kept:
            holds = holds & (F.col(c) == F.col(f"_{c}"))
        found = named.join(F.broadcast(found), holds)
        found = found.select("i", "place", "at", *kept, digit, (F.col("rest") - F.col("before")).alias("rest"), name)
        kept.append(digit)
        found = found if digit == list(digits)[-1] else found.drop(name)
    ends = found.groupBy("i", "place").agg(F.min(name).alias("lo"), F.max(name).alias("hi"))
    between = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("place") - F.floor("place"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(between)  # infinities have no difference
    every = df.sparkSession.range(1).select(F.posexplode(F.array(*(F.lit(float(p)) for p in probs))).alias("i", "prob"))
    return every.join(F.broadcast(ends.select("i", value.alias("value"))), "i", "left").select("prob", "value")


def approx_quantiles(
    df: DataFrame, column: str, probs: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """Quantiles from a sketch of bounded size: one pass, rank error 1 / accuracy."""
    wanted = [float(p) for p in probs]
    sketch = df.agg(F.percentile_approx(column, wanted, accuracy).alias("v"))
    return sketch.select(
        F.inline(F.arrays_zip(F.array(*map(F.lit, wanted)).alias("prob"), F.col("v").alias("value")))
    )


def _finite(column: str) -> Column:
    x = F.col(column).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def non_finite(df: DataFrame, column: str) -> DataFrame:
    """One row: values without a place in a histogram, as ``n_null, n_nan, n_infinite``."""
    x = F.col(column).cast("double")
    return df.agg(
        F.count_if(x.isNull()).alias("n_null"),
        F.count_if(F.isnan(x)).alias("n_nan"),
        F.count_if(F.abs(x) == float("inf")).alias("n_infinite"),
    )


def histogram(
    df: DataFrame, column: str, bins: int, max_value: float | None = None
) -> DataFrame:
    """Equal-width bins over [min, max] as ``bin, lo, hi, n``, empty bins included.

    Two passes, one for the range and one for the counts, and no shuffle of more than one
    row per bin and task. The last bin is closed on the right. ``max_value`` leaves out values at or above it.
    A column with a single value gets a range of one around it. NaN and infinities have no bin;
    ``non_finite`` counts them.
    """
    kept = df.where(_finite(column)).select(F.col(column).cast("double").alias("x"))
    if max_value is not None:
        kept = kept.where(F.col("x") < max_value)
    single = F.min("x") == F.max("x")
    bounds = kept.agg(
        F.struct(
            F.when(single, F.min("x") - 0.5).otherwise(F.min("x")).alias("lo"),
            F.when(single, F.max("x") + 0.5).otherwise(F.max("x")).alias("hi"),
        )
    ).scalar()
    lo, hi = F.col("b.lo"), F.col("b.hi")
    width = (hi - lo) / bins
    counts = (
        kept.withColumn("b", bounds)
        .select(F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = df.sparkSession.range(bins).select(F.col("id").alias("bin")).withColumn("b", bounds)
    # At most one row per bin.
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (lo + width * F.col("bin")).alias("lo"),
        (lo + width * (F.col("bin") + 1)).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )
