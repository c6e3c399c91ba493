"""Ranks, positions and running totals that no single task has to carry alone.

A window sorts each of its groups inside one task. That is right for groups of ordinary size and
wrong for a global order or for a user with a third of all rows. Two ways around it are here.

``totals_before`` reads an order as digits: totals are added up by the first digit, within it by
the second, and so on, so every window sorts the children of one node, no more than a digit has
values, however many rows a group has. It is one lazy plan and needs to know no hot keys.

``running_totals`` and ``global_positions`` take Spark's range sort for one order over all rows:
every slice of the sort adds up its own rows, and the slice totals (one row each) shift the slices
to their place.

Top lists are cut in the tasks that read the rows, before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunestrata.session import pin

_SLICE = "_slice"
_SPOT = "_spot"
_TIE = "_tie"
_SPOT_MASK = (1 << 33) - 1


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join where null meets null; the right side's keys drop out."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(named, condition, how).drop(*(f"_right_{k}" for k in keys))


def running_totals(df: DataFrame, order: Sequence[Column], amounts: Sequence[str]) -> DataFrame:
    """Add ``<amount>_before``: the total of the rows that come earlier in the order.

    ``order`` must tell any two rows apart. The slice totals have one row per slice of the sort, so
    they are safe to broadcast.
    """
    slices = pin(df.orderBy(*order).withColumn(_SLICE, F.spark_partition_id()))
    earlier = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        slices.groupBy(_SLICE)
        .agg(*(F.sum(a).alias(f"_sum_{a}") for a in amounts))
        .select(_SLICE, *(F.coalesce(F.sum(f"_sum_{a}").over(earlier), F.lit(0)).alias(f"_shift_{a}") for a in amounts))
    )
    inside = Window.partitionBy(_SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = slices.select(
        *slices.columns,
        *(F.coalesce(F.sum(a).over(inside), F.lit(0)).alias(f"_local_{a}") for a in amounts),
    )
    return local.join(F.broadcast(shifts), _SLICE).select(
        *df.columns,
        *((F.col(f"_local_{a}") + F.col(f"_shift_{a}")).alias(f"{a}_before") for a in amounts),
    )


def global_positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number all rows 0, 1, 2, ... in the given order, without a single-task window.

    The sort already lays rows out in order, so a row's place in its slice is free; only
    the slice sizes (one row each) are added up and broadcast.
    """
    slices = pin(
        df.orderBy(*order)
        .withColumn(_SLICE, F.spark_partition_id())
        .withColumn(_SPOT, F.monotonically_increasing_id().bitwiseAND(F.lit(_SPOT_MASK)))
    )
    earlier = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        slices.groupBy(_SLICE)
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(_SLICE, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"))
    )
    return slices.join(F.broadcast(shifts), _SLICE).select(
        *df.columns, (F.col("_shift") + F.col(_SPOT)).alias(name)
    )


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


# A number's 64 bits in order, cut into three digits.
_DIGIT_BITS = (22, 21, 21)
_NO_VALUE = 1 << _DIGIT_BITS[0]  # beyond any first digit


def number_digits(df: DataFrame, by: str, descending: bool = True) -> dict[str, Column]:
    """Three columns that order rows as the number ``by`` does; nulls come last, or first if ascending.

    An integer is its own bits; a floating-point number's bits order like the number once those of
    negative numbers are turned round. NaN is above all others, as in Spark's order.
    """
    kind = df.schema[by].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        bits = F.col(by).cast("bigint")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        plain = F.coalesce(F.col(by).cast("double") + 0.0, F.lit(0.0))
        bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("bigint")
        bits = F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)
    else:
        raise ValueError(f"{by} is no number but {kind.simpleString()}")
    bits = F.bitwise_not(bits) if descending else bits
    first, second, third = _DIGIT_BITS
    low = F.lit((1 << third) - 1).cast("bigint")
    missing = F.col(by).isNull()
    return {
        "_digit_1": F.when(missing, F.lit(_NO_VALUE if descending else -_NO_VALUE)).otherwise(F.shiftright(bits, second + third)).cast("bigint"),
        "_digit_2": F.when(missing, F.lit(0)).otherwise(F.shiftright(bits, third).bitwiseAND(low)).cast("bigint"),
        "_digit_3": F.when(missing, F.lit(0)).otherwise(bits.bitwiseAND(low)).cast("bigint"),
    }


def totals_before(df: DataFrame, part: Sequence[str], digits: Sequence[str], amounts: Sequence[str]) -> DataFrame:
    """Add ``<amount>_before``: the total of a group's rows that come earlier.

    ``digits`` are columns whose values, one after the other, order the rows of a group; no two rows
    of a group may have all of them equal. Any number of groups of any size: a window never holds
    more rows than one digit has values.
    """
    upper = None
    for depth, digit in enumerate(digits):
        above = [*part, *digits[:depth]]
        last = depth == len(digits) - 1
        nodes = df if last else df.groupBy(*above, digit).agg(*(F.sum(a).alias(a) for a in amounts))
        earlier = Window.partitionBy(*above).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.withColumns({f"{a}_before": F.coalesce(F.sum(a).over(earlier), F.lit(0)) for a in amounts})
        if upper is not None:
            shifts = upper.select(*above, *(F.col(f"{a}_before").alias(f"_shift_{a}") for a in amounts))
            nodes = _join_null_safe(nodes, shifts, above, "inner")
            nodes = nodes.withColumns({f"{a}_before": F.col(f"{a}_before") + F.col(f"_shift_{a}") for a in amounts})
        upper = nodes
    return upper.select(*df.columns, *(f"{a}_before" for a in amounts))


def _by_order(by: str, descending: bool) -> Column:
    return F.col(by).desc() if descending else F.col(by).asc()


def rank_within(
    df: DataFrame, part: str | Sequence[str], by: str, name: str = "rank", descending: bool = True
) -> DataFrame:
    """``rank()`` of each row inside its group by a number; equal values share a rank.

    Rows are folded to one per group and value, in the tasks that read them first. The rank of a
    value is one more than the rows above it.
    """
    keys = _names(part)
    ties = df.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("_n"))
    digits = number_digits(df, by, descending)
    ranks = totals_before(ties.withColumns(digits), keys, list(digits), ["_n"])
    ranks = ranks.select(*keys, by, (F.col("_n_before") + 1).alias(name))
    return _join_null_safe(df, ranks, [*keys, by], "inner").select(*df.columns, name)


def position_within(df: DataFrame, part: str | Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """1, 2, 3, ... inside each group; ``order`` must leave no ties.

    One task sorts a group: for lists that are cut already. A filter for the first places beside it
    cuts the groups before the shuffle.
    """
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*_names(part)).orderBy(*order)).cast("bigint"))


def top_n_per_group(
    df: DataFrame, part: str | Sequence[str], by: str, n: int, name: str = "rank", descending: bool = True
) -> DataFrame:
    """Rows ranked ``n`` or better. Ties at the edge stay, so a group may return more.

    Each task first keeps what is ranked ``n`` or better among the rows it reads. The ``n`` first of
    all, ties cut (Spark cuts them in the reading tasks too), already say which values are in and at
    which rank; joining them to the rows deals out even a group most of whose rows tie.
    """
    return _top_ties(df, _names(part), by, n, name, descending).select(*df.columns, name)


def _top_ties(df: DataFrame, keys: Sequence[str], by: str, n: int, name: str, descending: bool) -> DataFrame:
    """``top_n_per_group`` with the struct ``_TIE`` of group and value, which its rows were joined by.

    Structs of nulls are equal, and a window over ``_TIE`` needs no further shuffle.
    """
    order = _by_order(by, descending)
    here = Window.partitionBy(*keys, _SLICE).orderBy(order)
    kept = df.withColumn(_SLICE, F.spark_partition_id()).withColumn(name, F.rank().over(here))
    kept = kept.where(F.col(name) <= n).select(*df.columns)
    whole = Window.partitionBy(*keys).orderBy(order)
    first = df.select(*keys, by).withColumn(_SPOT, F.row_number().over(whole)).where(F.col(_SPOT) <= n)
    counts = first.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("_n"))
    above = F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select(*keys, by, (F.coalesce(above, F.lit(0)) + 1).alias(name))
    tie, others = F.struct(*keys, by).alias(_TIE), [c for c in df.columns if c not in (*keys, by)]
    top = kept.select(tie, *others).join(ranks.select(tie, name), _TIE)
    return top.select("*", *(F.col(_TIE).getField(c).alias(c) for c in (*keys, by)))


def top_places(
    df: DataFrame, part: str | Sequence[str], by: str, item: str, n: int, name: str = "place", descending: bool = True
) -> DataFrame:
    """``top_n_per_group`` with each row's place in the list, ties in item order, in place of its rank.

    Rows of one group and value are numbered in one task, by a sort that spills.
    """
    keys = _names(part)
    top = _top_ties(df, keys, by, n, "_rank", descending)
    placed = position_within(top, _TIE, [F.col(item)], "_spot_in_tie")
    return placed.select(*df.columns, (F.col("_rank") + F.col("_spot_in_tie") - 1).alias(name))


def collect_top_items(df: DataFrame, part: str, by: str, item: str, n: int, chunk_size: int) -> DataFrame:
    """The top items of each group as an array, best first, ties in item order.

    Returns ``part, chunk, items``: ties may make a list longer than an array should be, so the
    caller says how long one row's array gets; what is beyond goes on in chunks 1, 2, ...
    """
    placed = top_places(df, part, by, item, n, "_place")
    chunk = F.floor((F.col("_place") - 1) / chunk_size).cast("int").alias("chunk")
    entries = F.array_sort(F.collect_list(F.struct(F.col("_place"), F.col(item))))
    return placed.groupBy(part, chunk).agg(F.transform(entries, lambda e: e[item]).alias("items"))
