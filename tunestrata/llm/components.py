"""Connected components of a link table, without bringing links or nodes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunestrata.llm.common import written
from tunestrata.operators.joins import per_key


def _pointed(pairs: DataFrame) -> DataFrame:
    """``u, v`` with ``v`` replaced by the smallest of u's partners (or u, if smaller)."""
    least = per_key(pairs, ["u"], F.min("v").alias("least"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _pointed(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the smallest one."""
    pointed = _pointed(links)
    turned = pointed.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return turned.union(pointed.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")
    ).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (two bigint columns); root is the smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each round is two
    groupings and two joins, rows only become fewer, and chains shrink by about half. Each round
    is stored, so a lost executor costs one round at most. Only a count and a checksum reach the
    driver. Null nodes and self links are left out; an empty table gives an empty result.
    """
    a, b = edges.columns
    links = written(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    before = _state(links)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        links = written(_small_star(_large_star(links)), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
