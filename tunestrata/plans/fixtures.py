"""Stand-ins for the listening tables, derived from the given tables as a whole.

Orders stand for listeners and parts for songs, embeddings for audio features. Every view
reads all rows of its tables; which part is a mismatch or which genre a track has follows
from the row's own values. ``oracle_views`` holds the same definitions as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunestrata.functions import binarize_label, hash_bucket
from tunestrata.operators.joins import attach_genre, per_key
from tunestrata.sources import parse_match_log

FEATURES = [f"f{i}" for i in range(1, 65)]  # every component of an embedding
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), _padded(key, 16))


def _padded(key: str, width: int) -> Column:
    """Zeros in front up to a width; longer numbers stay whole."""
    digits = F.col(key).cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


USER_SHARES = 8


def triplets(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """user_id, song_id, plays.

    ``by_user`` deals a user's rows to at most ``USER_SHARES`` tasks, by the song, in place of a task a
    pair: next to each other they take less room in what is written and shuffled later.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    pair = ["o_custkey", "l_partkey"]
    if by_user:
        share = F.pmod(F.hash("l_partkey"), F.lit(USER_SHARES))
        lines = lines.select(*pair, "l_quantity", share.alias("_share")).repartition("o_custkey", "_share")
        pair = ["o_custkey", "_share", "l_partkey"]
    return (
        lines.groupBy(*pair)
        .agg(F.sum("l_quantity").cast("int").alias("plays"))
        .select(
            F.concat(F.lit("U"), _padded("o_custkey", 8)).alias("user_id"),
            _id("SO", "l_partkey").alias("song_id"),
            "plays",
        )
    )


def _pair() -> Column:
    return F.concat(
        F.lit("<"), _id("SO", "p_partkey"), F.lit(" "), _id("TR", "p_partkey"), F.lit("> "),
        "p_brand", F.lit("  -  "), "p_name", F.lit("  !=  "), "p_type", F.lit("  -  "), "p_name",
    )


def mismatch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("p_size") > 40, "ERROR: ").otherwise("checked: ")
    return table(spark, sf_dir, "part").select(F.concat(start, _pair()).alias("value"))


def accepted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (
        F.when(F.col("p_size") > 45, "< ERROR: ").when(F.col("p_size") < 5, "> ERROR: ").otherwise("note ")
    )
    return table(spark, sf_dir, "part").select(F.concat(start, _pair()).alias("value"))


def mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_match_log(mismatch_lines(spark, sf_dir))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_match_log(accepted_lines(spark, sf_dir), accepted=True)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        _id("SO", "p_partkey").alias("song_id"),
        _id("TR", "p_partkey").alias("track_id"),
        F.col("p_brand").alias("artist_name"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("release"),
        F.when(F.col("p_size") <= 42, F.col("p_size").cast("double") / 50).alias("song_hotttnesss"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MSD_TRACKID in single quotes, and all components as f1, f2, ..."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("'"), _id("TR", "vec_id"), F.lit("'")).alias("MSD_TRACKID"),
        *(F.element_at("embedding", i).cast("double").alias(c) for i, c in enumerate(FEATURES, 1)),
    )


def genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, genres. The genre can be learnt from f1 and f2, but for 5 % of the tracks."""
    s = F.element_at("embedding", 1).cast("double") + F.element_at("embedding", 2).cast("double")
    genre = (
        F.when(hash_bucket("vec_id", 1) % 100 < 5, "Pop_Rock")
        .when(s > 0.22, "Electronic")
        .when(s > 0.1, "Rap")
        .when(s > 0, "Jazz")
        .otherwise("Pop_Rock")
    )
    return table(spark, sf_dir, "embeddings").select(
        _id("TR", "vec_id").alias("track_id"), genre.alias("genres")
    )


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features joined with their genre; ``track`` is the unquoted id."""
    return attach_genre(features(spark, sf_dir), genres(spark, sf_dir)).withColumnRenamed(
        "MSD_TRACKID", "track"
    )


def binary_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).withColumn("genres", binarize_label("genres", "Electronic"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary label, a score and a prediction that follow from each order line."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        F.col("l_extendedprice").alias("score"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"),
        F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("prediction"),
    )


def judged_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three actual and four predicted classes: one predicted class never occurs as a label."""
    flag, open_line = F.col("l_returnflag"), F.col("l_linestatus") != "F"
    return table(spark, sf_dir, "lineitem").select(
        F.when(flag == "A", 0.0).when(flag == "N", 1.0).otherwise(2.0).alias("label"),
        F.when(~open_line & (F.col("l_quantity") < 20), 0.0)
        .when(~open_line, 1.0)
        .when(F.col("l_quantity") < 40, 2.0)
        .otherwise(3.0)
        .alias("prediction"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets with a popularity score as the prediction, NaN for some songs."""
    plays = triplets(spark, sf_dir)
    total = per_key(plays, ["song_id"], F.sum("plays").alias("total"))
    score = F.when(F.col("total") % 97 == 0, float("nan")).otherwise(
        F.col("total").cast("double") / 1000
    )
    return plays.join(total, "song_id").select("user_id", "song_id", "plays", score.alias("prediction"))
