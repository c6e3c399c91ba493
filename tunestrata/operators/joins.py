"""Joins and exclusion lists.

No side is broadcast by hand: the right sides here grow with the data, and Spark knows
their size when it picks the join. Where a sort-merge join is picked, adaptive execution
splits the partition of a hot left key (``session.SKEW_SETTINGS``), but only if both inputs
of the join come straight from a shuffle. An aggregate that already has the layout of the
join would be joined in place, without one; ``per_key`` avoids that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunestrata.functions import strip_quotes


def per_key(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """One row per key, made to be joined with rows that may have hot keys.

    Grouping by the keys as one struct leaves a layout the join cannot use, so the result,
    already folded to one row per key, is shuffled for the join like its other side.
    """
    key = F.struct(*keys).alias("_key")
    if not aggregates:
        return df.select(key).distinct().select("_key.*")
    grouped = df.groupBy(key).agg(*aggregates)
    return grouped.select("_key.*", *(c for c in grouped.columns if c != "_key"))


def exclude(
    df: DataFrame, bad: DataFrame, keys: str | Sequence[str], unique: bool = False
) -> DataFrame:
    """Rows of ``df`` whose key is not in ``bad``. A null key matches nothing and stays.

    ``unique`` says that ``bad`` has each key once, so it need not be made distinct.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    listed = bad.select(*names) if unique else per_key(bad, names)
    return df.join(listed, names, "left_anti")


def rejected_songs(
    mismatches: DataFrame, accepted: DataFrame, keys: Sequence[str] = ("song_id",)
) -> DataFrame:
    """Mismatches that nobody accepted afterwards.

    On the song id alone, one accepted pair clears all mismatches of that song; pass
    ``("song_id", "track_id")`` to clear just the accepted pair.
    """
    return exclude(mismatches, accepted, keys)


def clean_triplets(
    triplets: DataFrame,
    mismatches: DataFrame,
    accepted: DataFrame,
    keys: Sequence[str] = ("song_id",),
) -> DataFrame:
    """Plays of songs that are matched to the right track."""
    return exclude(triplets, rejected_songs(mismatches, accepted, keys), "song_id")


def clean_plays_by_song(
    triplets: DataFrame, mismatches: DataFrame, accepted: DataFrame
) -> DataFrame:
    """Total plays per correctly matched song.

    Excluding songs and adding up per song commute, so the plays are added up first and
    the join meets one row per song, however often a song was played.
    """
    totals = triplets.groupBy("song_id").agg(F.sum("plays").alias("total_plays"))
    return exclude(totals, rejected_songs(mismatches, accepted), "song_id")


def attach_genre(features: DataFrame, genres: DataFrame, track: str = "MSD_TRACKID") -> DataFrame:
    """Features with unquoted track ids, joined to the genre of the track."""
    clean = features.withColumn(track, strip_quotes(track))
    return clean.join(
        genres.select(F.col("track_id").alias(track), F.col("genres")), track, "inner"
    )


def attach_metadata(
    df: DataFrame,
    metadata: DataFrame,
    columns: Sequence[str] = ("artist_name", "song_hotttnesss", "title", "release"),
) -> DataFrame:
    return df.join(metadata.select("song_id", *columns), "song_id", "inner")


def prune_interactions(
    triplets: DataFrame, min_song_plays: int, min_user_songs: int
) -> DataFrame:
    """Drop songs played too rarely and users with too few songs.

    Both lists are taken from the table as it comes in.
    """
    plays, songs = F.sum("plays").alias("n"), F.countDistinct("song_id").alias("n")
    rare = per_key(triplets, ["song_id"], plays).where(F.col("n") < min_song_plays)
    light = per_key(triplets, ["user_id"], songs).where(F.col("n") < min_user_songs)
    kept = exclude(triplets, rare, "song_id", unique=True)
    return exclude(kept, light, "user_id", unique=True)


def prune_users(triplets: DataFrame, min_songs: int) -> DataFrame:
    """Drop users left with too few songs."""
    light = per_key(triplets, ["user_id"], F.count("song_id").alias("n")).where(
        F.col("n") < min_songs
    )
    return exclude(triplets, light, "user_id", unique=True)


def decode_index(
    df: DataFrame, index: DataFrame, column: str, unique: bool = False
) -> DataFrame:
    """Left join from an index column back to the id it stands for.

    ``index`` may repeat its pairs (e.g. be the indexed interactions themselves), unless it
    is said to be ``unique``.
    """
    return df.join(index if unique else index.distinct(), column, "left")


def explode_recommendations(
    recs: DataFrame, key: str, item: str, score: str = "rating"
) -> DataFrame:
    """One row per recommendation instead of one array of structs per key."""
    return recs.select(key, F.explode("recommendations").alias("r")).select(
        key, F.col(f"r.{item}").alias(item), F.col("r.rating").alias(score)
    )
