"""Implicit-feedback recommendation on listening counts."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunestrata.operators.features import index_strings
from tunestrata.operators.joins import attach_metadata, decode_index, explode_recommendations
from tunestrata.operators.metrics import ranked_lists
from tunestrata.operators.ordering import global_positions, position_within
from tunestrata.session import cluster_slots, shared_path
from tunestrata.sources import checkpoint

#: Users in a block that bounds are held against, and users sent to all tasks at once at most.
BLOCK, SENT = 512, 1 << 18
INDEXES = {"user_id": "user_index", "song_id": "song_index"}


def index_interactions(
    triplets: DataFrame, named: Column | None = None, mark: str = "named"
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Numbers for users and songs, and the tables that lead back to the ids.

    With ``named`` only rows it holds for keep their ids (see ``features.index_strings``).
    """
    return index_strings(triplets, INDEXES, named, mark)


def fit_als(
    train: DataFrame, seed: int, implicit: bool = True, blocks: int | None = None, **settings
) -> ALSModel:
    """Alternating least squares on ``user_index, song_index, plays``.

    Users and songs are cut into ``blocks`` each, one task a block; without a number, as many as
    the cluster runs at once, and ten at least. Spark reads the ratings once into blocks of its own, so
    they are not cached here; the blocks and the factors of each round lie on the executors' disks, which
    leaves their memory to the tasks.
    """
    blocks = blocks or max(10, cluster_slots(train.sparkSession))
    # Rounds and regularisation.
    defaults = {"maxIter": 5, "regParam": 0.01, "numUserBlocks": blocks, "numItemBlocks": blocks}
    kept = {"intermediateStorageLevel": "DISK_ONLY", "finalStorageLevel": "DISK_ONLY"}
    als = ALS(
        userCol="user_index",
        itemCol="song_index",
        ratingCol="plays",
        implicitPrefs=implicit,
        seed=seed,
        **{**defaults, **kept, **settings},
    )
    return als.fit(train.select("user_index", "song_index", "plays"))


def predict_pairs(model: ALSModel, df: DataFrame) -> DataFrame:
    """Scores for given pairs; a user or song unseen in training gets NaN."""
    return model.transform(df)


def recommend_for_all_items(model: ALSModel, k: int = 10, bounded: bool = True) -> DataFrame:
    """``song_index, recommendations``: the ``k`` best users of every song with their ratings, best first, as
    ``model.recommendForAllItems`` returns them: in single precision, added up from the first component on.

    Not ``bounded``, every song is multiplied with every user, who then come in the order of a hash. With
    bounds by length (see ``best_users_for_items``) the lists are the same. Ties go to the smaller number.
    """
    order = [F.col("norm").desc(), F.col("user").asc()] if bounded else [F.xxhash64("user").asc(), F.col("user").asc()]
    found = _best_users(model, k, BLOCK, order, "float", bounded)
    rated = F.transform("best", lambda b: F.struct(b["user"].alias("user_index"), (-b["less"]).alias("rating")))
    return found.where(F.size("best") > 0).select(F.col("song").alias("song_index"), rated.alias("recommendations"))


def _norm(features: str) -> Column:
    return F.sqrt(F.aggregate(features, F.lit(0.0), lambda s, v: s + v.cast("double") * v))


def _numbers(features: str, rank: int, name: str, kind: str) -> list[Column]:
    """A column a component, none of them nullable, so that a product of two rows is plain compiled arithmetic."""
    return [F.coalesce(F.get(features, F.lit(i)), F.lit(0.0)).cast(kind).alias(f"{name}{i}") for i in range(rank)]


def _best_of(songs: DataFrame, users: DataFrame, rank: int, k: int) -> DataFrame:
    """``song, new``: the ``k`` best of these users for each song, of those that come before its ``floor, last``.

    ``songs`` are ``song, s0, s1, ..., floor, last``, ``users`` ``user, u0, u1, ...``. Lists are cut to ``k`` in
    the tasks that multiply, by a sort that spills.
    """
    product = sum((F.col(f"s{i}") * F.col(f"u{i}") for i in range(1, rank)), F.col("s0") * F.col("u0"))
    before = (product >= F.col("floor")) & ((product > F.col("floor")) | (F.col("user") < F.col("last")))
    met = songs.join(F.broadcast(users), before).select("song", (-product).alias("less"), "user")
    best = position_within(met, "song", [F.col("less"), F.col("user")], "_place").where(F.col("_place") <= k)
    return best.groupBy("song").agg(F.collect_list(F.struct("less", "user")).alias("new"))


def _best_users(model: ALSModel, k: int, block: int, order: list[Column], kind: str, bounded: bool) -> DataFrame:
    """``song, best, seen``: the ``k`` best users of every song, and how many blocks of users it was held against.

    The first round takes ``2 * k`` users in ``order``, each further one twice as many as the one before (whole
    blocks, once it is beyond the first), at most ``SENT`` users, which are sent to all tasks. So there are few
    rounds, and each finds few pairs better than those a song has. ``bounded``, users have to come longest first,
    and only songs still open go on. Products are of the ``kind`` float or double.
    """
    spark = model.userFactors.sparkSession
    users = model.userFactors.select(F.col("id").alias("user"), "features").withColumn("norm", _norm("features"))
    first = users.select(F.size("features")).first()
    rank = first[0] if first else 1
    placed = checkpoint(global_positions(users, order, "place"), shared_path(spark, "user-places"), "zstd")
    n_users, entry = placed.count(), f"array<struct<less:{kind},user:int>>"
    dealt = model.itemFactors.repartition(4 * cluster_slots(spark), "id")
    state = dealt.select(
        F.col("id").alias("song"), "features", _norm("features").alias("length"), F.array().cast(entry).alias("best"), F.lit(0).alias("seen")
    )
    state = checkpoint(state, shared_path(spark, "songs-open"), "zstd")
    done, start, width = [], 0, min(2 * k, block)
    last = F.get("best", F.lit(k - 1))
    # Sums of rounded products may lie above the lengths multiplied by as much.
    slack = 1 + rank * 2.0**-22
    while start < n_users:
        stop = start + min(width, SENT)
        stop = min(stop if stop < block else -(-stop // block) * block, n_users)
        these = placed.where(F.col("place").between(start, stop - 1)).select("user", *_numbers("features", rank, "u", kind))
        songs = state.select(
            "song", *_numbers("features", rank, "s", kind),
            F.coalesce(-last["less"], F.lit(float("-inf")).cast(kind)).alias("floor"), F.coalesce(last["user"], F.lit(2**31 - 1)).alias("last"),
        )
        found = _best_of(songs, these, rank, k)
        longest = placed.where(F.col("place") == stop).select("norm").first()
        merged = F.slice(F.array_sort(F.concat("best", F.coalesce("new", F.array().cast(entry)))), 1, k)
        seen = F.lit(-(-stop // block)).alias("seen")
        state = state.join(found, "song", "left").select("song", "features", "length", merged.alias("best"), seen)
        within = -last["less"] <= F.col("length") * F.lit((longest[0] if longest else 0.0) * slack)
        going_on = (F.size("best") < k) | within if bounded else F.lit(True)
        dealt = state.withColumn("open", going_on & F.lit(stop < n_users)).repartition(4 * cluster_slots(spark), "song")
        state = checkpoint(dealt, shared_path(spark, "songs-open"), "zstd")
        done.append(state.where("not open").select("song", "best", "seen"))
        state = state.where("open").drop("open")
        if state.isEmpty():
            break
        start, width = stop, 2 * width
    return reduce(DataFrame.unionByName, done, state.select("song", "best", "seen"))


def best_users_for_items(model: ALSModel, k: int = 10, block: int = BLOCK) -> DataFrame:
    """``song_index, user_index, rating, n_blocks``: the ``k`` best users of every song, exactly, without
    the product of all songs with all users.

    Users lie in blocks by the length of their factors, longest first. No product is larger than the
    lengths of both factors multiplied, so a song is done once its k-th rating is above its own length
    times that of the longest user still to come; ``n_blocks`` is how many blocks it was held against.
    Ties at the k-th place go to the smaller number.
    """
    found = _best_users(model, k, block, [F.col("norm").desc(), F.col("user").asc()], "double", bounded=True)
    return found.select("song", "seen", F.explode("best").alias("b")).select(
        F.col("song").alias("song_index"), F.col("b.user").alias("user_index"), (-F.col("b.less")).alias("rating"), F.col("seen").alias("n_blocks")
    )


def recommend_for_users(model: ALSModel, users: DataFrame, k: int = 10) -> DataFrame:
    return model.recommendForUserSubset(users.select("user_index").distinct(), k)


def decode_recommendations(
    recs: DataFrame, users: DataFrame, songs: DataFrame
) -> DataFrame:
    """Recommendation arrays to rows, with user and song ids in place of numbers.

    ``users`` and ``songs`` are index tables: one row per number.
    """
    rows = explode_recommendations(recs, "user_index", "song_index")
    rows = rows.withColumns(
        {c: F.col(c).cast("double") for c in ("user_index", "song_index")}
    )
    named = decode_index(rows, users.select("user_index", "user_id"), "user_index", unique=True)
    return decode_index(named, songs.select("song_index", "song_id"), "song_index", unique=True)


def recommendation_card(
    user_id: str,
    train: DataFrame,
    test: DataFrame,
    metadata: DataFrame,
    recommended: DataFrame | None = None,
) -> DataFrame:
    """One user's songs side by side: heard in training, held out, and recommended.

    The user is picked out before the join with the metadata.
    """
    def songs_of(df: DataFrame, side: str, rating: str | None) -> DataFrame:
        mine = df.where(F.col("user_id") == F.lit(user_id)).select(
            F.lit(side).alias("side"),
            "song_id",
            (F.lit(None) if rating else F.col("plays")).cast("bigint").alias("plays"),
            (F.col(rating) if rating else F.lit(None)).cast("double").alias("rating"),
        )
        return attach_metadata(mine, metadata)

    card = songs_of(train, "train", None).unionByName(songs_of(test, "test", None))
    if recommended is not None:
        card = card.unionByName(songs_of(recommended, "recommended", "rating"))
    return card.select(
        "side", "song_id", "plays", "rating", "artist_name", "song_hotttnesss", "title", "release"
    )


def ranking_pairs(scored: DataFrame, predicted: str, actual: str, n: int, chunk_size: int) -> DataFrame:
    """Predicted and actual top songs of each user as two arrays, from one pass and one grouping.

    Returns ``user_id, chunk, predicted_songs, actual_songs``; every scored user has both
    lists. Songs without a score (null or NaN) are in neither. Lists longer than ``chunk_size`` go
    on in further chunks, where one side may be null. For metrics
    over many users ``metrics.ranking_rows`` holds the same lists as rows.
    """
    lists = ranked_lists(scored, predicted, actual, n)
    chunk = F.floor((F.col("place") - 1) / chunk_size).cast("int").alias("chunk")

    def songs(wanted: Column) -> Column:
        entries = F.array_sort(F.collect_list(F.when(wanted, F.struct("place", "song_id"))))
        return F.when(F.size(entries) > 0, F.transform(entries, lambda e: e["song_id"]))

    return lists.groupBy("user_id", chunk).agg(
        songs(F.col("said")).alias("predicted_songs"), songs(~F.col("said")).alias("actual_songs")
    )
