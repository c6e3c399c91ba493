"""Queries for cleaning, filters, joins, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunestrata.functions import binarize_label, count_nan, drop_nan, strip_quotes
from tunestrata.operators import aggregates as ag
from tunestrata.operators import features as ft
from tunestrata.operators import joins, ordering, sampling
from tunestrata.plans import fixtures as fx
from tunestrata.plans.oracle_views import hash_sql, pair_sql
from tunestrata.plans.registry import query
from tunestrata.session import shared_path
from tunestrata.sources import checkpoint

#: Songs in one row of a list.
LIST_CHUNK = 100_000

MIN_SONG_PLAYS, MIN_USER_SONGS, MIN_SONGS_LEFT = 631, 27, 20

# ---- cleaning and joins -----------------------------------------------------

_CLEAN = """
    select t.* from triplets t
    where song_id not in (select song_id from mismatches
                          where song_id not in (select song_id from accepted))"""


@query(_CLEAN)
def clean_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.clean_triplets(
        fx.triplets(spark, sf_dir), fx.mismatches(spark, sf_dir), fx.accepted(spark, sf_dir)
    )


@query(f"select song_id, cast(sum(plays) as bigint) as total_plays from ({_CLEAN}) c group by song_id")
def clean_plays_by_song(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.clean_plays_by_song(
        fx.triplets(spark, sf_dir), fx.mismatches(spark, sf_dir), fx.accepted(spark, sf_dir)
    )


@query(
    """select song_id, track_id from mismatches m
       where not exists (select 1 from accepted a
                         where a.song_id = m.song_id and a.track_id = m.track_id)"""
)
def rejected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = joins.rejected_songs(
        fx.mismatches(spark, sf_dir), fx.accepted(spark, sf_dir), ("song_id", "track_id")
    )
    return rejected.select("song_id", "track_id")


@query("select * from triplets where song_id not in (select song_id from mismatches)")
def exclude_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.exclude(fx.triplets(spark, sf_dir), fx.mismatches(spark, sf_dir), "song_id")


@query("select * from tagged")
def features_with_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tagged(spark, sf_dir)


@query(
    """select t.*, artist_name, song_hotttnesss, title, release
       from triplets t join metadata m on t.song_id = m.song_id"""
)
def triplets_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.attach_metadata(fx.triplets(spark, sf_dir), fx.metadata(spark, sf_dir))


@query(f"select track, genres from binary_tagged where {hash_sql(11, 'track')} / 4294967296.0 >= 0.7")
def holdout_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.binary_tagged(spark, sf_dir).select("track", "genres")
    sample, _ = sampling.stratified_split(rows, "track", 11, 0.7)
    return sampling.holdout(rows, sample, "track")


@query(
    f"""select * from triplets
        where {hash_sql(12, pair_sql())} / 4294967296.0 >= 0.21"""
)
def holdout_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.triplets(spark, sf_dir)
    sample, _ = sampling.stratified_split(rows, sampling.key_of("user_id", "song_id"), 12, 0.21)
    return sampling.holdout(rows, sample, ["user_id", "song_id"])


_PRUNED = f"""
    select * from triplets
    where song_id not in (select song_id from triplets group by song_id having sum(plays) < {MIN_SONG_PLAYS})
      and user_id not in (select user_id from triplets group by user_id
                          having count(distinct song_id) < {MIN_USER_SONGS})"""


def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triplets are stored first: both lists and the pruning itself read them."""
    plays = checkpoint(fx.triplets(spark, sf_dir), shared_path(spark, "triplets"))
    return joins.prune_interactions(plays, MIN_SONG_PLAYS, MIN_USER_SONGS)


@query(_PRUNED)
def prune_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pruned(spark, sf_dir)


@query(
    f"""with pruned as ({_PRUNED})
        select * from pruned where user_id not in
            (select user_id from pruned group by user_id having count(song_id) < {MIN_SONGS_LEFT})"""
)
def prune_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    pruned = checkpoint(_pruned(spark, sf_dir), shared_path(spark, "pruned"))
    return joins.prune_users(pruned, MIN_SONGS_LEFT)


@query(
    f"""with pruned as ({_PRUNED}),
             counts as (select user_id, count(song_id) as n from pruned group by user_id)
        select (select count(*) from pruned) as n_rows, count(*) as n_users,
               min(n) as fewest_songs, max(n) as most_songs,
               (select count(distinct song_id) from pruned) as n_songs
        from counts"""
)
def pruned_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    pruned = checkpoint(_pruned(spark, sf_dir), shared_path(spark, "pruned"))
    per_user = ag.count_by(pruned, "user_id", "song_id")
    songs = ag.distinct_count(pruned, "song_id")
    return per_user.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_users"),
        F.min("n").alias("fewest_songs"),
        F.max("n").alias("most_songs"),
    ).withColumn("n_songs", songs.scalar())


# ---- scalar functions and filters -------------------------------------------


@query("select replace(MSD_TRACKID, chr(39), '') as track, MSD_TRACKID as quoted from features")
def strip_track_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.features(spark, sf_dir).select(
        strip_quotes("MSD_TRACKID").alias("track"), F.col("MSD_TRACKID").alias("quoted")
    )


@query(
    """select track_id, genres,
              case when nullif(genres, 'Jazz') = 'Electronic' then 'Electronic' else 'Other' end as binary_genre
       from genres"""
)
def binarize_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.genres(spark, sf_dir).select(
        "track_id",
        "genres",
        binarize_label(F.nullif("genres", F.lit("Jazz")), "Electronic").alias("binary_genre"),
    )


@query(
    """select count(*) filter (where g = 'Electronic') as n_equal,
              count(*) filter (where g <> 'Electronic') as n_other, count(*) as n_rows
       from (select nullif(genres, 'Jazz') as g from genres) x"""
)
def category_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.nullif("genres", F.lit("Jazz"))
    return fx.genres(spark, sf_dir).agg(
        F.count_if(g == "Electronic").alias("n_equal"),
        F.count_if(g != "Electronic").alias("n_other"),
        F.count(F.lit(1)).alias("n_rows"),
    )


@query(
    f"select song_id, cast(sum(plays) as bigint) as n from triplets group by song_id having sum(plays) < {MIN_SONG_PLAYS}"
)
def rare_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.having_below(fx.triplets(spark, sf_dir), "song_id", F.sum("plays"), MIN_SONG_PLAYS)


@query(
    f"""select user_id, count(distinct song_id) as n from triplets
        group by user_id having count(distinct song_id) < {MIN_USER_SONGS}"""
)
def light_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.having_below(
        fx.triplets(spark, sf_dir), "user_id", F.countDistinct("song_id"), MIN_USER_SONGS
    )


@query("select user_id, count(song_id) as n from triplets group by user_id having count(song_id) > 45")
def heavy_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.having_above(fx.triplets(spark, sf_dir), "user_id", F.count("song_id"), 45)


@query("select * from triplets where user_id = 'U00000007'")
def user_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.drill_down(fx.triplets(spark, sf_dir), user_id="U00000007")


@query("select count(*) filter (where isnan(prediction)) as n_nan, count(*) as n_rows from scored")
def nan_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_nan(fx.scored(spark, sf_dir), "prediction")


@query("select * from scored where not isnan(prediction)")
def without_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_nan(fx.scored(spark, sf_dir), "prediction")


# ---- aggregates -------------------------------------------------------------


@query(
    """select count(*) as n_triplets, (select count(*) from features) as n_features,
              (select count(*) from genres) as n_genres, (select count(*) from metadata) as n_songs
       from triplets"""
)
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    return (
        counted(fx.triplets(spark, sf_dir), "n_triplets")
        .withColumn("n_features", counted(fx.features(spark, sf_dir), "n").scalar())
        .withColumn("n_genres", counted(fx.genres(spark, sf_dir), "n").scalar())
        .withColumn("n_songs", counted(fx.metadata(spark, sf_dir), "n").scalar())
    )


@query("select genres, count(genres) as n from genres group by genres order by n desc")
def genre_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.count_by(fx.genres(spark, sf_dir), "genres")


@query("select user_id, count(song_id) as n from triplets group by user_id")
def songs_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.count_by(fx.triplets(spark, sf_dir), "user_id", "song_id")


@query("select user_id, cast(sum(plays) as bigint) as total_plays from triplets group by user_id")
def plays_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.plays_by_user(fx.triplets(spark, sf_dir)).orderBy(F.col("total_plays").desc())


@query("select song_id, cast(sum(plays) as bigint) as total_plays from triplets group by song_id")
def plays_by_song(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.plays_by_song(fx.triplets(spark, sf_dir)).orderBy(F.col("total_plays").desc())


@query("select user_id, count(distinct song_id) as n_songs from triplets group by user_id")
def distinct_songs_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.distinct_songs_by_user(fx.triplets(spark, sf_dir))


@query(
    """select count(distinct song_id) as n_songs,
              (select count(distinct user_id) from triplets) as n_users from triplets"""
)
def distinct_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = fx.triplets(spark, sf_dir)
    users = ag.distinct_count(plays, "user_id")
    return ag.distinct_count(plays, "song_id", "n_songs").withColumn("n_users", users.scalar())


@query(
    """select artist_name, count(distinct user_id) as n_listeners, count(*) as n_pairs
       from triplets t join metadata m on t.song_id = m.song_id group by artist_name"""
)
def distinct_listeners_by_artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listeners counted by bitmaps over their numbers."""
    plays = fx.triplets(spark, sf_dir)
    numbered = ft.apply_index(plays, ft.index_table(plays, "user_id", "user_index"), "user_id", "user_index")
    rows = numbered.join(fx.metadata(spark, sf_dir).select("song_id", "artist_name"), "song_id")
    listeners = ag.distinct_by_bitmap(rows, ["artist_name"], "user_index", "n_listeners")
    return listeners.join(rows.groupBy("artist_name").agg(F.count(F.lit(1)).alias("n_pairs")), "artist_name")


@query("select distinct l_returnflag, l_linestatus from lineitem")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


def _describe_sql(table: str, numbers: list[str], texts: list[str]) -> str:
    parts = [
        f"""select '{c}' as "column", count({c}) as n, round(avg({c}), 6) as mean,
            round(stddev_samp({c}), 6) as stddev, cast(min({c}) as double) as min_value,
            cast(max({c}) as double) as max_value, null::varchar as min_text, null::varchar as max_text
            from {table}"""
        for c in numbers
    ]
    parts += [
        f"""select '{c}' as "column", count({c}) as n, null::double as mean, null::double as stddev,
            null::double as min_value, null::double as max_value, min({c}) as min_text, max({c}) as max_text
            from {table}"""
        for c in texts
    ]
    return " union all ".join(parts)


def _described(df: DataFrame, columns: list[str]) -> DataFrame:
    return ag.describe_features(df, columns).withColumns(
        {"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)}
    )


@query(_describe_sql("features", fx.FEATURES, ["MSD_TRACKID"]))
def describe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(fx.features(spark, sf_dir), [*fx.FEATURES, "MSD_TRACKID"])


@query(_describe_sql("lineitem", fx.MEASURES, ["l_returnflag"]))
def describe_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(fx.table(spark, sf_dir, "lineitem"), [*fx.MEASURES, "l_returnflag"])


def _corr_sql(table: str, columns: list[str]) -> str:
    """The columns turned into rows of name and value, joined with themselves by table row."""
    values = " union all ".join(f"select i, '{c}' as name, cast({c} as double) as v from numbered" for c in columns)
    return f"""with numbered as (select *, row_number() over () as i from {table}), v as ({values})
        select a.name as "row", b.name as "col", round(corr(a.v, b.v), 6) as r
        from v a join v b on a.i = b.i group by a.name, b.name"""


@query(_corr_sql("features", fx.FEATURES))
def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.correlation_matrix(fx.features(spark, sf_dir), fx.FEATURES).withColumn(
        "r", F.round("r", 6)
    )


@query(_corr_sql("lineitem", fx.MEASURES))
def measure_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.correlation_matrix(fx.table(spark, sf_dir, "lineitem"), fx.MEASURES).withColumn(
        "r", F.round("r", 6)
    )


def _quantile_sql(inner: str, column: str, probs: list[float]) -> str:
    return " union all ".join(
        f"select {p}::double as prob, round(quantile_cont(cast({column} as double), {p}), 6) as value from ({inner}) q"
        for p in probs
    )


_USER_PLAYS = "select user_id, sum(plays) as total_plays from triplets group by user_id"
_SONG_PLAYS = "select song_id, sum(plays) as total_plays from triplets group by song_id"
_USER_SONGS = "select user_id, count(distinct song_id) as n_songs from triplets group by user_id"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


@query(_quantile_sql(_USER_PLAYS, "total_plays", [0.01, 0.05, 0.4]))
def quantiles_plays_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ag.plays_by_user(fx.triplets(spark, sf_dir))
    return _rounded(ag.quantiles(df, "total_plays", [0.01, 0.05, 0.4]))


@query(_quantile_sql(_SONG_PLAYS, "total_plays", [0.01, 0.05, 0.5, 0.7]))
def quantiles_plays_by_song(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ag.plays_by_song(fx.triplets(spark, sf_dir))
    return _rounded(ag.quantiles(df, "total_plays", [0.01, 0.05, 0.5, 0.7]))


@query(_quantile_sql(_USER_SONGS, "n_songs", [0.01, 0.2, 0.4, 0.5]))
def quantiles_songs_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ag.distinct_songs_by_user(fx.triplets(spark, sf_dir))
    return _rounded(ag.quantiles(df, "n_songs", [0.01, 0.2, 0.4, 0.5]))


@query(_quantile_sql("select l_extendedprice from lineitem", "l_extendedprice", [0.0, 0.25, 0.333, 0.999, 1.0]))
def quantiles_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.table(spark, sf_dir, "lineitem")
    return _rounded(ag.quantiles(df, "l_extendedprice", [0.0, 0.25, 0.333, 0.999, 1.0]))


@query()
def approx_quantiles_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.approx_quantiles(
        fx.table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.25, 0.5, 0.75]
    )


@query("select p::double as prob, count(*) as n, true as rank_within_bound from lineitem, (values (0.25), (0.5), (0.75), (0.999)) t(p) group by p")
def approx_quantiles_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sketch's values are from their ranks, counted: no further than the accuracy allows."""
    prices, accuracy = fx.table(spark, sf_dir, "lineitem").select("l_extendedprice"), 1000
    sketch = ag.approx_quantiles(prices, "l_extendedprice", [0.25, 0.5, 0.75, 0.999], accuracy)
    found = sketch.agg(F.collect_list(F.struct("prob", "value"))).scalar()  # a value per quantile
    x = F.col("l_extendedprice")
    placed = prices.withColumn("q", found).select(x, F.inline("q"))
    counts = placed.groupBy("prob").agg(F.count(F.lit(1)).alias("n"), F.count_if(x < F.col("value")).alias("below"), F.count_if(x <= F.col("value")).alias("up_to"))
    wanted, slack = F.col("prob") * F.col("n"), F.col("n") / accuracy + 1
    return counts.select("prob", "n", ((F.col("below") - slack <= wanted) & (wanted <= F.col("up_to") + slack)).alias("rank_within_bound"))


def _histogram_sql(inner: str, column: str, bins: int, cut: int | None = None) -> str:
    where = f"where {column} < {cut}" if cut is not None else ""
    return f"""
        with v as (select cast({column} as double) as x from ({inner}) q {where}),
             b as (select min(x) as lo, max(x) as hi, (max(x) - min(x)) / {bins}.0::double as w from v),
             c as (select least(cast(floor((x - lo) / w) as bigint), {bins - 1}) as bin, count(*) as n
                   from v, b group by 1)
        select s.bin, lo + w * s.bin as lo, lo + w * (s.bin + 1) as hi, coalesce(n, 0) as n
        from (select cast(range as bigint) as bin from range({bins})) s cross join b
        left join c on c.bin = s.bin"""


@query(_histogram_sql(_USER_PLAYS, "total_plays", 1000))
def histogram_user_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.histogram(ag.plays_by_user(fx.triplets(spark, sf_dir)), "total_plays", 1000)


@query(_histogram_sql(_USER_PLAYS, "total_plays", 300, 1600))
def histogram_user_plays_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.histogram(ag.plays_by_user(fx.triplets(spark, sf_dir)), "total_plays", 300, 1600)


@query(_histogram_sql(_SONG_PLAYS, "total_plays", 1000))
def histogram_song_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.histogram(ag.plays_by_song(fx.triplets(spark, sf_dir)), "total_plays", 1000)


@query(_histogram_sql(_SONG_PLAYS, "total_plays", 400, 900))
def histogram_song_plays_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.histogram(ag.plays_by_song(fx.triplets(spark, sf_dir)), "total_plays", 400, 900)


@query(_histogram_sql(_USER_SONGS, "n_songs", 1000))
def histogram_user_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.histogram(ag.distinct_songs_by_user(fx.triplets(spark, sf_dir)), "n_songs", 1000)


@query(_histogram_sql(_USER_SONGS, "n_songs", 200, 60))
def histogram_user_songs_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.histogram(ag.distinct_songs_by_user(fx.triplets(spark, sf_dir)), "n_songs", 200, 60)


@query(_histogram_sql("select prediction from scored where not isnan(prediction)", "prediction", 100))
def histogram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores hold NaN, which has no bin."""
    return ag.histogram(fx.scored(spark, sf_dir), "prediction", 100)


@query(
    """select count(*) filter (where prediction is null) as n_null, count(*) filter (where isnan(prediction)) as n_nan,
              0::bigint as n_infinite from scored"""
)
def scores_without_a_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.non_finite(fx.scored(spark, sf_dir), "prediction")


# ---- windows, order, limit --------------------------------------------------

_RANKED = "select *, rank() over (partition by user_id order by plays desc) as rank from triplets"


@query(_RANKED)
def rank_songs_by_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.rank_within(fx.triplets(spark, sf_dir), "user_id", "plays")


@query(
    """select user_id, song_id, prediction,
              rank() over (partition by user_id order by prediction desc) as rank from scored"""
)
def rank_songs_by_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fx.scored(spark, sf_dir).select("user_id", "song_id", "prediction")
    return ordering.rank_within(scored, "user_id", "prediction")


@query(f"select * from ({_RANKED}) r where rank <= 10")
def top_songs_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.top_n_per_group(fx.triplets(spark, sf_dir), "user_id", "plays", 10)


@query(
    f"""select user_id, row_number() over (partition by user_id order by rank, song_id) as place, song_id
        from ({_RANKED}) r where rank <= 10"""
)
def top_song_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = fx.triplets(spark, sf_dir)
    lists = ordering.collect_top_items(plays, "user_id", "plays", "song_id", 10, LIST_CHUNK)
    return lists.select("user_id", "chunk", F.posexplode("items").alias("i", "song_id")).select(
        "user_id",
        (F.col("chunk") * F.lit(LIST_CHUNK) + F.col("i") + 1).cast("bigint").alias("place"),
        "song_id",
    )


@query(f"select * from ({_SONG_PLAYS.replace('sum(plays)', 'cast(sum(plays) as bigint)')}) s order by total_plays desc, song_id limit 25")
def most_played_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = ag.plays_by_song(fx.triplets(spark, sf_dir))
    return ag.top_k(totals, 25, F.col("total_plays").desc(), F.col("song_id"))


@query(
    f"""select user_id from (select distinct user_id from triplets) u
        order by {hash_sql(5, 'user_id')}, user_id limit 10"""
)
def random_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = fx.triplets(spark, sf_dir).select("user_id").distinct()
    return sampling.random_rows(users, 10, "user_id", 5)
