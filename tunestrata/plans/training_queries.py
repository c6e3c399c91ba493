"""Queries for splits, resampling and feature preparation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunestrata.operators import features as ft
from tunestrata.operators import sampling as sm
from tunestrata.plans import fixtures as fx
from tunestrata.plans.oracle_views import pair_sql, unit_sql
from tunestrata.plans.registry import query
from tunestrata.session import shared_path
from tunestrata.sources import checkpoint

SPLIT, UNDER, OVER, USERS = 21, 22, 23, 24
BINARY = {"Electronic": 0.7, "Other": 0.7}
ML_COLUMNS = ["track", *fx.FEATURES, "genres"]

# ---- splits -----------------------------------------------------------------


@query(
    f"""select track, genres, case when {unit_sql(SPLIT, 'track')} < 0.7 then 'train' else 'test' end as part
        from binary_tagged"""
)
def split_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.binary_tagged(spark, sf_dir).select("track", "genres")
    train, test = sm.stratified_split(rows, "track", SPLIT, BINARY, "genres")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    f"""select track, genres, case when {unit_sql(SPLIT, 'track')} <
               case genres when 'Electronic' then 0.9 when 'Jazz' then 0.25 else 0 end
               then 'train' else 'test' end as part
        from tagged"""
)
def split_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.tagged(spark, sf_dir).select("track", "genres")
    train, test = sm.stratified_split(rows, "track", SPLIT, {"Electronic": 0.9, "Jazz": 0.25}, "genres")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(f"select track, genres from tagged where {unit_sql(SPLIT, 'track')} < 0.7")
def split_every_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.tagged(spark, sf_dir).select("track", "genres")
    return sm.stratified_split(rows, "track", SPLIT, 0.7)[0]


@query(
    f"""select user_id, song_id, plays, case when {unit_sql(USERS, pair_sql())} < 0.21
               then 'test' else 'train' end as part
        from triplets"""
)
def split_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.triplets(spark, sf_dir)
    test, train = sm.stratified_split(rows, sm.key_of("user_id", "song_id"), USERS, 0.21)
    return test.withColumn("part", F.lit("test")).unionByName(train.withColumn("part", F.lit("train")))


@query("select track, genres, 1::bigint as n_parts from binary_tagged")
def split_binary_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part a row is drawn into is random; that it is in one of them is not."""
    rows = fx.binary_tagged(spark, sf_dir).select("track", "genres")
    parts = sm.stratified_split(rows, "track", SPLIT, BINARY, "genres", method="rng")
    return parts[0].unionByName(parts[1]).groupBy("track", "genres").agg(F.count(F.lit(1)).alias("n_parts"))


@query(
    f"""select part, genres, count(*) as n from (
            select genres, case when {unit_sql(SPLIT, 'track')} < 0.7 then 'train' else 'test' end as part
            from binary_tagged) s
        group by part, genres"""
)
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.binary_tagged(spark, sf_dir).select("track", "genres")
    train, test = sm.stratified_split(rows, "track", SPLIT, 0.7)
    return sm.class_balance(train, "genres").withColumn("part", F.lit("train")).unionByName(
        sm.class_balance(test, "genres").withColumn("part", F.lit("test"))
    )


# ---- resampling -------------------------------------------------------------

_RATES = """rates as (select count(*) filter (where genres = 'Electronic')::double as small,
                             count(*) filter (where genres <> 'Electronic')::double as large
                      from binary_tagged)"""


@query(
    f"""with {_RATES}
        select track, genres from binary_tagged, rates
        where genres = 'Electronic' or {unit_sql(UNDER, 'track')} < small / large"""
)
def undersample_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.binary_tagged(spark, sf_dir).select("track", "genres")
    return sm.undersample(rows, "genres", "Electronic", "track", UNDER)


@query(
    f"""with {_RATES},
             copies as (select track, genres,
                               case when genres <> 'Electronic' then 1
                                    else cast(floor(large / small) as bigint) +
                                         case when {unit_sql(OVER, 'track')} < large / small - floor(large / small)
                                              then 1 else 0 end end as n
                        from binary_tagged, rates)
        select track, genres from (select track, genres, unnest(range(n)) as i from copies) c"""
)
def oversample_minority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.binary_tagged(spark, sf_dir).select("track", "genres")
    return sm.oversample(rows, "genres", "Electronic", "track", OVER)


@query()
def undersample_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.binary_tagged(spark, sf_dir).select("track", "genres")
    return sm.undersample(rows, "genres", "Electronic", "track", UNDER, method="rng")


@query()
def oversample_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.binary_tagged(spark, sf_dir).select("track", "genres")
    return sm.oversample(rows, "genres", "Electronic", "track", OVER, method="rng")


@query(
    f"""select user_id, count(song_id) as n_songs from triplets group by user_id having count(song_id) > 30
        order by ('0x' || substr(md5(concat('{USERS}:', user_id)), 1, 8))::BIGINT, user_id limit 10"""
)
def sample_heavy_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.sample_heavy_users(fx.triplets(spark, sf_dir), 30, 10, USERS)


@query(
    f"""with heavy as (
            select user_id from triplets group by user_id having count(song_id) > 30
            order by ('0x' || substr(md5(concat('{USERS}:', user_id)), 1, 8))::BIGINT, user_id limit 10)
        select t.* from triplets t join heavy h on t.user_id = h.user_id"""
)
def songs_of_sampled_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.triplets(spark, sf_dir)
    return rows.join(sm.sample_heavy_users(rows, 30, 10, USERS).select("user_id"), "user_id")


# ---- feature preparation ----------------------------------------------------


def _index_sql(column: str, index: str, table: str) -> str:
    return f"""select {column}, cast(row_number() over (order by n desc, {column}) - 1 as double) as {index}
               from (select {column}, count(*) as n from {table} group by {column}) c"""


@query(_index_sql("user_id", "user_index", "triplets"))
def index_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.index_table(fx.triplets(spark, sf_dir), "user_id", "user_index")


@query(
    f"""with u as ({_index_sql("user_id", "user_index", "triplets")}),
             s as ({_index_sql("song_id", "song_index", "triplets")})
        select t.*, user_index, song_index
        from triplets t join u on t.user_id = u.user_id join s on t.song_id = s.song_id"""
)
def index_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored first: either index counts the triplets, and both are attached to them."""
    plays = checkpoint(fx.triplets(spark, sf_dir), shared_path(spark, "triplets"))
    return ft.index_strings(plays, {"user_id": "user_index", "song_id": "song_index"})[0]


@query(
    f"""with g as ({_index_sql("genres", "label", "tagged")})
        select track, t.genres, label from tagged t join g on t.genres = g.genres"""
)
def index_genre_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.tagged(spark, sf_dir).select("track", "genres")
    return ft.label_indexer("genres").fit(rows).transform(rows)


def _numbered(vector: str) -> list:
    """A vector as rows: position and value."""
    return [F.posexplode(vector_to_array(vector)).alias("place", "value")]


def _as_rows(columns: list[str], value: str) -> str:
    return " union all ".join(
        f"select track, {i} as place, {value.format(c=c)} as value from features_clean"
        for i, c in enumerate(columns)
    )


_CLEAN_FEATURES = "features_clean as (select replace(MSD_TRACKID, chr(39), '') as track, * from features)"


def _unquoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.features(spark, sf_dir).withColumn("track", F.translate("MSD_TRACKID", "'", ""))


@query(f"with {_CLEAN_FEATURES} {_as_rows(fx.FEATURES, '{c}')}")
def assemble_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ft.assemble(fx.FEATURES).transform(_unquoted(spark, sf_dir))
    return rows.select("track", *_numbered("features"))


@query(
    f"""with {_CLEAN_FEATURES}
        {_as_rows(fx.FEATURES, "round({c} / (select stddev_samp({c}) from features), 6)")}"""
)
def standardize_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _unquoted(spark, sf_dir)
    model = ft.build_pipeline([ft.assemble(fx.FEATURES, "features_original"), ft.standardize()]).fit(rows)
    return model.transform(rows).select("track", *_numbered("features")).withColumn(
        "value", F.round("value", 6)
    )


def _measures_sql(value: str) -> str:
    columns = ", ".join(f"round({value.format(c=c)}, 6) as {c}" for c in fx.MEASURES)
    bounds = ", ".join(
        f"stddev_samp({c}) as sd_{c}, min({c}) as lo_{c}, max({c}) as hi_{c}" for c in fx.MEASURES
    )
    return f"select l_orderkey, l_linenumber, {columns} from lineitem, (select {bounds} from lineitem) b"


def _measures(spark: SparkSession, sf_dir: str, scaler) -> DataFrame:
    rows = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *fx.MEASURES)
    model = ft.build_pipeline([ft.assemble(fx.MEASURES, "features_original"), scaler]).fit(rows)
    values = vector_to_array("features")
    return model.transform(rows).select(
        "l_orderkey",
        "l_linenumber",
        *(F.round(values[i], 6).alias(c) for i, c in enumerate(fx.MEASURES)),
    )


@query(_measures_sql("{c} / sd_{c}"))
def standardize_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measures(spark, sf_dir, ft.standardize())


@query(_measures_sql("({c} - lo_{c}) / (hi_{c} - lo_{c})"))
def minmax_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measures(spark, sf_dir, ft.minmax())


@query(
    f"""with g as ({_index_sql("genres", "label", "tagged")}),
             k as (select cast(max(label) as int) as last from g)
        select track, place, case when place = label then 1.0::double else 0.0::double end as value
        from (select track, label, unnest(range(last)) as place
              from tagged t join g on t.genres = g.genres, k) x"""
)
def one_hot_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.tagged(spark, sf_dir).select("track", "genres")
    model = ft.build_pipeline([ft.label_indexer("genres"), ft.one_hot("label", "genre_vector")]).fit(rows)
    return model.transform(rows).select("track", *_numbered("genre_vector")).withColumn(
        "place", F.col("place").cast("bigint")
    )
