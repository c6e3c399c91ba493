"""Queries for sources and sinks: derived tables are written out and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunestrata import sources as io
from tunestrata.plans import fixtures as fx
from tunestrata.plans.registry import query
from tunestrata.session import partition_sizes, shared_path
from tunestrata.sources import checkpoint, losses, malformed_lines, parse_marked, parse_match_log

TRIPLET_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("song_id", T.StringType()),
        T.StructField("plays", T.IntegerType()),
    ]
)
GENRE_SCHEMA = T.StructType(
    [T.StructField("track_id", T.StringType()), T.StructField("genres", T.StringType())]
)


@query("select * from features")
def read_csv_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.features(spark, sf_dir)
    path = shared_path(spark, "features-csv")
    df.write.csv(path, compression="gzip")
    return io.read_delimited(spark, path, df.schema)


@query("select * from triplets")
def read_tsv_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "triplets-tsv")
    fx.triplets(spark, sf_dir).write.csv(path, sep="\t", compression="gzip")
    return io.read_delimited(spark, path, TRIPLET_SCHEMA, sep="\t")


@query("select * from metadata")
def read_inferred_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "metadata-csv")
    fx.metadata(spark, sf_dir).write.csv(path, header=True, compression="gzip")
    return io.read_inferred(spark, path)


@query("select * from genres")
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.checkpoint(fx.genres(spark, sf_dir), shared_path(spark, "genres"))


@query("select genres, count(*) as n from genres group by genres")
def export_genre_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "genre-counts")
    io.export_csv(fx.genres(spark, sf_dir).groupBy("genres").agg(F.count("genres").alias("n")), path)
    return io.read_inferred(spark, path, T.StructType.fromDDL("genres string, n bigint"))


def _catalog(spark: SparkSession, sf_dir: str) -> io.Catalog:
    """The feature table laid out as one of the catalogue's sets, with its attribute file."""
    catalog = io.Catalog(shared_path(spark, "catalog"))
    name = catalog.names[2]
    df = fx.features(spark, sf_dir)
    df.write.csv(catalog.path(name), compression="gzip")
    words = {"double": "NUMERIC", "string": "STRING"}
    lines = [(f.name, words[f.dataType.simpleString()]) for f in df.schema.fields]
    spark.createDataFrame(lines, "name string, type string").coalesce(1).write.csv(
        catalog.attributes_path(name)
    )
    return catalog


@query("select * from features")
def read_by_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir)
    return catalog.read(spark, catalog.names[2])


@query(
    """select case p_type when 'ECONOMY' then 'NUMERIC' when 'LARGE' then 'real'
                          when 'SMALL' then 'STRING' else 'string' end as type,
              count(*) as n_columns
       from part group by 1"""
)
def attribute_type_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = (
        F.when(F.col("p_type") == "ECONOMY", "NUMERIC")
        .when(F.col("p_type") == "LARGE", "real")
        .when(F.col("p_type") == "SMALL", "STRING")
        .otherwise("string")
    )
    path = shared_path(spark, "attributes")
    fx.table(spark, sf_dir, "part").select("p_name", word.alias("type")).write.csv(path)
    return io.attribute_type_census(io.read_attributes(spark, path))


@query("select * from mismatches")
def parse_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "mismatch-log")
    fx.mismatch_lines(spark, sf_dir).write.text(path)
    return io.parse_match_log(spark.read.text(path))


@query("select * from accepted")
def parse_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "accepted-log")
    fx.accepted_lines(spark, sf_dir).write.text(path)
    return io.parse_match_log(spark.read.text(path), accepted=True)


@query("select count(*) as n_lines from triplets")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "triplets-lines")
    fx.triplets(spark, sf_dir).write.csv(path, sep="\t")
    return io.line_count(spark, path)


@query(
    """select user_id, song_id, plays from triplets
       order by plays desc, user_id, song_id limit 20"""
)
def preview_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.preview(
        fx.triplets(spark, sf_dir), 20, F.col("plays").desc(), F.col("user_id"), F.col("song_id")
    )


@query()
def storage_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.storage_inventory(spark, sf_dir)


@query("select count(*) as n_rows, true as every_partition_once from lineitem")
def partition_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per partition, added up; how many partitions there are is up to the scan."""
    sizes = partition_sizes(fx.table(spark, sf_dir, "lineitem").select("l_orderkey"))
    once = F.count("partition_id") == F.countDistinct("partition_id")
    return sizes.agg(F.sum("n_rows").alias("n_rows"), once.alias("every_partition_once"))


@query(
    "select cast(count(*) filter (where p_size <= 40) as bigint) as n_other, 0::bigint as n_malformed, "
    "count(*) filter (where p_size > 40) as n_parsed from part"
)
def match_log_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the log is parsed, malformed, or of another kind."""
    lines = fx.mismatch_lines(spark, sf_dir)
    parsed = parse_match_log(lines).agg(F.count(F.lit(1))).scalar()
    bad = malformed_lines(lines).agg(F.count(F.lit(1))).scalar()
    total = lines.agg(F.count(F.lit(1)).alias("n"))
    return total.select((F.col("n") - parsed - bad).alias("n_other"), bad.alias("n_malformed"), parsed.alias("n_parsed"))


@query(
    "select cast(count(*) filter (where p_size <= 40) as bigint) as n_other, 0::bigint as n_malformed, "
    "count(*) filter (where p_size > 40) as n_parsed, count(*) filter (where p_size > 40) as n_stored from part"
)
def losses_of_one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same figures from what one scan of the log has stored, and the rows of the parsed lines."""
    stored = checkpoint(parse_marked(fx.mismatch_lines(spark, sf_dir)), shared_path(spark, "marked-log"))
    parsed = stored.where("kind = 'parsed'").agg(F.count("song_id")).scalar()
    return losses(stored).withColumn("n_stored", parsed)
