import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import rows
from tunestrata.functions import (
    binarize_label,
    count_nan,
    drop_nan,
    feature_columns,
    hash_bucket,
    strip_quotes,
)
from tunestrata.operators import aggregates as ag
from tunestrata.operators import features as ft
from tunestrata.operators import joins
from tunestrata.operators import ordering as od
from tunestrata.plans import fixtures as fx
from tunestrata.session import apply_skew_settings, shared_path


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


# ---- scalar functions -------------------------------------------------------


def test_strip_quotes_and_binarize(spark):
    df = frame(spark, [("'a''b'", "Rock"), (None, None), ("c", "Jazz")], "x string, g string")
    assert rows(df.select(strip_quotes("x"), binarize_label("g", "Rock"))) == sorted(
        [("ab", "Rock"), (None, "Other"), ("c", "Other")], key=repr
    )


def test_nan_is_not_null(spark):
    df = frame(spark, [(1.0,), (float("nan"),), (None,)], "x double")
    assert rows(drop_nan(df, "x")) == [(1.0,)]
    assert rows(count_nan(df, "x")) == [(1, 3)]


def test_feature_columns_and_hash(spark):
    df = frame(spark, [("k", 1)], "id string, f int")
    assert feature_columns(df, ["id"]) == ["f"]
    import hashlib

    expected = int(hashlib.md5(b"3:k").hexdigest()[:8], 16)
    assert df.select(hash_bucket("id", 3)).first()[0] == expected


# ---- joins ------------------------------------------------------------------


def test_exclude_keeps_null_keys(spark):
    df = frame(spark, [("a", 1), ("b", 2), (None, 3)], "song_id string, v int")
    bad = frame(spark, [("a",), ("a",), (None,)], "song_id string")
    assert rows(joins.exclude(df, bad, "song_id")) == sorted([("b", 2), (None, 3)], key=repr)


def test_exclude_two_keys(spark):
    df = frame(spark, [("u", "a"), ("u", "b"), ("v", "a")], "user_id string, song_id string")
    bad = frame(spark, [("u", "a")], "user_id string, song_id string")
    assert rows(joins.exclude(df, bad, ["user_id", "song_id"])) == [("u", "b"), ("v", "a")]


def test_accepted_song_clears_all_its_mismatches(spark):
    wrong = frame(spark, [("a", "t1"), ("a", "t2"), ("b", "t3")], "song_id string, track_id string")
    fine = frame(spark, [("a", "t1")], "song_id string, track_id string")
    assert rows(joins.rejected_songs(wrong, fine).select("song_id")) == [("b",)]
    pairs = joins.rejected_songs(wrong, fine, ("song_id", "track_id"))
    assert rows(pairs.select("song_id", "track_id")) == [("a", "t2"), ("b", "t3")]
    plays = frame(spark, [("u", "a", 1), ("u", "b", 2), ("v", "c", 3)], "user_id string, song_id string, plays int")
    left = joins.clean_triplets(plays, wrong, fine)
    assert rows(left.select("user_id", "song_id", "plays")) == [("u", "a", 1), ("v", "c", 3)]
    assert rows(joins.clean_plays_by_song(plays, wrong, fine)) == [("a", 1), ("c", 3)]


def test_attach_genre_drops_unmatched(spark):
    features = frame(spark, [("'A'", 1.0), ("'B'", 2.0), (None, 3.0)], "MSD_TRACKID string, f double")
    genres = frame(spark, [("A", "Rock"), ("C", "Jazz"), (None, "Pop")], "track_id string, genres string")
    assert rows(joins.attach_genre(features, genres)) == [("A", 1.0, "Rock")]


def test_pruning_uses_the_incoming_table(spark):
    plays = frame(
        spark,
        [("u", "a", 5), ("u", "b", 1), ("v", "a", 5), ("w", "a", 1), ("w", "c", 9)],
        "user_id string, song_id string, plays int",
    )
    kept = joins.prune_interactions(plays, min_song_plays=2, min_user_songs=2)
    assert rows(kept.select("user_id", "song_id")) == [("u", "a"), ("w", "a"), ("w", "c")]
    assert rows(joins.prune_users(kept, 2).select("user_id").distinct()) == [("w",)]


def test_decode_keeps_unknown_index(spark):
    recs = frame(spark, [(0.0, [(1.0, 0.5), (9.0, 0.4)])], "user_index double, recommendations array<struct<song_index:double,rating:double>>")
    flat = joins.explode_recommendations(recs, "user_index", "song_index")
    songs = frame(spark, [(1.0, "a"), (1.0, "a")], "song_index double, song_id string")
    assert rows(joins.decode_index(flat, songs, "song_index").select("song_index", "rating", "song_id")) == [
        (1.0, 0.5, "a"), (9.0, 0.4, None),
    ]


# ---- order without single-task windows --------------------------------------


def skewed(spark, n=600):
    """One user holds a third of all rows, many of them tied; some values null or NaN."""
    rng = np.random.default_rng(4)
    data = []
    for i in range(n):
        user = "hot" if i % 3 == 0 else (None if i % 31 == 1 else f"u{i % 17}")
        value = float(rng.integers(0, 12))
        value = None if i % 29 == 0 else (float("nan") if i % 37 == 0 else value)
        data.append((user, f"s{i:04d}", value))
    return frame(spark, data, "user_id string, song_id string, plays double")


def as_text(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("descending", [True, False])
def test_rank_of_hot_groups_equals_plain_rank(spark, many_slices, descending):
    df = skewed(spark)
    order = F.col("plays").desc() if descending else F.col("plays").asc()
    plain = df.withColumn("rank", F.rank().over(Window.partitionBy("user_id").orderBy(order)).cast("bigint"))
    assert as_text(od.rank_within(df, "user_id", "plays", descending=descending)) == as_text(plain)
    floats, whole = df.withColumn("plays", F.col("plays").cast("float")), df.withColumn("plays", F.expr("try_cast(plays as int)"))
    for kind in (floats, whole):
        plain = kind.withColumn("rank", F.rank().over(Window.partitionBy("user_id").orderBy(order)).cast("bigint"))
        assert as_text(od.rank_within(kind, "user_id", "plays", descending=descending)) == as_text(plain)


def test_numbers_of_all_sizes_keep_their_order(spark):
    values = [0.0, -0.0, 5e-324, -5e-324, 1.0, -1.0, 1.0000000000000002, 1e308, -1e308, float("inf"), float("-inf"), float("nan"), None, 3.5, 2.0**60]
    df = frame(spark, [("g", v) for v in values], "g string, v double")
    whole = frame(spark, [("g", v) for v in (0, 1, -1, 2**63 - 1, -(2**63), 2**42, 2**42 + 1, -(2**42), None)], "g string, v bigint")
    for table in (df, whole):
        for descending in (True, False):
            order = F.col("v").desc() if descending else F.col("v").asc()
            plain = table.withColumn("rank", F.rank().over(Window.partitionBy("g").orderBy(order)).cast("bigint"))
            assert as_text(od.rank_within(table, "g", "v", descending=descending)) == as_text(plain)
    with pytest.raises(ValueError, match="no number"):
        od.number_digits(frame(spark, [("a",)], "v string"), "v")


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("n", [1, 3, 40])
def test_top_n_of_hot_groups_equals_plain_rank(spark, many_slices, n, descending):
    df = skewed(spark).repartition(5)
    order = F.col("plays").desc() if descending else F.col("plays").asc()
    plain = df.withColumn("rank", F.rank().over(Window.partitionBy("user_id").orderBy(order)).cast("bigint"))
    top = od.top_n_per_group(df, "user_id", "plays", n, descending=descending)
    assert as_text(top) == as_text(plain.where(F.col("rank") <= n))


def test_ranks_start_no_job_and_name_no_keys(spark):
    """Plans are made without looking at the data, hold no values of it, and force no broadcast."""
    df = skewed(spark).repartition(5)
    spark.sparkContext.setJobGroup("plans-only", "")
    frames = [od.rank_within(df, "user_id", "plays"), od.top_n_per_group(df, "user_id", "plays", 3), od.collect_top_items(df, "user_id", "plays", "song_id", 3, 10)]
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in frames]
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans-only")
    spark.sparkContext.setJobGroup("others", "")
    for plan in plans:
        assert " IN (" not in plan and "hot" not in plan and "strategy=broadcast" not in plan


@pytest.fixture
def hot_song(spark, sf_dir):
    """Plays of which more than half go to one song, under settings that make this a skew."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8000",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    apply_skew_settings(spark)
    for k, v in settings.items():
        spark.conf.set(k, v)
    path = shared_path(spark, "hot-song")
    fx.table(spark, sf_dir, "lineitem").repartition(8).select(
        F.when(F.col("l_quantity") < 30, "hot").otherwise(F.col("l_partkey").cast("string")).alias("song_id"),
        F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("user_id"),
        F.col("l_extendedprice").alias("plays"),
    ).write.parquet(path)
    yield spark.read.parquet(path)
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def splits(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("skew=true")


def test_hot_join_keys_are_split(spark, sf_dir, hot_song):
    bad = frame(spark, [(str(i),) for i in range(0, 200, 9)] * 2, "song_id string")
    assert splits(joins.exclude(hot_song, bad, "song_id"))
    # Also where the next step groups by the join key.
    assert splits(joins.exclude(hot_song, bad, "song_id").groupBy("song_id").agg(F.sum("plays")))
    wrong, fine = fx.mismatches(spark, sf_dir), fx.accepted(spark, sf_dir)
    assert splits(joins.clean_triplets(hot_song, wrong, fine))
    assert splits(joins.prune_interactions(hot_song, 600_000, 2))
    assert splits(joins.attach_metadata(hot_song, fx.metadata(spark, sf_dir)))
    assert splits(ft.apply_index(hot_song, ft.index_table(hot_song, "song_id", "i"), "song_id", "i"))
    index = hot_song.select("song_id", F.hash("song_id").alias("i"))
    assert splits(joins.decode_index(hot_song, index, "song_id"))


def test_top_n_keeps_ties_and_lists_are_ordered(spark, many_slices):
    df = frame(
        spark,
        [("u", "b", 3), ("u", "a", 3), ("u", "c", 2), ("u", "d", 2), ("u", "e", 1), ("v", "x", 1)],
        "user_id string, song_id string, plays int",
    )
    top = od.top_n_per_group(df, "user_id", "plays", 3)
    assert rows(top.where("user_id = 'u'").select("song_id", "rank")) == [("a", 1), ("b", 1), ("c", 3), ("d", 3)]
    lists = od.collect_top_items(df, "user_id", "plays", "song_id", 3, 100_000)
    assert rows(lists) == [("u", 0, ["a", "b", "c", "d"]), ("v", 0, ["x"])]
    chunks = od.collect_top_items(df, "user_id", "plays", "song_id", 3, 3)
    assert rows(chunks) == [("u", 0, ["a", "b", "c"]), ("u", 1, ["d"]), ("v", 0, ["x"])]


def test_top_n_is_cut_before_the_shuffle(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    for top in (
        od.top_n_per_group(df, "l_orderkey", "l_quantity", 2),
        od.collect_top_items(df, "l_orderkey", "l_quantity", "l_linenumber", 2, 100_000),
    ):
        plan = top._jdf.queryExecution().executedPlan().toString()
        scans = plan.count("FileScan")
        # Each read of the table is cut beside the scan, before its first exchange.
        assert plan.count("WindowGroupLimit") >= 2 * scans
        for branch in plan.split("Exchange")[1:]:
            if "FileScan" in branch:
                assert "WindowGroupLimit" in branch.split("FileScan")[0]


def test_running_totals(spark, many_slices):
    df = frame(spark, [(f"g{i % 2}", i, i % 5) for i in range(200)], "g string, v int, n int")
    out = od.running_totals(df, [F.col("v").desc()], ["n"])
    plain = {v: sum(k % 5 for k in range(v + 1, 200)) for v in range(200)}
    assert {r["v"]: r["n_before"] for r in out.collect()} == plain
    digits = od.number_digits(df, "v", descending=False)
    within = od.totals_before(df.withColumns(digits), ["g"], list(digits), ["n"])
    plain = {v: sum(k % 5 for k in range(v % 2, v, 2)) for v in range(200)}
    assert {r["v"]: r["n_before"] for r in within.collect()} == plain


def test_global_positions(spark, many_slices):
    df = frame(spark, [(i * 7 % 500,) for i in range(500)], "v int")
    out = od.global_positions(df, [F.col("v").desc()], "place")
    assert {r["v"]: r["place"] for r in out.collect()} == {v: 499 - v for v in range(500)}


# ---- aggregates -------------------------------------------------------------


def test_counts_and_nulls(spark):
    df = frame(spark, [("a",), ("a",), (None,)], "k string")
    assert [tuple(r) for r in ag.count_by(df, "k").collect()] == [("a", 2), (None, 0)]
    assert ag.distinct_count(df, "k").first()[0] == 2
    assert ag.drill_down(df, k="a").count() == 2


def test_bitmaps_count_like_distinct(spark, sf_dir):
    rng = np.random.default_rng(6)
    data = [(f"g{i % 3}" if i % 11 else None, int(rng.integers(0, 90_000)) if i % 13 else None) for i in range(6000)]
    df = frame(spark, data, "g string, i bigint").repartition(4)
    plain = df.where("i is not null").groupBy("g").agg(F.countDistinct("i").alias("n"))
    bitmaps = ag.distinct_by_bitmap(df, ["g"], "i")
    assert rows(bitmaps) == rows(plain)

    def shuffled(counts):
        counts.collect()
        plan, total = counts._jdf.queryExecution().executedPlan().finalPhysicalPlan(), 0
        todo = [plan]
        while todo:
            node = todo.pop()
            if node.nodeName().startswith("ShuffleQueryStage"):
                node = node.plan()
            metric = node.metrics().get("shuffleBytesWritten")
            total += metric.get().value() if metric.isDefined() else 0
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        return total

    # Lines of few flags and many orders, each order several times: whole pairs against bits.
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linestatus", (F.col("l_orderkey") % 20_000).alias("i")).repartition(4)
    by_pairs, by_bits = lines.groupBy("l_linestatus").agg(F.countDistinct("i").alias("n")), ag.distinct_by_bitmap(lines, ["l_linestatus"], "i")
    assert rows(by_bits) == rows(by_pairs)
    big = lines.select("l_linestatus", F.explode(F.sequence(F.col("i"), F.col("i") + 40)).alias("i"))
    plain, bits = big.groupBy("l_linestatus").agg(F.countDistinct("i").alias("n")), ag.distinct_by_bitmap(big, ["l_linestatus"], "i")
    assert 0 < shuffled(bits) < shuffled(plain)


def test_describe(spark):
    df = frame(spark, [("b", 1), ("a", 3), (None, None)], "s string, x int")
    got = {r["column"]: r for r in ag.describe_features(df).collect()}
    assert (got["s"]["n"], got["s"]["min_text"], got["s"]["max_text"], got["s"]["mean"]) == (2, "a", "b", None)
    assert (got["x"]["n"], got["x"]["mean"], got["x"]["max_value"]) == (2, 2.0, 3.0)
    assert got["x"]["stddev"] == pytest.approx(math.sqrt(2))


def test_correlations_against_numpy(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(60, 3))
    data[:, 2] += data[:, 0]
    df = frame(spark, [(*map(float, r), 4.0) for r in data], "a double, b double, c double, k double")
    got = {(r["row"], r["col"]): r["r"] for r in ag.correlation_matrix(df, ["a", "b", "c", "k"]).collect()}
    expected = np.corrcoef(data.T)
    for i, x in enumerate("abc"):
        for j, y in enumerate("abc"):
            assert got[x, y] == pytest.approx(expected[i, j])
        assert math.isnan(got[x, "k"]) and math.isnan(got["k", x])
    assert got["k", "k"] == 1.0


def test_correlations_of_few_rows(spark):
    schema = "a double, b double"
    for data in ([], [(1.0, 2.0)], [(1.0, None), (None, 2.0)]):
        got = {(r["row"], r["col"]): r["r"] for r in ag.correlation_matrix(frame(spark, data, schema), ["a", "b"]).collect()}
        assert got["a", "a"] == got["b", "b"] == 1.0 and math.isnan(got["a", "b"]) and math.isnan(got["b", "a"])


def test_correlations_with_large_means(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 2)) + 1e9
    df = frame(spark, [tuple(map(float, r)) for r in data], "a double, b double").repartition(7)
    spark.sparkContext.setJobGroup("correlations", "")
    matrix = ag.correlation_matrix(df, ["a", "b"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("correlations")
    spark.sparkContext.setJobGroup("others", "")
    got = {(r["row"], r["col"]): r["r"] for r in matrix.collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef((data - 1e9).T)[0, 1], abs=1e-6)


def test_quantiles_sort_nothing_but_digits(spark):
    df = frame(spark, [(float(i % 97) - 40,) for i in range(900)] + [(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double")
    got = ag.quantiles(df, "x", [0.0, 0.3, 1.0])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    found = dict(map(tuple, got.collect()))
    assert found[0.0] == float("-inf") and found[1.0] == float("inf")
    assert rows(ag.quantiles(df.where("false"), "x", [0.5, 0.9])) == [(0.5, None), (0.9, None)]


@pytest.mark.parametrize("n", [1, 2, 5, 500])
def test_quantiles_interpolate(spark, many_slices, n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 40, n).astype(float)
    df = frame(spark, [(float(v),) for v in values] + [(None,)], "x double")
    probs = [0.0, 0.05, 0.4, 0.5, 0.77, 1.0]
    got = dict(map(tuple, ag.quantiles(df, "x", probs).collect()))
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p))
    approx = dict(map(tuple, ag.approx_quantiles(df, "x", probs).collect()))
    assert approx[0.0] == values.min() and approx[1.0] == values.max()


@pytest.mark.parametrize("cut", [None, 30.0])
def test_histogram_matches_numpy(spark, cut):
    rng = np.random.default_rng(9)
    values = rng.gamma(2, 10, 400).round(1)
    df = frame(spark, [(float(v),) for v in values] + [(None,)], "x double")
    got = ag.histogram(df, "x", 16, cut).orderBy("bin").collect()
    counts, edges = np.histogram(values if cut is None else values[values < cut], 16)
    assert [r["n"] for r in got] == counts.tolist()
    assert [r["lo"] for r in got] == pytest.approx(edges[:-1])
    assert [r["hi"] for r in got] == pytest.approx(edges[1:])


def test_histogram_of_one_value(spark):
    got = ag.histogram(frame(spark, [(5.0,)] * 3, "x double"), "x", 4).orderBy("bin").collect()
    assert [r["n"] for r in got] == np.histogram([5.0] * 3, 4)[0].tolist()
    assert (got[0]["lo"], got[-1]["hi"]) == (4.5, 5.5)


# ---- plans ------------------------------------------------------------------


def test_lookup_reaches_the_scan(spark, sf_dir):
    df = ag.drill_down(fx.table(spark, sf_dir, "lineitem"), l_orderkey=7).select("l_quantity")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_orderkey,7)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_no_python_runs_on_executors():
    """None of the library's modules outside the training-data package defines code for Python workers."""
    root = Path(od.__file__).resolve().parents[1]
    words = ("pandas_udf", "applyInPandas", "mapInPandas", "mapInArrow", "applyInArrow", "F.udf(", "@udf", ".rdd", "mapPartitions")
    for module in sorted(root.rglob("*.py")):
        if "llm" not in module.relative_to(root).parts:
            assert not [w for w in words if w in module.read_text()], module
