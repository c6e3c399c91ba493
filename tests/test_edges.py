"""Rows that do not fit: NaN, infinities, missing classes, nulls in keys, long ids."""

import math

import pytest
from pyspark.sql import functions as F

from tunestrata.functions import hash_bucket
from tunestrata.operators import aggregates as ag
from tunestrata.operators import classify as cl
from tunestrata.operators import metrics as mt
from tunestrata.operators import recommend as rc
from tunestrata.operators import sampling as sm
from tunestrata.plans import fixtures as fx
from tunestrata.sources import malformed_lines, parse_match_log

NAN, INF = float("nan"), float("inf")


def test_histogram_leaves_out_what_has_no_place(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 5.0, NAN, INF, -INF, None)], "x double")
    bins = ag.histogram(df, "x", 4).orderBy("bin").collect()
    assert [r["n"] for r in bins] == [1, 1, 1, 1]
    assert (bins[0]["lo"], bins[-1]["hi"]) == (1.0, 5.0)
    assert tuple(ag.non_finite(df, "x").first()) == (1, 1, 2)


def test_quantiles_skip_nan(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, NAN, None)], "x double")
    assert [r["value"] for r in ag.quantiles(df, "x", [0.0, 0.5, 1.0]).orderBy("prob").collect()] == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("width", [2, 6, 7, 12])
def test_correlations_have_one_form(spark, width):
    names = [f"c{i}" for i in range(width)]
    schema = ", ".join(f"{n} double" for n in names)
    rows = [tuple(float((i * (j + 3) * 7919) % 101) if j else 5.0 for j in range(width)) for i in range(30)]
    cells = ag.correlation_matrix(spark.createDataFrame(rows, schema), names).collect()
    assert len(cells) == width * width
    assert all(r["r"] == 1 for r in cells if r["row"] == r["col"])
    assert all(math.isnan(r["r"]) for r in cells if (r["row"] == "c0") != (r["col"] == "c0"))
    for few in ([], rows[:1]):
        made = ag.correlation_matrix(spark.createDataFrame(few, schema), names).collect()
        assert all(r["r"] == 1 if r["row"] == r["col"] else math.isnan(r["r"]) for r in made)


def test_confusion_matrix_counts_every_row(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 9.0), (1.0, 0.0), (7.0, 1.0), (1.0, None)], "label double, prediction double")
    rows = {r["label"]: tuple(r)[1:] for r in mt.confusion_matrix(mt.confusion_cells(df), [0, 1, 2]).collect()}
    assert rows == {0.0: (1, 0, 0, 1), 1.0: (1, 0, 0, 1), 2.0: (0, 0, 0, 0), 7.0: (0, 1, 0, 0)}


def test_unscored_songs_are_in_no_list(spark):
    rows = [("u", "a", NAN, 5), ("u", "b", 2.0, 4), ("u", "c", 1.0, 3), ("v", "a", NAN, 1)]
    df = spark.createDataFrame(rows, "user_id string, song_id string, prediction double, plays int")
    lists = mt.ranking_rows(df, "prediction", "plays", 2)
    assert sorted((r["song_id"], r["position"]) for r in lists.collect()) == [("b", 1), ("c", 2)]
    assert rc.ranking_pairs(df, "prediction", "plays", 2, 10).select("predicted_songs").first()[0] == ["b", "c"]


@pytest.mark.parametrize("method", ["hash", "rng"])
def test_oversample_without_a_minority(spark, method):
    df = spark.createDataFrame([("a", i) for i in range(5)], "label string, i int")
    assert sm.oversample(df, "label", "b", "i", 1, method=method).count() == 5


def test_pair_keys_differ(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("c", None), ("", "c"), ("c", "")]
    df = spark.createDataFrame(rows, "x string, y string")
    keys = [r[0] for r in df.select(sm.key_of("x", "y")).collect()]
    assert len(set(keys)) == len(rows) and None not in keys
    assert df.select(hash_bucket(sm.key_of("x", "y"), 1)).distinct().count() == len(rows)


def test_long_ids_stay_whole(spark):
    df = spark.createDataFrame([(7,), (123456789,), (123456780,)], "o_custkey bigint")
    assert [r[0] for r in df.select(fx._padded("o_custkey", 8)).collect()] == ["00000007", "123456789", "123456780"]


def test_lines_with_other_breaks_and_losses(spark):
    good = f"ERROR: <{'S' * 18} {'T' * 18}> a  -  b\u2028c  !=  d  -  e"
    lines = spark.createDataFrame([(good,), ("ERROR: odd",), ("note",)], "value string")
    assert parse_match_log(lines).first()["song_title"] == "b\u2028c"
    assert malformed_lines(lines).count() == 1


def test_als_blocks(spark):
    rows = [(float(u), float(s), (u * s) % 5 + 1) for u in range(40) for s in range(30)]
    df = spark.createDataFrame(rows, "user_index double, song_index double, plays int")
    model = rc.fit_als(df, 1, blocks=13, maxIter=1)
    assert model.userFactors.rdd.getNumPartitions() == 13
    assert model.itemFactors.rdd.getNumPartitions() == 13


def test_one_threshold_is_refused_for_several_classes(spark):
    class Several:
        numClasses = 3

    with pytest.raises(ValueError, match="one per class"):
        cl.score(Several(), spark.range(1), 0.05)


def test_nulls_in_keys_go_to_one_side(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",)], "k string")
    taken, rest = sm.stratified_split(df, "k", 3, 0.5)
    assert taken.count() + rest.count() == 3
    assert taken.where(F.col("k").isNull()).count() in (0, 2)
