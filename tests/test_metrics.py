import math

import pytest
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.mllib.evaluation import MulticlassMetrics, RankingMetrics
from pyspark.sql import functions as F

from helpers import rows
from tunestrata.operators import metrics as mt
from tunestrata.operators import recommend as rc
from tunestrata.operators.ordering import top_places
from tunestrata.plans import fixtures as fx

# Recorded test results of the binary models.
# TN, FP, FN, TP, accuracy, precision, recall and F1 of class 1.
RECORDED = """
LR                        113918     38 12270     2 0.902494 0.050000 0.000163 0.000325
LR-0.05                      770 113186   182 12090 0.101879 0.096507 0.985169 0.175793
LR-under                   77103  36853  4476  7796 0.672585 0.174606 0.635267 0.273924
LR-under-0.05                  0 113956     0 12272 0.097221 0.097221 1.000000 0.177213
LR-under-0.4               29342  84614  1324 10948 0.319184 0.114564 0.892112 0.203053
LR-over                    76547  37409  4442  7830 0.668449 0.173081 0.638038 0.272296
LR-over-0.4                28652  85304  1294 10978 0.313956 0.114019 0.894557 0.202259
LR-CV                      77197  36759  3970  8302 0.677338 0.184239 0.676499 0.289606
GBT                       113017    939 10736  1536 0.907509 0.620606 0.125163 0.208314
GBT-under                  85897  28059  3603  8669 0.749168 0.236032 0.706405 0.353837
GBT-over                   86052  27904  3568  8704 0.750673 0.237762 0.709257 0.356137
GBT-CV                     86052  27904  3568  8704 0.750673 0.237762 0.709257 0.356137
SVM                       113956      0 12272     0 0.902779 0.000000 0.000000 0.000000
SVM-under                  66662  47294  5253  7019 0.583714 0.129232 0.571952 0.210828
SVM-over                   63561  50395  5022  7250 0.560977 0.125770 0.590776 0.207389
SVM-CV                     77685  36271  5171  7101 0.671689 0.163723 0.578634 0.255230
RF                        113956      0 12272     0 0.902779 0.000000 0.000000 0.000000
RF-under                   86371  27585  4557  7715 0.745366 0.218555 0.628667 0.324350
RF-over                    80136  33820  3887  8385 0.701279 0.198673 0.683263 0.307836
NB                        113956      0 12272     0 0.902779 0.000000 0.000000 0.000000
NB-under                   73195  40761  6249  6023 0.627579 0.128741 0.490792 0.203976
"""


@pytest.mark.parametrize("line", RECORDED.strip().splitlines(), ids=lambda s: s.split()[0])
def test_recorded_results(spark, line):
    _, *numbers = line.split()
    tn, fp, fn, tp = map(int, numbers[:4])
    accuracy, precision, recall, f1 = map(float, numbers[4:])
    cells = spark.createDataFrame(
        [(a, b, n) for a, b, n in ((0.0, 0.0, tn), (0.0, 1.0, fp), (1.0, 0.0, fn), (1.0, 1.0, tp)) if n],
        "label double, prediction double, n bigint",
    )
    one = mt.per_class_metrics(cells).where("class = 1").first()
    assert (one["precision"], one["recall"], one["f1"]) == pytest.approx((precision, recall, f1), abs=1e-6)
    assert mt.overall_metrics(cells).first()["accuracy"] == pytest.approx(accuracy, abs=1e-6)


def test_classes_against_spark(spark, sf_dir):
    df = fx.judged_classes(spark, sf_dir).cache()
    cells = mt.confusion_cells(df)
    overall = mt.overall_metrics(cells).first()
    for ours, theirs in (
        ("accuracy", "accuracy"), ("weighted_f1", "f1"),
        ("weighted_precision", "weightedPrecision"), ("weighted_recall", "weightedRecall"),
    ):
        assert overall[ours] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(df))
    theirs = MulticlassMetrics(df.rdd.map(lambda r: (r["prediction"], r["label"])))
    for r in mt.per_class_metrics(cells).where("actual > 0").collect():
        assert r["precision"] == pytest.approx(theirs.precision(r["class"]))
        assert r["recall"] == pytest.approx(theirs.recall(r["class"]))
        assert r["f1"] == pytest.approx(theirs.fMeasure(r["class"]))
    matrix = mt.confusion_matrix(cells, [0, 1, 2, 3]).orderBy("label").collect()
    expected = theirs.confusionMatrix().toArray()
    for i, r in enumerate(matrix[:3]):
        assert list(r[1:4]) == expected[i].tolist()  # knows the actual classes only
    assert tuple(matrix[3]) == (3.0, 0, 0, 0, 0, 0)  # predicted, but no row is of this class


@pytest.mark.parametrize("score", ["score", "l_quantity"])
def test_areas_against_spark(spark, sf_dir, many_slices, score):
    df = fx.judged(spark, sf_dir).cache()
    ours = mt.binary_areas(df, score=score).first()
    for name, metric in (("auroc", "areaUnderROC"), ("aupr", "areaUnderPR")):
        judge = BinaryClassificationEvaluator(rawPredictionCol=score, metricName=metric, numBins=0)
        assert ours[name] == pytest.approx(judge.evaluate(df), abs=1e-12)


def test_constant_score(spark):
    df = spark.createDataFrame([(1.0, 0.3)] * 12 + [(0.0, 0.3)] * 88, "label double, score double")
    got = mt.binary_areas(df, score="score").first()
    assert (got["auroc"], got["aupr"]) == pytest.approx((0.5, 0.12))


def test_one_class_only(spark):
    df = spark.createDataFrame([(0.0, 0.1), (0.0, 0.2)], "label double, score double")
    got = mt.binary_areas(df, score="score").first()
    assert got["auroc"] is None and got["aupr"] is None


def test_report_holds_every_part(spark, sf_dir):
    df = fx.judged(spark, sf_dir)
    report = {(r["metric"], r["class"]): r["value"] for r in mt.classification_report(df, score="score").collect()}
    counts = mt.confusion_counts(df).first()
    assert report["confusion_as_1", 1.0] == counts["tp"] and report["confusion_as_1", 0.0] == counts["fp"]
    assert report["recall", 1.0] == pytest.approx(counts["tp"] / (counts["tp"] + counts["fn"]))
    assert ("auroc", None) in report and ("f1", 0.0) in report
    assert ("auroc", None) not in {(r[0], r[1]) for r in mt.classification_report(df, score=None).collect()}


def test_rmse_skips_nan(spark):
    df = spark.createDataFrame([(3, 1.0), (1, float("nan")), (2, None), (5, 5.0)], "plays int, prediction float")
    got = mt.rmse(df, "plays").first()
    kept = df.where("prediction is not null and not isnan(prediction)").select(F.col("plays").cast("double"), "prediction")
    assert got["n_rows"] == 2
    assert got["rmse"] == pytest.approx(RegressionEvaluator(labelCol="plays").evaluate(kept)) == pytest.approx(math.sqrt(2))


# ---- ranking ----------------------------------------------------------------


def lists(spark, users):
    said = [(u, s, i + 1) for u, (p, _) in users.items() for i, s in enumerate(p)]
    good = [(u, s) for u, (_, r) in users.items() for s in r]
    return mt.ranking_rows_from_lists(
        spark.createDataFrame(said, "user_id string, song_id string, position bigint"),
        spark.createDataFrame(good, "user_id string, song_id string"),
    )


def test_short_list(spark):
    got = mt.ranking_by_user(lists(spark, {"u": (["a", "b"], ["b", "c", "d"])})).first()
    assert got["precision_at_k"] == pytest.approx(0.2)
    assert got["ndcg_at_k"] == pytest.approx(0.29608, abs=1e-5)
    assert got["average_precision"] == pytest.approx(1 / 6)


def test_same_sets_have_full_average_precision(spark):
    songs = [f"s{i}" for i in range(12)]
    got = mt.ranking_by_user(lists(spark, {"u": (songs, songs[::-1])})).first()
    assert (got["precision_at_k"], got["ndcg_at_k"], got["average_precision"]) == pytest.approx((1, 1, 1))


def test_users_with_one_list_are_left_out(spark):
    users = {"u": (["a"], ["a"]), "v": (["a"], []), "w": ([], ["b"])}
    assert mt.ranking_metrics(lists(spark, users)).first()["n_users"] == 1


def test_ranking_against_spark(spark, sf_dir, many_slices):
    scored = fx.scored(spark, sf_dir).cache()
    ours = mt.ranking_metrics(mt.ranking_rows(scored, "prediction", "plays", 10)).first()
    pairs = rc.ranking_pairs(scored, "prediction", "plays", 10, 100_000)
    judge = RankingMetrics(pairs.select("predicted_songs", "actual_songs").rdd.map(tuple))
    assert ours["precision_at_k"] == pytest.approx(judge.precisionAt(5))
    assert ours["ndcg_at_k"] == pytest.approx(judge.ndcgAt(10))
    assert ours["mean_average_precision"] == pytest.approx(judge.meanAveragePrecision)
    assert ours["n_users"] == pairs.count() == scored.select("user_id").distinct().count()


def test_both_ways_to_build_ranking_rows_agree(spark, sf_dir):
    scored = fx.scored(spark, sf_dir).cache()
    direct = mt.ranking_rows(scored, "prediction", "plays", 10)
    pairs = rc.ranking_pairs(scored, "prediction", "plays", 10, 100_000)
    said = pairs.select("user_id", F.posexplode("predicted_songs").alias("i", "song_id")).select(
        "user_id", "song_id", (F.col("i") + 1).cast("bigint").alias("position")
    )
    good = pairs.select("user_id", F.explode("actual_songs").alias("song_id"))
    assert rows(direct) == rows(mt.ranking_rows_from_lists(said, good).select(direct.columns))


def test_both_lists_come_from_one_grouping(spark, sf_dir):
    """No join of two lists, and rows are cut for both before anything is shuffled."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("user_id"), F.col("l_partkey").alias("song_id"), "l_quantity", "l_tax"
    )
    plan = rc.ranking_pairs(df, "l_quantity", "l_tax", 10, 100)._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan
    for branch in plan.split("Exchange")[1:]:
        if "FileScan" in branch:
            assert "WindowGroupLimit" in branch.split("FileScan")[0]


def test_grouped_areas_are_those_of_each_group(spark, sf_dir):
    judged = fx.judged(spark, sf_dir).withColumn("g", F.col("l_linenumber")).withColumn("h", F.when(F.col("g") > 2, "x"))
    got = {(r["g"], r["h"]): (r["auroc"], r["aupr"]) for r in mt.grouped_areas(judged, ["g", "h"], "label", "score").collect()}
    assert len(got) > 3
    for (g, _), areas in got.items():
        one = mt.binary_areas(judged.where(F.col("g") == g), "label", "score").first()
        assert areas == pytest.approx((one["auroc"], one["aupr"]))
    by_group = mt.overall_metrics(mt.confusion_cells(judged, by=["g"]), ["g"]).collect()
    for r in by_group:
        one = mt.overall_metrics(mt.confusion_cells(judged.where(F.col("g") == r["g"]))).first()
        assert tuple(r)[1:] == pytest.approx(tuple(one))


def test_groups_without_positives_have_no_area(spark):
    df = spark.createDataFrame([("a", 0.0, 0.5), ("a", 0.0, 0.7), ("b", 1.0, 0.5), ("b", 0.0, 0.5), ("b", 1.0, None)], "g string, label double, score double")
    got = {r["g"]: r["auroc"] for r in mt.grouped_areas(df, ["g"]).collect()}
    assert got["a"] is None and got["b"] is not None


def test_places_of_a_top_list_reuse_the_shuffle_of_its_join(spark, many_slices):
    df = spark.createDataFrame(
        [(None, 1.0, "b"), (None, 1.0, "a"), ("u", -0.0, "d"), ("u", 0.0, "c"), ("u", -1.0, "e"), ("v", float("nan"), "f")],
        "user string, value double, item string",
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    places = top_places(df, "user", "value", "item", 2)
    plan = places._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The cut by task, the first places, and both sides of the join.
    assert plan.count("Exchange hashpartitioning") == 4
    assert sorted((r["user"] or "", r["item"], r["place"]) for r in places.collect()) == [
        ("", "a", 1), ("", "b", 2), ("u", "c", 1), ("u", "d", 2), ("v", "f", 1),
    ]
