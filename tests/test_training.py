import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from helpers import rows
from tunestrata.operators import classify as cl
from tunestrata.operators import features as ft
from tunestrata.operators import metrics as mt
from tunestrata.operators import recommend as rc
from tunestrata.operators import sampling as sm
from tunestrata.operators import tuning as tn
from tunestrata.plans import fixtures as fx


@pytest.fixture(scope="module")
def labelled(spark):
    df = spark.range(3000).select(
        F.concat(F.lit("k"), "id").alias("key"),
        F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 10 == 1, "other").otherwise("common").alias("g"),
    )
    return df.cache()


# ---- splits and resampling --------------------------------------------------


@pytest.mark.parametrize("method", ["hash", "rng"])
@pytest.mark.parametrize("fractions", [0.7, {"rare": 0.5, "common": 0.9}])
def test_split_is_a_partition(labelled, method, fractions):
    a, b = sm.stratified_split(labelled, "key", 3, fractions, "g", method)
    assert a.intersect(b).count() == 0
    assert rows(a.unionByName(b)) == rows(labelled)
    shares = {r["g"]: r["n"] for r in sm.class_balance(a, "g").collect()}
    totals = {r["g"]: r["n"] for r in sm.class_balance(labelled, "g").collect()}
    for g, n in totals.items():
        wanted = fractions.get(g, 0.0) if isinstance(fractions, dict) else fractions
        assert shares.get(g, 0) / n == pytest.approx(wanted, abs=0.07)
    again, _ = sm.stratified_split(labelled, "key", 3, fractions, "g", method)
    assert rows(a) == rows(again)


def test_hash_split_ignores_layout_and_depends_on_seed(labelled):
    a, _ = sm.stratified_split(labelled, "key", 3, 0.5)
    moved, _ = sm.stratified_split(labelled.repartition(13), "key", 3, 0.5)
    other, _ = sm.stratified_split(labelled, "key", 4, 0.5)
    assert rows(a) == rows(moved) != rows(other)


def test_null_stratum_goes_to_the_rest(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "key string, g string")
    a, b = sm.stratified_split(df, "key", 1, {"x": 1.0}, "g")
    assert rows(a) == [("b", "x")] and rows(b) == [("a", None)]


def test_rows_without_a_key_are_kept(spark):
    df = spark.createDataFrame([(None, "x"), ("a", "x")], "key string, g string")
    a, b = sm.stratified_split(df, "key", 1, 0.5)
    assert rows(a.unionByName(b)) == rows(df)


def test_numbers_can_be_indexed(spark):
    df = spark.createDataFrame([(7,), (7,), (3,)], "k int")
    table = ft.index_table(df, "k", "i")
    assert rows(ft.apply_index(df, table, "k", "i")) == [(3, 1.0), (7, 0.0), (7, 0.0)]


def test_holdout_is_the_complement(labelled):
    a, b = sm.stratified_split(labelled, "key", 3, 0.3)
    assert rows(sm.holdout(labelled, a, "key")) == rows(b)


@pytest.mark.parametrize("method", ["hash", "rng"])
def test_undersample(labelled, method):
    out = {r["g"]: r["n"] for r in sm.class_balance(sm.undersample(labelled, "g", "rare", "key", 5, method=method), "g").collect()}
    assert out["rare"] == 300
    assert out["common"] + out["other"] == pytest.approx(300, abs=60)
    fixed = sm.undersample(labelled, "g", "rare", "key", 5, fraction=0.0, method=method)
    assert fixed.count() == 300


@pytest.mark.parametrize("method", ["hash", "rng"])
def test_oversample(labelled, method):
    out = {r["g"]: r["n"] for r in sm.class_balance(sm.oversample(labelled, "g", "rare", "key", 5, method=method), "g").collect()}
    assert out["common"] + out["other"] == 2700
    assert out["rare"] == pytest.approx(2700, abs=160)
    part = sm.oversample(labelled, "g", "rare", "key", 5, rate=2.5, method=method).where("g = 'rare'")
    assert part.count() == pytest.approx(750, abs=90)
    if method == "hash":
        copies = part.groupBy("key").count()
        assert {r["count"] for r in copies.collect()} == {2, 3}
        below = sm.oversample(labelled, "g", "rare", "key", 5, rate=0.25).where("g = 'rare'")
        assert below.count() == below.distinct().count() < 150


def test_random_rows_and_heavy_users(spark, sf_dir):
    plays = fx.triplets(spark, sf_dir)
    picked = sm.sample_heavy_users(plays, 30, 10, 2)
    assert picked.count() == 10 and picked.agg(F.min("n_songs")).first()[0] > 30
    assert rows(picked) == rows(sm.sample_heavy_users(plays.repartition(5), 30, 10, 2))
    assert sm.random_rows(plays, 7, "song_id", 1, method="rng").count() == 7


# ---- features ---------------------------------------------------------------


def test_index_table_numbers_as_string_indexer_does(spark, sf_dir, many_slices):
    plays = fx.triplets(spark, sf_dir).cache()
    ours = ft.index_table(plays, "user_id", "i")
    theirs = StringIndexer(inputCol="user_id", outputCol="i").fit(plays).transform(plays)
    assert rows(ours) == rows(theirs.select("user_id", "i").distinct())


def test_unseen_values(spark):
    seen = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    table = ft.index_table(seen, "k", "i")
    assert rows(table) == [("a", 0.0), ("b", 1.0)]
    df = spark.createDataFrame([("a",), ("z",)], "k string")
    assert rows(ft.apply_index(df, table, "k", "i", "skip")) == [("a", 0.0)]
    assert rows(ft.apply_index(df, table, "k", "i", "keep")) == [("a", 0.0), ("z", None)]
    with pytest.raises(Exception, match="no index for k z"):
        ft.apply_index(df, table, "k", "i").collect()


def test_rows_outside_named_lose_their_ids_only(spark):
    df = spark.createDataFrame([("u", "s", 1), ("u", "t", 2), ("v", "t", 3), ("v", "t", None)], "user_id string, song_id string, plays int")
    whole, _ = rc.index_interactions(df)
    named = F.col("plays") >= 2
    short, tables = rc.index_interactions(df, named, "m")
    blank = [F.when(named, F.col(c)).alias(c) for c in ("user_id", "song_id")]
    expected = whole.select(*blank, "plays", "user_index", "song_index", F.coalesce(named, F.lit(False)).alias("m"))
    assert rows(short.select(*expected.columns)) == rows(expected)
    assert rows(tables["song_id"]) == [("s", 1.0), ("t", 0.0)]
    odd = spark.createDataFrame([(None, "s", 1)], df.schema)
    with pytest.raises(Exception, match="no index for user_id null"):
        rc.index_interactions(odd, named, "m")[0].collect()


def test_a_row_without_its_ids_is_not_sent_on_with_them(spark, many_slices):
    df = spark.createDataFrame([("u", "s", 1), ("v", "t", 2)], "user_id string, song_id string, plays int")
    plan = rc.index_interactions(df, F.col("plays") > 1, "m")[0]._jdf.queryExecution().optimizedPlan().toString()
    last = plan.index("Join LeftOuter")
    assert "AS user_id#" in plan[last:plan.index("Join LeftOuter", last + 1)]


def test_a_sample_is_what_a_split_takes(spark):
    df = spark.range(500).withColumn("k", F.col("id").cast("string"))
    taken, _ = sm.stratified_split(df, "k", 3, 0.21)
    assert rows(df.where(sm.in_sample("k", 3, 0.21))) == rows(taken) != []


def test_triplets_dealt_by_user(spark, many_slices, tmp_path):
    """The same rows, those of a user in a few tasks out of many."""
    lines = spark.range(400).select((F.col("id") % 200).alias("l_orderkey"), (F.col("id") % 100).alias("l_partkey"), F.lit(2.0).alias("l_quantity"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    key = F.when(F.col("id") % 2 == 0, F.lit(7)).cast("bigint")
    spark.range(200).select(F.col("id").alias("o_orderkey"), key.alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    plain, dealt = fx.triplets(spark, str(tmp_path)), fx.triplets(spark, str(tmp_path), by_user=True)
    tasks = [
        [r["count"] for r in df.withColumn("task", F.spark_partition_id()).select("user_id", "task").distinct().groupBy("user_id").count().collect()]
        for df in (plain, dealt)
    ]
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(str, plain.collect())) == sorted(map(str, dealt.collect()))
    assert min(tasks[0]) > fx.USER_SHARES >= max(tasks[1])


def test_scalers_on_constant_columns_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    for scaler, expected in ((ft.standardize(), 0.0), (ft.minmax(), 0.5)):
        model = ft.build_pipeline([ft.assemble(["x", "c"], "features_original"), scaler]).fit(df)
        values = model.transform(df).select(vector_to_array("features")[1].alias("c"))
        assert {r["c"] for r in values.collect()} == {expected}
    holes = spark.createDataFrame([(1.0, None)], "x double, c double")
    with pytest.raises(Exception):
        ft.assemble(["x", "c"]).transform(holes).collect()
    assert ft.assemble(["x", "c"], invalid="skip").transform(holes).count() == 0


def test_preparation_is_fitted_on_train_alone(spark):
    train = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("b", 1.0)], "genres string, x double")
    test = spark.createDataFrame([("a", 4.0), ("b", -2.0)], "genres string, x double")
    _, out, _ = ft.prepare(train, test, ["x"], "genres", ft.minmax())
    values = out.select("label", vector_to_array("features")[0])
    assert rows(values) == [(0.0, 2.0), (1.0, -1.0)]
    assert rows(ft.clip_to_unit(out).select(vector_to_array("features")[0])) == [(0.0,), (1.0,)]


# ---- classifiers ------------------------------------------------------------


@pytest.fixture(scope="module")
def binary(spark, sf_dir):
    df = fx.binary_tagged(spark, sf_dir)
    train, test = sm.stratified_split(df, "track", 3, 0.7)
    train, test, _ = ft.prepare(train, test, fx.FEATURES, "genres")
    return train.cache(), test.cache()


@pytest.mark.parametrize(
    ("make", "settings", "bound"),
    [
        (cl.binary_logistic, {}, 0.8),
        (cl.boosted_trees, {"seed": 1, "maxIter": 5}, 0.75),
        (cl.random_forest, {"seed": 1, "numTrees": 80, "maxDepth": 6}, 0.75),
        (cl.linear_svm, {"maxIter": 20}, 0.75),
    ],
)
def test_binary_models_learn(binary, make, settings, bound):
    train, test = binary
    scored = cl.score(make(**settings).fit(train), test)
    ours = mt.binary_areas(scored).first()
    for name, metric in (("auroc", "areaUnderROC"), ("aupr", "areaUnderPR")):
        theirs = BinaryClassificationEvaluator(metricName=metric, numBins=0).evaluate(scored)
        assert ours[name] == pytest.approx(theirs, abs=1e-9)
    assert ours["auroc"] > bound


def test_threshold_moves_predictions_but_not_areas(binary):
    train, test = binary
    model = cl.binary_logistic().fit(train)
    low, high = cl.score(model, test, 0.01), cl.score(model, test, 0.99)
    assert low.where("prediction = 1").count() > high.where("prediction = 1").count()
    assert mt.binary_areas(low).first() == mt.binary_areas(high).first()


def test_resampling_comparison(binary):
    train, test = binary
    variants = cl.training_variants(train, "genres", "Electronic", "track", 5)
    report = {r["variant"]: r for r in cl.compare_resampling(cl.binary_logistic(), variants, test).collect()}
    assert set(report) == {"plain", "under", "over"}
    assert report["under"]["recall"] >= report["plain"]["recall"]
    assert report["over"]["recall"] >= report["plain"]["recall"]


def test_trees_name_the_features_that_matter(binary):
    model = cl.boosted_trees(1, maxIter=5).fit(binary[0])
    found = {r["feature"]: r["importance"] for r in cl.feature_importances(model, fx.FEATURES).collect()}
    assert sum(found.values()) == pytest.approx(1.0)
    assert set(sorted(found, key=found.get)[-2:]) == {"f1", "f2"}


def test_most_confident_is_ordered(binary):
    scored = cl.score(cl.binary_logistic().fit(binary[0]), binary[1])
    p = [r["p_class"] for r in cl.most_confident(scored, 5, "track", cls=1).collect()]
    best = scored.select(F.max(vector_to_array("probability")[1])).first()[0]
    assert p == sorted(p, reverse=True) and len(p) == 5 and p[0] == best


def test_naive_bayes_needs_scaled_features(binary):
    with pytest.raises(Exception, match="Negative"):
        cl.naive_bayes().fit(binary[0])


def test_multinomial_beats_the_largest_class(spark, sf_dir):
    train, test = sm.stratified_split(fx.tagged(spark, sf_dir), "track", 3, 0.7)
    train, test, _ = ft.prepare(train, test, fx.FEATURES, "genres")
    scored = cl.score(cl.multinomial_logistic(regParam=0.01, elasticNetParam=0.1).fit(train), test)
    accuracy = mt.overall_metrics(mt.confusion_cells(scored)).first()["accuracy"]
    largest = test.groupBy("genres").count().agg(F.max("count")).first()[0] / test.count()
    assert accuracy > largest


def test_cross_validation(binary):
    model = tn.cross_validate(
        cl.binary_logistic(), {"regParam": [0.01, 50.0], "maxIter": [5]}, BinaryClassificationEvaluator(),
        binary[0], "track", 3, folds=2,
    )
    report = tn.tuning_report(model).collect()
    assert len(report) == 2 and sum(r["is_best"] for r in report) == 1
    best = max(report, key=lambda r: r["metric"])
    assert best["is_best"] and f"regParam={tn.best_parameters(model)['regParam']}" in best["setting"]


def test_study_grids_have_their_sizes(spark):
    makers = {
        "binary_logistic": (cl.binary_logistic(), 4),
        "boosted_trees": (cl.boosted_trees(1), 9),
        "linear_svm": (cl.linear_svm(), 12),
        "random_forest": (cl.random_forest(1), 6),
        "multinomial_logistic": (cl.multinomial_logistic(), 16 + 8),
    }
    for name, (estimator, size) in makers.items():
        assert len(tn.param_grid(estimator, tn.GRIDS[name])) == size


# ---- recommendation ---------------------------------------------------------


@pytest.fixture(scope="module")
def study(spark, sf_dir):
    indexed, tables = rc.index_interactions(fx.triplets(spark, sf_dir))
    test, train = sm.stratified_split(indexed.cache(), sm.key_of("user_id", "song_id"), 3, 0.21)
    return train, test, tables, rc.fit_als(train, 1)


def test_unseen_users_get_no_score(spark, study):
    pairs = spark.createDataFrame([(1e6, 0.0), (0.0, 0.0)], "user_index double, song_index double")
    out = {r["user_index"]: r["prediction"] for r in rc.predict_pairs(study[3], pairs).collect()}
    assert out[1e6] != out[1e6] and out[0.0] == out[0.0]


def test_recommendations_are_sorted_and_decoded(study):
    train, test, tables, model = study
    users = tables["user_id"].where("user_index < 3")
    recs = rc.recommend_for_users(model, users.unionByName(users), 10)
    for r in recs.collect():
        ratings = [x["rating"] for x in r["recommendations"]]
        assert len(ratings) == 10 and ratings == sorted(ratings, reverse=True)
    decoded = rc.decode_recommendations(recs, tables["user_id"], tables["song_id"])
    assert decoded.count() == 30 and decoded.where("user_id is null or song_id is null").count() == 0
    for_items = rc.recommend_for_all_items(model, 4)
    assert for_items.count() == train.select("song_index").distinct().count()


def test_card(spark, sf_dir, study):
    train, test, tables, model = study
    user = tables["user_id"].where("user_index = 0")
    name = user.first()["user_id"]
    recs = rc.decode_recommendations(rc.recommend_for_users(model, user, 10), tables["user_id"], tables["song_id"])
    card = rc.recommendation_card(name, train, test, fx.metadata(spark, sf_dir), recs)
    sides = {r["side"]: r["count"] for r in card.groupBy("side").count().collect()}
    assert sides["recommended"] == 10
    assert sides["train"] == train.where(F.col("user_id") == name).count()
    assert sides["test"] == test.where(F.col("user_id") == name).count()


def test_tuning_figures_are_returned(spark, sf_dir):
    """The metric of each setting, one best setting, its parameters and the held-out report."""
    from tunestrata.operators.tuning import GRIDS
    from tunestrata.plans import QUERIES

    assert {f"tuning_figures_{m}" for m in ("logistic", "boosted_trees", "linear_svm", "random_forest", "multinomial")} <= set(QUERIES)
    found = QUERIES["tuning_figures_logistic"](spark, sf_dir).collect()
    settings = [r for r in found if r["part"] == "setting"]
    assert len(settings) == len(GRIDS["binary_logistic"]["regParam"])
    best = [r for r in settings if r["said"] == "best"]
    assert len(best) == 1 and best[0]["value"] == max(r["value"] for r in settings)
    parameters = {r["name"]: r["said"] for r in found if r["part"] == "parameter"}
    assert f"regParam={parameters['regParam']}" in best[0]["name"]
    held_out = {r["name"] for r in found if r["part"] == "held_out"}
    assert {"accuracy", "weighted_f1", "precision", "recall", "auroc", "aupr"} <= held_out


def test_multinomial_thresholds_take_the_default_settings(spark, sf_dir, monkeypatch):
    from tunestrata.plans import QUERIES, model_queries

    asked, made = [], model_queries.cl.multinomial_logistic
    monkeypatch.setattr(model_queries.cl, "multinomial_logistic", lambda **s: asked.append(s) or made(**s))
    row = QUERIES["multinomial_thresholds"](spark, sf_dir).first()
    assert asked == [{}]
    assert row["class_0_said_more"] and row["others_said_less"]


def test_best_users_are_those_of_the_full_product(spark):
    """Against all products; and songs stop early where the lengths of factors differ."""
    rng = np.random.default_rng(2)
    lengths = np.r_[np.full(20, 5.0), np.full(400, 0.5)]
    users = rng.normal(size=(420, 6)) * lengths[:, None]
    songs = np.r_[rng.normal(size=(30, 6)), np.zeros((1, 6))]

    class Model:
        userFactors = spark.createDataFrame([(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(users)], "id int, features array<float>")
        itemFactors = spark.createDataFrame([(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(songs)], "id int, features array<float>")

    found = {}
    for r in rc.best_users_for_items(Model, k=7, block=16).collect():
        found.setdefault(r["song_index"], []).append((r["user_index"], r["rating"], r["n_blocks"]))
    product = songs.astype(np.float32).astype(float) @ users.astype(np.float32).astype(float).T
    for song, row in enumerate(product):
        best = sorted(range(420), key=lambda u: (-row[u], u))[:7]
        assert sorted(u for u, *_ in found[song]) == sorted(best)
        assert sorted(r for _, r, _ in found[song]) == pytest.approx(sorted(row[best]))
    visited = [found[s][0][2] for s in range(30)]
    assert max(visited) < 27 and min(visited) <= 3


def test_stacked_scores_are_those_of_each_model(spark):
    rows = [(float(i % 2), [float(i % 7), float(i % 5) + i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    models = [(cl.binary_logistic().fit(df), None), (cl.binary_logistic(regParam=0.01).fit(df), 0.2), (cl.linear_svm().fit(df), None), (cl.random_forest(3).fit(df), None)]
    got = {r["model"]: tuple(r)[1:] for r in cl.summary_rows(cl.stacked_scores(models, df)).collect()}
    for i, (model, threshold) in enumerate(models):
        one = cl.summary_row(cl.score(model, df, threshold)).first()
        assert got[i] == pytest.approx(tuple(one))


def _factors(spark, rows):
    return spark.createDataFrame([(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)], "id int, features array<float>")


def test_all_products_and_bounds_give_the_lists_of_spark(spark, study):
    """Songs for all users by bounds and by all products, against Spark's own lists, to the last digit."""
    model = study[3]
    wanted = {r["song_index"]: [x["rating"] for x in r["recommendations"]] for r in model.recommendForAllItems(7).collect()}
    for bounded in (True, False):
        rows = rc.recommend_for_all_items(model, 7, bounded).collect()
        assert {r["song_index"]: [x["rating"] for x in r["recommendations"]] for r in rows} == wanted
    assert rows[0].asDict(True)["recommendations"][0].keys() == {"user_index", "rating"}


def test_songs_are_not_sorted_with_all_users(spark, monkeypatch):
    """Ties, zeros and fewer users than places; products are compiled, and lists cut before the shuffle."""
    class Model:
        userFactors = _factors(spark, [[0.0, 0.0], [1.0, 1.0], [1.0, 1.0], [-1.0, 2.0]] * 40)
        itemFactors = _factors(spark, [[0.0, 0.0], [1.0, 1.0], [-3.0, 0.5]])

    plans, kept = [], rc._best_of
    monkeypatch.setattr(rc, "_best_of", lambda *a: plans.append(kept(*a)) or plans[-1])
    for bounded in (True, False):
        got = {r["song_index"]: [x["user_index"] for x in r["recommendations"]] for r in rc.recommend_for_all_items(Model, 3, bounded).collect()}
        assert got == {0: [0, 1, 2], 1: [1, 2, 5], 2: [3, 7, 11]}
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" in plan and "WindowGroupLimit" in plan
    few = {r["song_index"]: len(r["recommendations"]) for r in rc.recommend_for_all_items(Model, 200).collect()}
    assert few == {0: 160, 1: 160, 2: 160}


def test_fits_hold_nothing_in_memory(spark, study, monkeypatch):
    """Ratings are not cached beside Spark's own blocks, and those and the factors lie on disk."""
    from pyspark.sql import DataFrame as Frame

    fitted, cached = [], []
    kept, persist = rc.ALS.fit, Frame.persist
    monkeypatch.setattr(rc.ALS, "fit", lambda self, df: fitted.append(self) or kept(self, df))
    monkeypatch.setattr(Frame, "persist", lambda self, *level: cached.append(self) or persist(self, *level))
    model = rc.fit_als(study[0], 1)
    assert not cached
    assert fitted[0].getIntermediateStorageLevel() == fitted[0].getFinalStorageLevel() == "DISK_ONLY"
    ours, theirs = ({r["id"]: r["features"] for r in m.userFactors.collect()} for m in (model, study[3]))
    assert ours == theirs
