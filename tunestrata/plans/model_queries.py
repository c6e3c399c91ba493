"""Queries that fit models: classifiers, cross-validation, recommendation."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunestrata.operators import classify as cl
from tunestrata.operators import features as ft
from tunestrata.operators import inspection as ins
from tunestrata.operators import metrics as mt
from tunestrata.operators import recommend as rc
from tunestrata.operators import sampling as sm
from tunestrata.operators import tuning as tn
from tunestrata.operators.ordering import position_within
from tunestrata.plans import fixtures as fx
from tunestrata.plans.metric_queries import areas_sql, per_class_sql, report_sql
from tunestrata.plans.oracle_views import hash_sql, pair_sql, unit_sql
from tunestrata.plans.registry import query
from tunestrata.session import cluster_slots, held, shared_path
from tunestrata.sources import checkpoint, load_model, save_model

SEED = 7


def _prepared(rows: DataFrame, scaler=None) -> tuple[DataFrame, DataFrame]:
    """Training and test part, split by track and prepared on the training part."""
    train, test = sm.stratified_split(rows, "track", SEED, 0.7)
    return ft.prepare(train, test, fx.FEATURES, "genres", scaler)[:2]


def _binary(spark: SparkSession, sf_dir: str, scaler=None) -> tuple[DataFrame, DataFrame]:
    """Written once before the fits: each of them reads the table many times."""
    rows = checkpoint(fx.binary_tagged(spark, sf_dir), shared_path(spark, "binary-tagged"))
    return _prepared(rows, scaler)


def _multi(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _prepared(checkpoint(fx.tagged(spark, sf_dir), shared_path(spark, "tagged")))


def _compared(spark: SparkSession, sf_dir: str, estimator, **kw) -> DataFrame:
    train, test = _binary(spark, sf_dir)
    made = cl.training_variants(train, "genres", "Electronic", "track", SEED)
    return cl.compare_resampling(estimator, made, test, **kw)


# ---- classifiers ------------------------------------------------------------


@query()
def logistic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _binary(spark, sf_dir)
    return mt.classification_report(cl.score(cl.binary_logistic().fit(train), test))


@query()
def logistic_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _binary(spark, sf_dir)
    model = cl.binary_logistic().fit(train)
    rows = None
    for t in (0.5, 0.4, 0.05):
        row = cl.summary_row(cl.score(model, test, t)).select(F.lit(t).alias("threshold"), "*")
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query()
def logistic_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, cl.binary_logistic(), thresholds={"over": (0.4,), "under": (0.05, 0.4)})


@query()
def multinomial_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _multi(spark, sf_dir)
    scored = cl.score(cl.multinomial_logistic().fit(train), test)
    return mt.classification_report(scored, score=None)


@query()
def boosted_trees_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, cl.boosted_trees(SEED))


@query()
def boosted_trees_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _binary(spark, sf_dir)
    model = cl.boosted_trees(SEED).fit(train)
    return cl.feature_importances(model, fx.FEATURES)


@query()
def linear_svm_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, cl.linear_svm())


@query()
def random_forest_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, cl.random_forest(SEED))


def _scaled(expression: str) -> str:
    return ", ".join(
        expression.format(v=f"({c} - lo_{c}) / (hi_{c} - lo_{c})", c=c) for c in fx.FEATURES
    )


# Naive Bayes has a closed form, so fit and scores can be written as SQL: training rows
# scaled to [0, 1], sums per class (each row as often as its weight says), then the log parameters.
def _bayes_sql(weight: str = "1") -> str:
    return f"""
    t as (select *, {unit_sql(SEED, 'track')} as u from binary_tagged where {unit_sql(SEED, 'track')} < 0.7),
    e as (select * from binary_tagged where {unit_sql(SEED, 'track')} >= 0.7),
    b as (select {", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in fx.FEATURES)},
                 count(*) filter (where genres = 'Electronic')::double as small,
                 count(*) filter (where genres <> 'Electronic')::double as large from t),
    s as (select case when genres = 'Electronic' then 1.0::double else 0.0::double end as class, {weight} as weight,
                 {_scaled("{v} as {c}")} from t, b),
    sums as (select class, sum(weight)::double as n, {", ".join(f"sum({c} * weight) as {c}" for c in fx.FEATURES)}
             from s group by class),
    whole as (select *, {" + ".join(fx.FEATURES)} as total, sum(n) over () as n_all, count(*) over () as k from sums),
    logs as (select class, ln(n + 1) - ln(n_all + k) as pi,
                    {", ".join(f"ln({c} + 1) - ln(total + {len(fx.FEATURES)}) as t_{c}" for c in fx.FEATURES)} from whole),
    x as (select track, genres, {_scaled("greatest(least({v}, 1), 0) as {c}")} from e, b),
    raws as (select track, genres, class, pi + {" + ".join(f"{c} * t_{c}" for c in fx.FEATURES)} as raw from x, logs),
    scores as (select track, genres, case when genres = 'Electronic' then 1.0::double else 0.0::double end as label,
                      max(raw) filter (where class = 1) as raw1,
                      1 / (1 + exp(max(raw) filter (where class = 0) - max(raw) filter (where class = 1))) as p,
                      case when max(raw) filter (where class = 1) > max(raw) filter (where class = 0)
                           then 1.0::double else 0.0::double end as prediction
               from raws group by track, genres)"""


_BAYES = _bayes_sql()
#: How often a training row counts in each variant.
_WEIGHTS = {
    "plain": "1",
    "under": "case when genres = 'Electronic' or u < small / large then 1 else 0 end",
    "over": "case when genres <> 'Electronic' then 1 else floor(large / small) + case when u < large / small - floor(large / small) then 1 else 0 end end",
}


def _variant_sql(name: str) -> str:
    return f"""select * from (
        with {_bayes_sql(_WEIGHTS[name])}, p as ({per_class_sql('scores')}), a as ({areas_sql('scores', 'raw1', 'label')})
        select '{name}' as variant, null::double as threshold, auroc, aupr,
               (select round(avg(case when label = prediction then 1.0::double else 0.0::double end), 6) from scores) as accuracy,
               round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1
        from a, p where class = 1) {name}"""


@query(" union all ".join(map(_variant_sql, _WEIGHTS)))
def naive_bayes_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _binary(spark, sf_dir, ft.minmax())
    made = cl.training_variants(train, "genres", "Electronic", "track", SEED)
    rows = cl.compare_resampling(cl.naive_bayes(), made, ft.clip_to_unit(test))
    return rows.withColumns({c: F.round(c, 6) for c in ("auroc", "aupr", "accuracy", "precision", "recall", "f1")})


def _bayes(spark: SparkSession, sf_dir: str):
    """The fitted model and the scored test part."""
    train, test = _binary(spark, sf_dir, ft.minmax())
    model = cl.naive_bayes().fit(train)
    return model, cl.score(model, ft.clip_to_unit(test))


@query(
    f"with {_BAYES} "
    + " union all ".join(
        f"select class, '{c}' as feature, round(t_{c}, 6) as theta, round(pi, 6) as pi from logs" for c in fx.FEATURES
    )
)
def naive_bayes_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    parameters = cl.bayes_parameters(_bayes(spark, sf_dir)[0], fx.FEATURES)
    return parameters.withColumns({c: F.round(c, 6) for c in ("theta", "pi")})


@query(f"with {_BAYES} select track, genres, label, round(p, 6) as p, prediction from scores")
def naive_bayes_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vector_to_array("probability")[1]
    return _bayes(spark, sf_dir)[1].select(
        "track", "genres", "label", F.round(p, 6).alias("p"), "prediction"
    )


@query(f"with {_BAYES}, {report_sql('scores', 'raw1')}")
def naive_bayes_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.classification_report(_bayes(spark, sf_dir)[1]).withColumn("value", F.round("value", 6))


@query(
    f"""with {_BAYES}
        select track, genres, round(1 - p, 6) as p_class, prediction from scores order by 1 - p desc, track limit 10"""
)
def most_confident_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = cl.most_confident(_bayes(spark, sf_dir)[1], 10, "track")
    return best.select("track", "genres", F.round("p_class", 6).alias("p_class"), "prediction")


@query()
def reloaded_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _binary(spark, sf_dir)
    path = shared_path(spark, "logistic-model")
    save_model(cl.binary_logistic().fit(train), path)
    scored = cl.score(load_model(LogisticRegressionModel, path), test)
    return scored.select("track", vector_to_array("probability")[1].alias("p"), "prediction")


@query()
def quality_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second binary task of another kind: four text statistics against a quality label."""
    text = F.col("text")
    words = F.split(text, r"\s+")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    names = ["log_chars", "letter_share", "distinct_share", "word_length"]
    rows = (
        fx.table(spark, sf_dir, "documents")
        .join(fx.table(spark, sf_dir, "labels"), "doc_id")
        .select(
            F.col("doc_id").alias("track"),
            F.log1p("n_chars").alias("log_chars"),
            F.try_divide(letters, F.col("n_chars")).alias("letter_share"),
            (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_share"),
            (F.col("n_chars") / F.size(words)).alias("word_length"),
            F.when(F.col("quality") == 1, "good").otherwise("poor").alias("genres"),
        )
        .na.fill(0.0, names)
    )
    rows = checkpoint(rows, shared_path(spark, "documents"))
    train, test = sm.stratified_split(rows, "track", SEED, 0.7)
    train, test, _ = ft.prepare(train, test, names, "genres")
    return cl.summary_row(cl.score(cl.boosted_trees(SEED).fit(train), test))


# ---- model selection --------------------------------------------------------


def _auroc() -> BinaryClassificationEvaluator:
    """The area without down-sampling, so that it is the same figure however it is worked out."""
    return BinaryClassificationEvaluator(numBins=0)


def _cross_validated(train: DataFrame, estimator, grid: dict, evaluator) -> CrossValidatorModel:
    slots = cluster_slots(train.sparkSession)
    with held(train) as cached:
        return tn.cross_validate(estimator, grid, evaluator, cached, "track", SEED, parallelism=slots)


def _tuning_figures(train: DataFrame, test: DataFrame, estimator, grid: dict, evaluator, score: str | None = "rawPrediction") -> DataFrame:
    """``part, name, class, value, said``: the metric of each setting (``said`` is "best" for the chosen one),
    the parameters of the refitted model, and its full report on the test part."""
    model = _cross_validated(train, estimator, grid, evaluator)
    settings = tn.tuning_report(model).select(
        F.lit("setting").alias("part"),
        F.col("setting").alias("name"),
        F.lit(None).cast("double").alias("class"),
        F.col("metric").alias("value"),
        F.when(F.col("is_best"), "best").alias("said"),
    )
    best = [("parameter", name, None, None, str(value)) for name, value in sorted(tn.best_parameters(model).items())]
    chosen = train.sparkSession.createDataFrame(best, "part string, name string, class double, value double, said string")
    report = mt.classification_report(cl.score(model.bestModel, test), score=score).select(
        F.lit("held_out").alias("part"), F.col("metric").alias("name"), "class", "value", F.lit(None).cast("string").alias("said")
    )
    return settings.union(chosen).union(report)


def _tuned(train: DataFrame, test: DataFrame, estimator, grid: dict, evaluator, metric: str, bound: float) -> DataFrame:
    """A row per setting of the grid: its metric worked out a second time, from the scores of all folds
    and settings in one grouped pass, beside what the validator says; and the tuned model on the test part.

    The figures themselves are rows of ``tuning_figures_*``; here is what must hold on any data.
    """
    slots = cluster_slots(train.sparkSession)
    with held(train) as cached:
        model = tn.cross_validate(estimator, grid, evaluator, cached, "track", SEED, parallelism=slots, keep_models=True)
        scores = checkpoint(tn.fold_scores(model, cached, "track", SEED), shared_path(train.sparkSession, "fold-scores"))
    ours = tn.fold_metrics(scores, metric).groupBy("setting").agg(F.avg("metric").alias("ours"))
    seen = scores.groupBy("setting").agg(F.count(F.lit(1)).alias("n_scores"))
    settings = tn.tuning_report(model)
    both = checkpoint(settings.join(ours, "setting").join(seen, "setting"), shared_path(train.sparkSession, "tuning"))
    best = tn.best_parameters(model)
    figures = mt.classification_report(cl.score(model.bestModel, test), score=None).where("metric = 'accuracy'").select("value").scalar()
    chosen = both.where("is_best").first()["setting"]
    kept = all(str(best[name]) == value for name, value in (p.split("=") for p in chosen.split(", ")))
    top = both.agg(F.max("ours"), F.count_if("is_best")).first()
    first = both.where("is_best").first()["ours"]
    return both.select(
        "setting",
        (F.abs(F.col("ours") - F.col("metric")) <= 1e-9).alias("worked_out_the_same"),
        "n_scores",
        F.lit(top[1]).cast("bigint").alias("n_best"),
        F.lit(top[0] - first <= 1e-9).alias("best_by_ours"),
        F.lit(kept).alias("refitted_with_best"),
        test.agg(F.count(F.lit(1))).scalar().alias("n_test"),
        (figures >= bound).alias("held_out_fine"),
    )


# Training rows by class, and how many of the majority the undersampled set keeps.
_TRAIN_SIZES = f"""
    t as (select genres = 'Electronic' as small, {unit_sql(SEED, 'track')} as u from binary_tagged
          where {unit_sql(SEED, 'track')} < 0.7),
    sizes as (select count(*) filter (where small)::double as s, count(*) filter (where not small)::double as l from t),
    even as (select count(*) as n from t, sizes where small or u < s / l)"""


def _tuning_sql(model: str, table: str, train: str) -> str:
    """Every setting of the grid, the rows scored for it, one best, all test rows."""
    names = sorted(tn.GRIDS[model])
    settings = [""]
    for name in names:
        settings = [f"{s}, {name}={v}" for s in settings for v in tn.GRIDS[model][name]]
    listed = ", ".join(f"('{s[2:]}')" for s in settings)
    return f"""with {_TRAIN_SIZES}
               select setting, true as worked_out_the_same, ({train}) as n_scores, 1::bigint as n_best, true as best_by_ours,
                      true as refitted_with_best,
                      (select count(*) from {table} where {unit_sql(SEED, 'track')} >= 0.7) as n_test, true as held_out_fine
               from (values {listed}) g(setting)"""


_EVEN, _ALL_BINARY = "select n from even", "select count(*) from t"
_ALL_TAGGED = f"select count(*) from tagged where {unit_sql(SEED, 'track')} < 0.7"


def _balanced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    train, test = _binary(spark, sf_dir)
    return sm.undersample(train, "genres", "Electronic", "track", SEED), test


@query(_tuning_sql("binary_logistic", "binary_tagged", _EVEN))
def tune_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = tn.GRIDS["binary_logistic"]
    return _tuned(*_balanced(spark, sf_dir), cl.binary_logistic(), grid, _auroc(), "auroc", 0.5)


@query(_tuning_sql("boosted_trees", "binary_tagged", _EVEN))
def tune_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = tn.GRIDS["boosted_trees"]
    return _tuned(*_balanced(spark, sf_dir), cl.boosted_trees(SEED), grid, _auroc(), "auroc", 0.5)


@query(_tuning_sql("linear_svm", "binary_tagged", _EVEN))
def tune_linear_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = tn.GRIDS["linear_svm"]
    return _tuned(*_balanced(spark, sf_dir), cl.linear_svm(), grid, _auroc(), "auroc", 0.3)


@query(_tuning_sql("random_forest", "binary_tagged", _ALL_BINARY))
def tune_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the whole training set; the others take the undersampled one."""
    grid = tn.GRIDS["random_forest"]
    return _tuned(*_binary(spark, sf_dir), cl.random_forest(SEED), grid, _auroc(), "auroc", 0.5)


@query(_tuning_sql("multinomial_logistic", "tagged", _ALL_TAGGED))
def tune_multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = tn.GRIDS["multinomial_logistic"]
    return _tuned(*_multi(spark, sf_dir), cl.multinomial_logistic(), grid, MulticlassClassificationEvaluator(), "weighted_f1", 0.25)


@query(
    f"""select (select count(*) from binary_tagged where {unit_sql(SEED, 'track')} >= 0.7) as n_rows, 0::bigint as n_different,
               {len(tn.GRIDS['binary_logistic']['regParam'])}::bigint as n_settings, true as same_metrics"""
)
def reloaded_tuned_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tuned model with its grid and metrics, saved and loaded: same settings, same scores."""
    train, test = _balanced(spark, sf_dir)
    model = _cross_validated(train, cl.binary_logistic(), tn.GRIDS["binary_logistic"], _auroc())
    path = shared_path(spark, "tuned-model")
    save_model(model, path)
    loaded = load_model(CrossValidatorModel, path)
    p = vector_to_array("probability")[1]
    before = cl.score(model.bestModel, test).select("track", p.alias("p"), "prediction")
    after = cl.score(loaded.bestModel, test).select("track", p.alias("q"), F.col("prediction").alias("said"))
    same = list(model.avgMetrics) == list(loaded.avgMetrics) and tn.best_parameters(model) == tn.best_parameters(loaded)
    return before.join(after, "track", "full").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("p").eqNullSafe(F.col("q")) | ~F.col("prediction").eqNullSafe(F.col("said"))).alias("n_different"),
        F.lit(len(loaded.avgMetrics)).cast("bigint").alias("n_settings"),
        F.lit(same).alias("same_metrics"),
    )


# ---- figures of the tuned models, which have no counterpart in SQL -----------


@query()
def tuning_figures_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = tn.GRIDS["binary_logistic"]
    return _tuning_figures(*_balanced(spark, sf_dir), cl.binary_logistic(), grid, BinaryClassificationEvaluator())


@query()
def tuning_figures_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = tn.GRIDS["boosted_trees"]
    return _tuning_figures(*_balanced(spark, sf_dir), cl.boosted_trees(SEED), grid, BinaryClassificationEvaluator())


@query()
def tuning_figures_linear_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = tn.GRIDS["linear_svm"]
    return _tuning_figures(*_balanced(spark, sf_dir), cl.linear_svm(), grid, BinaryClassificationEvaluator())


@query()
def tuning_figures_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = tn.GRIDS["random_forest"]
    return _tuning_figures(*_binary(spark, sf_dir), cl.random_forest(SEED), grid, BinaryClassificationEvaluator())


@query()
def tuning_figures_multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = tn.GRIDS["multinomial_logistic"]
    return _tuning_figures(
        *_multi(spark, sf_dir), cl.multinomial_logistic(), grid, MulticlassClassificationEvaluator(), score=None
    )


# ---- statements about models that SQL can check -----------------------------


@query(
    f"""select model, (select count(*) from binary_tagged where {unit_sql(SEED, 'track')} >= 0.7) as n_test,
               (select count(*) from binary_tagged where {unit_sql(SEED, 'track')} >= 0.7 and genres = 'Electronic') as n_positive,
               true as finite_scores, true as better_than_chance
        from (values ('boosted_trees'), ('linear_svm'), ('logistic'), ('random_forest')) m(model)"""
)
def classifier_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each binary classifier with its own settings on the held-out part."""
    train, test = _binary(spark, sf_dir)
    made = {
        "logistic": cl.binary_logistic(), "boosted_trees": cl.boosted_trees(SEED),
        "linear_svm": cl.linear_svm(), "random_forest": cl.random_forest(SEED),
    }
    with held(train) as cached:
        models = {name: estimator.fit(cached) for name, estimator in made.items()}
    scores = cl.stacked_scores([(model, None) for model in models.values()], test)
    counts = scores.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.count_if(F.col("label") == 1).alias("n_positive"),
        F.every(~F.isnan("score")).alias("finite_scores"),
    )
    areas = mt.grouped_areas(scores, ["model"]).select("model", (F.col("auroc") > 0.5).alias("better_than_chance"))
    name = F.array(*map(F.lit, models))[F.col("model")]
    return counts.join(areas, "model").withColumn("model", name)


# ---- models taken apart -----------------------------------------------------

# Gradient steps over lists: features by their sample deviation on the training part, two classes, an
# L2 penalty of 0.3. The step is below 2 over the largest curvature (a quarter of the features' largest
# eigenvalue, some 2, plus the penalty); the slowest direction shrinks by a tenth a step.
_DESCENT = f"""
    cut as (select track, genres, {unit_sql(SEED, 'track')} < 0.7 as train, [{", ".join(fx.FEATURES)}] as f from binary_tagged),
    devs as (select list(sd order by j) as sd from (
                 select j, stddev_samp(f[j]) as sd from cut, range(1, {len(fx.FEATURES) + 1}) t(j) where train group by j)),
    x as (select track, genres, train, case when genres = 'Electronic' then 1.0::double else 0.0::double end as y,
                 list_transform(range(1, {len(fx.FEATURES) + 1}), lambda j: f[j] / sd[j]) as v from cut, devs),
    n as (select count(*)::double as n from x where train),
    g as (
        select 0 as step, list_transform(range({len(fx.FEATURES)}), lambda j: 0.0::double) as w, 0.0::double as b
        union all
        select any_value(step) + 1, list(w_j - (s / any_n + 0.3 * w_j) order by j), any_value(b - e / any_n)
        from (select j, any_value(step) as step, any_value(w[j]) as w_j, any_value(b) as b, any_value(n) as any_n,
                     sum(err * v[j]) as s, sum(err) as e
              from (select step, w, b, n, v, 1 / (1 + exp(-(b + list_inner_product(w, v)))) - y as err
                    from g, n, x where train and step < 400) d,
                   range(1, {len(fx.FEATURES) + 1}) t(j)
              group by j) sums
        having count(*) > 0),
    found as (select w, b from g where step = 400)"""


@query(
    f"""with recursive {_DESCENT}
        select track, genres, round(1 / (1 + exp(-(b + list_inner_product(w, v)))), 4) as p,
               case when b + list_inner_product(w, v) > 0 then 1.0::double else 0.0::double end as prediction, true as default_fit_near
        from x, found where not train"""
)
def logistic_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test probabilities at the optimum of the default logistic model, which SQL finds by gradient steps;
    the fit of 20 rounds is that close to it."""
    train, test = _binary(spark, sf_dir)
    with held(train) as cached:
        usual = cl.binary_logistic().fit(cached)
        tight = cl.binary_logistic(maxIter=500, tol=1e-13).fit(cached)
    p = vector_to_array("probability")[1]
    near = cl.score(usual, test).select("track", p.alias("q"))
    return cl.score(tight, test).join(near, "track").select(
        "track", "genres", F.round(p, 4).alias("p"), "prediction", (F.abs(p - F.col("q")) < 0.01).alias("default_fit_near")
    )


_N_TRAIN = f"(select count(*) from binary_tagged where {unit_sql(SEED, 'track')} < 0.7)"


@query(
    f"""select model, {_N_TRAIN} as n_train, true as objective_the_same, n_coefficients, true as at_optimum
        from (values ('linear_svm', 0), ('logistic', 65), ('logistic_l1', 65)) m(model, n_coefficients)
        union all select 'multinomial_l1', (select count(*) from tagged where {unit_sql(SEED, 'track')} < 0.7), true,
               65 * (select count(distinct genres) from tagged where {unit_sql(SEED, 'track')} < 0.7), true"""
)
def linear_models_taken_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objective each fit says it reached, worked out again from its coefficients and all training
    rows; and for logistic models fitted to the end, the condition every coefficient must meet."""
    train, _ = _binary(spark, sf_dir)
    multi, _ = _multi(spark, sf_dir)
    tight = {"maxIter": 500, "tol": 1e-12}
    made = {
        "linear_svm": (train, cl.linear_svm(), None),
        "logistic": (train, cl.binary_logistic(), cl.binary_logistic(**tight)),
        "logistic_l1": (train, cl.binary_logistic(regParam=0.05, elasticNetParam=0.8), cl.binary_logistic(regParam=0.05, elasticNetParam=0.8, **tight)),
        "multinomial_l1": (multi, cl.multinomial_logistic(), cl.multinomial_logistic(**tight)),
    }
    out = []
    for name, (rows, usual, to_the_end) in made.items():
        with held(rows) as cached:
            model = usual.fit(cached)
            summary = model.summary() if callable(model.summary) else model.summary
            said, ours = float(summary.objectiveHistory[-1]), ins.linear_objective(model, cached)
            count, worst = 0, 0.0
            if to_the_end is not None:
                figures = ins.optimality(to_the_end.fit(cached), cached).agg(F.count(F.lit(1)), F.max("residual")).first()
                count, worst = int(figures[0]), float(figures[1])
            out.append((name, cached.count(), abs(said - ours) <= 1e-9 * max(1.0, abs(said)), count, worst <= 1e-4))
    return spark.createDataFrame(out, "model string, n_train bigint, objective_the_same boolean, n_coefficients bigint, at_optimum boolean")


_N_TEST = f"(select count(*) from binary_tagged where {unit_sql(SEED, 'track')} >= 0.7)"


@query(
    f"""select model, n_trees, {_N_TEST} as n_test, 0::bigint as n_different, true as scores_the_same, {_N_TRAIN} * n_trees as n_in_leaves,
               0::bigint as n_leaves_off, true as importances_the_same
        from (values ('boosted_trees', 20), ('random_forest', 3)) m(model, n_trees)"""
)
def trees_walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree models as tables of nodes: rows walk down them, and predictions, scores, the training rows in
    each leaf and the importances are those of the model."""
    train, test = _binary(spark, sf_dir)
    made = {"boosted_trees": (cl.boosted_trees(SEED), 5), "random_forest": (cl.random_forest(SEED), 4)}
    rows = None
    for name, (estimator, depth) in made.items():
        boosted = name == "boosted_trees"
        with held(train) as cached:
            model = estimator.fit(cached)
        nodes = checkpoint(ins.node_table(model), shared_path(spark, "nodes"))
        predict = ins.boosted_prediction if boosted else ins.forest_prediction
        ours = predict(ins.walked(test, nodes, depth, "track"), "track").withColumnRenamed("prediction", "walked")
        raw = vector_to_array("rawPrediction" if boosted else "probability")[1]
        both = cl.score(model, test).select("track", "prediction", raw.alias("raw")).join(ours, "track", "left")
        compared = both.agg(
            F.count(F.lit(1)).alias("n_test"),
            F.count_if(~F.col("prediction").eqNullSafe(F.col("walked"))).alias("n_different"),
            F.every(F.abs(F.col("raw") - F.col("score")) <= 1e-9).alias("scores_the_same"),
        )
        leaves = ins.walked(train, nodes, depth, "track").groupBy("tree", "node").agg(F.count(F.lit(1)).alias("reached"))
        # A forest's trees are grown on draws with replacement, so only boosted ones must have met these very rows.
        off = nodes.where("left < 0").join(leaves, ["tree", "node"], "left").agg(
            F.sum("reached").alias("n_in_leaves"),
            F.count_if((F.col("n") != F.coalesce("reached", F.lit(0))) & F.lit(boosted)).alias("n_leaves_off"),
        )
        said = [float(v) for v in model.featureImportances.toArray()]
        shares = {r["feature"]: r["importance"] for r in ins.importances(nodes, not boosted).collect()}  # a row per feature
        same = all(abs(v - shares.get(j, 0.0)) <= 1e-9 for j, v in enumerate(said))
        row = compared.join(off).select(
            F.lit(name).alias("model"), F.lit(len(model.trees)).alias("n_trees"), "n_test", "n_different", "scores_the_same",
            "n_in_leaves", "n_leaves_off", F.lit(same).alias("importances_the_same"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query(
    f"""select (select count(*) from binary_tagged where {unit_sql(SEED, 'track')} >= 0.7) as n_rows,
               0::bigint as n_different, true as lower_threshold_says_more"""
)
def reloaded_model_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model gives the same scores after saving and loading; a lower threshold only adds positives."""
    train, test = _binary(spark, sf_dir)
    model, path = cl.binary_logistic().fit(train), shared_path(spark, "logistic-model")
    save_model(model, path)
    before = cl.score(model, test).select("track", vector_to_array("probability")[1].alias("p"), "prediction")
    after = cl.score(load_model(LogisticRegressionModel, path), test).select(
        "track", vector_to_array("probability")[1].alias("q"), F.col("prediction").alias("said")
    )
    low = cl.score(model, test, 0.05).select("track", F.col("prediction").alias("low"))
    return before.join(after, "track").join(low, "track").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if((F.col("p") != F.col("q")) | (F.col("prediction") != F.col("said"))).alias("n_different"),
        F.every(F.col("low") >= F.col("prediction")).alias("lower_threshold_says_more"),
    )


@query(
    f"""select (select count(*) from tagged where {unit_sql(SEED, 'track')} >= 0.7) as n_rows, true as class_0_said_more,
               true as others_said_less"""
)
def multinomial_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One threshold per class: a low one for class 0 turns predictions to it, and from it none."""
    train, test = _multi(spark, sf_dir)
    model = cl.multinomial_logistic().fit(train)
    usual = cl.score(model, test).select("track", "prediction")
    turned = cl.score(model, test, thresholds=[0.1, *[1.0] * (model.numClasses - 1)]).select(
        "track", F.col("prediction").alias("turned")
    )
    return usual.join(turned, "track").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count_if(F.col("turned") == 0) > F.count_if(F.col("prediction") == 0)).alias("class_0_said_more"),
        F.every((F.col("turned") == 0) | (F.col("turned") == F.col("prediction"))).alias("others_said_less"),
    )


_PARTS = f"""
    parts as (select user_id, song_id, plays, {unit_sql(SEED, pair_sql())} < 0.21 as in_test from triplets),
    train as (select * from parts where not in_test),
    test as (select * from parts where in_test)"""


@query(
    f"""with {_PARTS}
        select user_id, song_id, plays, user_id in (select user_id from train) and song_id in (select song_id from train)
               as has_score from test"""
)
def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out pairs get a score exactly if training knew both the user and the song."""
    study = _Study(spark, sf_dir)
    scored = rc.predict_pairs(study.model, study.test)
    return scored.select("user_id", "song_id", "plays", (~F.isnan("prediction")).alias("has_score"))


@query(
    f"""with {_PARTS}, n as (select least(10, count(distinct song_id)) as k from train),
             chosen as (select user_id from (select user_id, count(*) as c from test group by user_id having count(*) > 5) h
                        order by {hash_sql(SEED, 'user_id')}, user_id limit 10)
        select user_id, k as n_songs, k as n_distinct, true as as_scored
        from chosen, n where user_id in (select user_id from train)"""
)
def recommended_songs_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled users get ten different songs each, rated as the model scores those pairs."""
    study = _Study(spark, sf_dir)
    chosen = sm.sample_heavy_users(study.test, 5, 10, SEED)
    users = study.users.join(chosen.select("user_id"), "user_id")
    recs = rc.decode_recommendations(rc.recommend_for_users(study.model, users, 10), study.users, study.songs)
    scored = rc.predict_pairs(study.model, recs)
    return scored.groupBy("user_id").agg(
        F.count("song_id").alias("n_songs"),
        F.countDistinct("song_id").alias("n_distinct"),
        F.every(F.abs(F.col("rating") - F.col("prediction")) < 1e-4).alias("as_scored"),
    )


@query(
    f"""with {_PARTS},
             chosen as (select user_id from (select user_id, count(*) as c from test group by user_id having count(*) > 5) h
                        order by {hash_sql(SEED, 'user_id')}, user_id limit 10)
        select t.user_id, t.song_id, plays, t.user_id in (select user_id from train) and song_id in (select song_id from train) as has_score,
               true as as_from_factors
        from test t join chosen c on t.user_id = c.user_id"""
)
def held_out_songs_of_sampled_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled users' own held-out songs with the model's score, which is the product of their factors."""
    study = _Study(spark, sf_dir)
    chosen = sm.sample_heavy_users(study.test, 5, 10, SEED)
    own = study.test.join(chosen.select("user_id"), "user_id")
    users = study.model.userFactors.select(F.col("id").cast("double").alias("user_index"), F.col("features").alias("_u"))
    songs = study.model.itemFactors.select(F.col("id").cast("double").alias("song_index"), F.col("features").alias("_s"))
    product = F.aggregate(F.zip_with("_u", "_s", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    scored = rc.predict_pairs(study.model, own).join(users, "user_index", "left").join(songs, "song_index", "left")
    missing = product.isNull()
    return scored.select(
        "user_id", "song_id", "plays", (~F.isnan("prediction")).alias("has_score"),
        F.when(missing, F.isnan("prediction")).otherwise(F.abs(product - F.col("prediction")) < 1e-4).alias("as_from_factors"),
    )


@query(
    f"""with {_PARTS}, n as (select least(10, count(distinct user_id)) as k from train)
        select song_id, k as n_listeners from (select distinct song_id from train) s, n"""
)
def listeners_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every song of the training part gets ten listeners."""
    study = _Study(spark, sf_dir)
    rows = rc.explode_recommendations(rc.recommend_for_all_items(study.model, 10), "song_index", "user_index")
    rows = rows.withColumn("song_index", F.col("song_index").cast("double"))
    counts = rows.groupBy("song_index").agg(F.countDistinct("user_index").alias("n_listeners"))
    return counts.join(study.songs, "song_index").select("song_id", "n_listeners")


@query(
    f"""with {_PARTS}, n as (select least(10, count(distinct user_id)) as k, count(distinct user_id) as u from train)
        select song_id, k as n_listeners, true as rated_as_full_product, true as blocks_in_range
        from (select distinct song_id from train) s, n"""
)
def listeners_by_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten listeners for every song by a search that stops at a bound; rated as the full product rates them."""
    study, block = _Study(spark, sf_dir), 128
    ours = rc.best_users_for_items(study.model, 10, block)
    ratings = F.sort_array(F.collect_list(F.col("rating").cast("double")), asc=False)
    said = rc.explode_recommendations(rc.recommend_for_all_items(study.model, 10, bounded=False), "song_index", "user_index")
    both = (
        ours.groupBy("song_index").agg(F.countDistinct("user_index").alias("n_listeners"), ratings.alias("r"), F.max("n_blocks").alias("seen"))
        .join(said.groupBy("song_index").agg(ratings.alias("q")), "song_index")
        .withColumn("song_index", F.col("song_index").cast("double"))
    )
    close = F.forall(F.zip_with("r", "q", lambda a, b: F.abs(a - b) < 1e-5), lambda fits: F.coalesce(fits, F.lit(False)))
    n_users = study.train.agg(F.countDistinct("user_index")).scalar()
    return both.join(study.songs, "song_index").select(
        "song_id", "n_listeners", close.alias("rated_as_full_product"),
        ((F.col("seen") >= 1) & (F.col("seen") <= F.ceil(n_users / block))).alias("blocks_in_range"),
    )


# ---- recommendation ---------------------------------------------------------


class _Study:
    """Indexed interactions split in two, written once, with a model fitted on the larger part.

    A fit reads numbers only, so rows of the larger part go on without their ids.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        plays = fx.triplets(spark, sf_dir, by_user=True).sortWithinPartitions("user_id")
        plays = checkpoint(plays, shared_path(spark, "triplets"), "zstd")
        taken = sm.in_sample(sm.key_of("user_id", "song_id"), SEED, 0.21)
        indexed, tables = rc.index_interactions(plays, taken, "taken")
        indexed = checkpoint(indexed, shared_path(spark, "indexed-triplets"), "zstd")
        self.users = checkpoint(tables["user_id"], shared_path(spark, "users"), "zstd")
        self.songs = checkpoint(tables["song_id"], shared_path(spark, "songs"), "zstd")
        self.test = indexed.where("taken").drop("taken")
        self.train = indexed.where("not taken").select("user_index", "song_index", "plays")
        self.model = rc.fit_als(self.train, SEED)

    def named_train(self) -> DataFrame:
        """The larger part with its ids."""
        rows = self.train.join(self.users, "user_index").join(self.songs, "song_index")
        return rows.select(*self.test.columns)


@query()
def predict_held_out_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = _Study(spark, sf_dir)
    return rc.predict_pairs(study.model, study.test).select("user_id", "song_id", "plays", "prediction")


@query()
def rmse_of_both_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = _Study(spark, sf_dir)
    models = {"implicit": study.model, "explicit": rc.fit_als(study.train, SEED, implicit=False)}
    rows = [
        mt.rmse(rc.predict_pairs(model, study.test), "plays").select(F.lit(kind).alias("kind"), "rmse", "n_rows")
        for kind, model in models.items()
    ]
    return rows[0].unionByName(rows[1])


@query()
def listeners_for_every_song(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = _Study(spark, sf_dir)
    recs = rc.recommend_for_all_items(study.model, 10)
    return rc.explode_recommendations(recs, "song_index", "user_index")


@query()
def songs_for_sampled_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = _Study(spark, sf_dir)
    chosen = sm.sample_heavy_users(study.test, 5, 10, SEED)
    users = study.users.join(chosen.select("user_id"), "user_id")
    recs = rc.recommend_for_users(study.model, users, 10)
    return rc.decode_recommendations(recs, study.users, study.songs)


@query()
def card_of_one_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = _Study(spark, sf_dir)
    user = study.users.where(F.col("user_id") == "U00000007")
    recs = rc.decode_recommendations(
        rc.recommend_for_users(study.model, user, 10), study.users, study.songs
    )
    return rc.recommendation_card(
        "U00000007", study.named_train(), study.test, fx.metadata(spark, sf_dir), recs
    )


@query(
    f"""select case when {unit_sql(SEED, pair_sql("t.user_id", "t.song_id"))} < 0.21 then 'test' else 'train' end as side,
               t.song_id, cast(plays as bigint) as plays, null::double as rating,
               artist_name, song_hotttnesss, title, release
        from triplets t join metadata m on t.song_id = m.song_id where t.user_id = 'U00000007'"""
)
def card_of_heard_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = sm.stratified_split(
        fx.triplets(spark, sf_dir), sm.key_of("user_id", "song_id"), SEED, 0.21
    )
    return rc.recommendation_card("U00000007", train, test, fx.metadata(spark, sf_dir))


_RECS = """recs as (select user_id, song_id, rank() over (partition by user_id order by plays desc, song_id) as place,
                           plays from triplets)"""
_INDEX = """select {c}, cast(row_number() over (order by n desc, {c}) - 1 as double) as {i}
            from (select {c}, count(*) as n from triplets group by {c}) x"""


@query(
    f"""with {_RECS}, u as ({_INDEX.format(c='user_id', i='user_index')}),
             s as ({_INDEX.format(c='song_id', i='song_index')})
        select song_index, user_index, cast(plays as double) as rating, r.user_id, r.song_id
        from recs r join u on r.user_id = u.user_id join s on r.song_id = s.song_id where place <= 10"""
)
def decode_given_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's most played songs in the form a model returns, then flattened and decoded."""
    plays = checkpoint(fx.triplets(spark, sf_dir), shared_path(spark, "triplets"))
    indexed, tables = rc.index_interactions(plays)
    order = [F.col("plays").desc(), F.col("song_id").asc()]
    best = position_within(indexed, "user_id", order, "place").where(F.col("place") <= 10)
    entry = F.struct("place", "song_index", F.col("plays").cast("float").alias("rating"))
    recs = best.groupBy("user_index").agg(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda e: F.struct(e["song_index"].alias("song_index"), e["rating"].alias("rating")),
        ).alias("recommendations")
    )
    decoded = rc.decode_recommendations(recs, tables["user_id"], tables["song_id"])
    return decoded.withColumn("rating", F.col("rating").cast("double"))


@query()
def ranking_of_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = _Study(spark, sf_dir)
    scored = rc.predict_pairs(study.model, study.test).select("user_index", "song_id", "plays", "prediction")
    scored = checkpoint(scored, shared_path(spark, "scored"), "zstd")
    return mt.ranking_metrics(mt.ranking_rows(scored, "prediction", "plays", 10, "user_index"), user="user_index")
