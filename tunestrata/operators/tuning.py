"""Cross-validation over parameter grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.base import Estimator
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunestrata.functions import hash_bucket
from tunestrata.operators.metrics import confusion_cells, grouped_areas, overall_metrics

# The parameter grids, one per model.
GRIDS: dict[str, dict[str, list]] = {
    "binary_logistic": {"regParam": [0.01, 0.1, 0.3, 0.5], "maxIter": [20]},
    "boosted_trees": {"stepSize": [0.01, 0.1, 0.2], "maxDepth": [3, 4, 5]},
    "linear_svm": {"regParam": [0.001, 0.01, 0.1, 1.0], "maxIter": [5, 10, 20]},
    "random_forest": {"numTrees": [2, 3, 4], "maxDepth": [4, 5]},
    "multinomial_logistic": {
        "regParam": [0.01, 0.1, 0.3, 0.5],
        "elasticNetParam": [0.01, 0.1, 0.2],
        "maxIter": [10, 20],
    },
}


def param_grid(estimator: Estimator, values: Mapping[str, Sequence]) -> list[dict]:
    builder = ParamGridBuilder()
    for name, options in values.items():
        builder = builder.addGrid(estimator.getParam(name), list(options))
    return builder.build()


_FOLD = "_fold"


def with_folds(df: DataFrame, key: Column | str, seed: int, folds: int = 5) -> DataFrame:
    """Add the fold of each row. It follows from the row's key, so folds stay disjoint when a lost
    partition is computed again."""
    return df.withColumn(_FOLD, (hash_bucket(key, seed) % folds).cast("int"))


def cross_validate(
    estimator: Estimator,
    grid: Mapping[str, Sequence],
    evaluator: Evaluator,
    df: DataFrame,
    key: Column | str,
    seed: int,
    folds: int = 5,
    parallelism: int = 2,
    keep_models: bool = False,
) -> CrossValidatorModel:
    """Pick the best setting by k-fold cross-validation and refit it on all rows.

    ``keep_models`` keeps the model of every fold and setting, for ``fold_scores``.
    """
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=param_grid(estimator, grid),
        evaluator=evaluator,
        numFolds=folds,
        foldCol=_FOLD,
        parallelism=parallelism,
        collectSubModels=keep_models,
        seed=seed,
    ).fit(with_folds(df, key, seed, folds))


def _setting(params: Mapping) -> str:
    return ", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda kv: kv[0].name))


def fold_scores(model: CrossValidatorModel, df: DataFrame, key: Column | str, seed: int, folds: int = 5) -> DataFrame:
    """``fold, setting, label, score, prediction``: each row of the training set as the models that did
    not see its fold score it, one row a setting.

    A fold's rows pass through the models of all settings one after the other, in one scan; what
    comes out is only as long as rows times settings. ``score`` is the raw score of class 1.
    """
    rows, names = None, [_setting(m) for m in model.getEstimatorParamMaps()]
    folded = with_folds(df, key, seed, folds)
    for fold, models in enumerate(model.subModels):
        part, entries = folded.where(F.col(_FOLD) == fold), []
        for i, (name, sub) in enumerate(zip(names, models, strict=True)):
            outputs = {sub.rawPredictionCol: f"_raw_{i}", sub.predictionCol: f"_said_{i}"}
            if sub.hasParam("probabilityCol"):
                outputs[sub.probabilityCol] = ""
            part = sub.transform(part, outputs)
            score = vector_to_array(f"_raw_{i}")[1]
            entries.append(F.struct(F.lit(name).alias("setting"), score.alias("score"), F.col(f"_said_{i}").alias("prediction")))
        part = part.select(F.col(_FOLD).alias("fold"), "label", F.inline(F.array(*entries)))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def fold_metrics(scores: DataFrame, metric: str) -> DataFrame:
    """``fold, setting, metric`` from scores of all folds and settings at once; ``auroc``, ``aupr``,
    or one of ``metrics.overall_metrics``."""
    by = ["fold", "setting"]
    if metric in ("auroc", "aupr"):
        return grouped_areas(scores, by).select(*by, F.col(metric).alias("metric"))
    return overall_metrics(confusion_cells(scores, by=by), by).select(*by, F.col(metric).alias("metric"))


def tuning_report(model: CrossValidatorModel) -> DataFrame:
    """``setting, metric, is_best``: one row per setting of the grid."""
    from pyspark.sql import SparkSession

    maps, scores = model.getEstimatorParamMaps(), list(model.avgMetrics)
    larger = model.getEvaluator().isLargerBetter()
    best = max(scores) if larger else min(scores)
    chosen = scores.index(best)
    rows = [
        (
            _setting(m),
            float(s),
            i == chosen,
        )
        for i, (m, s) in enumerate(zip(maps, scores, strict=True))
    ]
    return SparkSession.active().createDataFrame(rows, "setting string, metric double, is_best boolean")


def best_parameters(model: CrossValidatorModel) -> dict[str, object]:
    """Every parameter of the refitted best model."""
    return {p.name: v for p, v in model.bestModel.extractParamMap().items()}
