"""Genre classifiers: Spark ML estimators with fixed default settings, and their use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model
from pyspark.ml.base import Estimator
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunestrata.operators.metrics import (
    binary_areas,
    confusion_cells,
    grouped_areas,
    overall_metrics,
    per_class_metrics,
)
from tunestrata.operators.sampling import oversample, undersample
from tunestrata.session import held


# The default settings of the classifiers.


def binary_logistic(**settings) -> LogisticRegression:
    defaults = {"maxIter": 20, "regParam": 0.3, "elasticNetParam": 0.0}
    return LogisticRegression(**{**defaults, **settings})


def multinomial_logistic(**settings) -> LogisticRegression:
    defaults = {"maxIter": 20, "regParam": 0.1, "elasticNetParam": 1.0, "family": "multinomial"}
    return LogisticRegression(**{**defaults, **settings})


def boosted_trees(seed: int, **settings) -> GBTClassifier:
    defaults = {"maxIter": 20, "stepSize": 0.1, "maxDepth": 5, "maxBins": 32}
    return GBTClassifier(seed=seed, **{**defaults, **settings})


def linear_svm(**settings) -> LinearSVC:
    defaults = {"maxIter": 5, "regParam": 0.01, "standardization": False}
    return LinearSVC(**{**defaults, **settings})


def random_forest(seed: int, **settings) -> RandomForestClassifier:
    defaults = {"numTrees": 3, "maxDepth": 4, "maxBins": 32}
    return RandomForestClassifier(seed=seed, **{**defaults, **settings})


def naive_bayes(**settings) -> NaiveBayes:
    """Needs features that are not negative: scale with ``features.minmax`` first."""
    defaults = {"smoothing": 1.0, "modelType": "multinomial"}
    return NaiveBayes(**{**defaults, **settings})


def score(
    model: Model,
    df: DataFrame,
    threshold: float | None = None,
    thresholds: Sequence[float] | None = None,
) -> DataFrame:
    """Apply a model, if wanted with other decision thresholds than it was fitted with.

    Two classes take one ``threshold``, more of them one for each class.
    """
    if thresholds is not None:
        return model.transform(df, {model.thresholds: list(thresholds)})
    if threshold is None:
        return model.transform(df)
    if getattr(model, "numClasses", 2) > 2:
        raise ValueError("a model of several classes takes thresholds, one per class")
    return model.transform(df, {model.threshold: threshold})


def feature_importances(model: Model, columns: list[str]) -> DataFrame:
    """``feature, importance`` of a fitted tree model; one row per column."""
    from pyspark.sql import SparkSession

    values = [float(v) for v in model.featureImportances.toArray()]
    return SparkSession.active().createDataFrame(
        list(zip(columns, values, strict=True)), "feature string, importance double"
    )


def bayes_parameters(model, columns: list[str]) -> DataFrame:
    """``class, feature, theta, pi`` of a naive Bayes model: classes x features rows."""
    from pyspark.sql import SparkSession

    theta, pi = model.theta.toArray(), model.pi.toArray()
    rows = [
        (float(c), f, float(theta[c, j]), float(pi[c]))
        for c in range(len(pi))
        for j, f in enumerate(columns)
    ]
    return SparkSession.active().createDataFrame(
        rows, "class double, feature string, theta double, pi double"
    )


def most_confident(predictions: DataFrame, k: int, key: str, cls: int = 0) -> DataFrame:
    """The ``k`` rows with the highest probability of a class, ties by key."""
    p = vector_to_array("probability")[cls]
    return predictions.withColumn("p_class", p).orderBy(F.col("p_class").desc(), key).limit(k)


def training_variants(
    train: DataFrame, label: str, minority: object, key: Column | str, seed: int
) -> dict[str, DataFrame]:
    """The training set as it is, with fewer majority rows, and with more minority rows."""
    return {
        "plain": train,
        "under": undersample(train, label, minority, key, seed),
        "over": oversample(train, label, minority, key, seed),
    }


def summary_row(predictions: DataFrame, label: str = "label", raw: str = "rawPrediction") -> DataFrame:
    """One row: both areas, accuracy, and the figures of class 1."""
    cells = confusion_cells(predictions, label)
    positive = per_class_metrics(cells).agg(
        *(
            F.coalesce(F.max(F.when(F.col("class") == 1, F.col(m))), F.lit(0.0)).alias(m)
            for m in ("precision", "recall", "f1")
        )
    )
    accuracy = overall_metrics(cells).select("accuracy").scalar()
    figures = positive.select(F.struct("precision", "recall", "f1").alias("s")).scalar()
    return (
        binary_areas(predictions, label, raw)
        .withColumn("accuracy", accuracy)
        .withColumn("_figures", figures)
        .select("auroc", "aupr", "accuracy", "_figures.*")
    )


def stacked_scores(models: Sequence[tuple[Model, float | None]], df: DataFrame, label: str = "label") -> DataFrame:
    """``model, label, score, prediction``: every row as each of several binary models scores it, in one
    scan. ``model`` is the place in the list; beside a model stands its threshold, or None for its own."""
    entries, rows = [], df
    for i, (model, threshold) in enumerate(models):
        settings = {model.rawPredictionCol: f"_raw_{i}", model.predictionCol: f"_said_{i}"}
        if model.hasParam("probabilityCol"):
            settings[model.probabilityCol] = f"_p_{i}"  # thresholds apply to it
        if threshold is not None:
            settings[model.threshold] = threshold
        rows = model.transform(rows, settings)
        score = vector_to_array(f"_raw_{i}")[1]
        entries.append(F.struct(F.lit(i).alias("model"), score.alias("score"), F.col(f"_said_{i}").alias("prediction")))
    return rows.select(F.col(label).alias("label"), F.inline(F.array(*entries))).select("model", "label", "score", "prediction")


def summary_rows(scores: DataFrame) -> DataFrame:
    """``summary_row`` of every model of ``stacked_scores``, the areas of all from one grouped curve."""
    cells = confusion_cells(scores, by=["model"])
    figures = ("precision", "recall", "f1")
    positive = per_class_metrics(cells, ["model"]).where("class = 1").select("model", *figures)
    rows = grouped_areas(scores, ["model"]).join(overall_metrics(cells, ["model"]).select("model", "accuracy"), "model")
    return rows.join(positive, "model", "left").na.fill(0.0, list(figures)).select("model", "auroc", "aupr", "accuracy", *figures)


def compare_resampling(
    estimator: Estimator,
    variants: Mapping[str, DataFrame],
    test: DataFrame,
    label: str = "label",
    thresholds: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """Fit the same estimator on each training variant; one report row per variant and threshold.

    Variants without a list of thresholds keep the model's own, and have a null there. The test rows
    are read once, by all models one after the other.
    """
    made, names = [], []
    for name, train in variants.items():
        with held(train) as cached:
            model = estimator.fit(cached)
        for threshold in (thresholds or {}).get(name, (None,)):
            made.append((model, threshold))
            names.append((name, threshold))
    place = F.col("model")
    variant = F.array(*(F.lit(name) for name, _ in names))[place]
    threshold = F.array(*(F.lit(t).cast("double") for _, t in names))[place]
    rows = summary_rows(stacked_scores(made, test, label))
    return rows.select(variant.alias("variant"), threshold.alias("threshold"), "*").drop("model")
