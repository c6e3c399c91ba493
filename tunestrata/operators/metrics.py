"""Evaluation metrics as plain aggregations: frames in, small frames out."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunestrata.functions import drop_nan
from tunestrata.operators.ordering import number_digits, position_within, running_totals, top_places, totals_before

# ---- binary scores ----------------------------------------------------------


def score_column(df: DataFrame, score: str) -> Column:
    """A numeric score; of a raw prediction vector, the entry for class 1."""
    if isinstance(df.schema[score].dataType, VectorUDT):
        return vector_to_array(score)[1]
    return F.col(score).cast("double")


def score_curve(df: DataFrame, label: str = "label", score: str = "rawPrediction") -> DataFrame:
    """One row per distinct score, highest first: positives and negatives at it and before it."""
    by_score = (
        df.select(score_column(df, score).alias("score"), F.col(label).cast("double").alias("y"))
        .groupBy("score")
        .agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    )
    return running_totals(by_score, [F.col("score").desc()], ["pos", "neg"])


def _areas(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid sums over a curve's steps, one row or one a group."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp0, fp0 = F.col("pos_before").cast("double"), F.col("neg_before").cast("double")
    here = (tp0 + pos) / (tp0 + pos + fp0 + neg)
    before = F.when(tp0 + fp0 == 0, here).otherwise(tp0 / F.nullif(tp0 + fp0, F.lit(0.0)))
    return (
        curve.groupBy(*by)
        .agg(
            F.sum(neg * (tp0 + pos / 2)).alias("roc"),
            F.sum(pos * (here + before) / 2).alias("pr"),
            F.sum(pos).alias("p"),
            F.sum(neg).alias("n"),
        )
        .select(
            *by,
            F.try_divide("roc", F.col("p") * F.col("n")).alias("auroc"),
            F.try_divide("pr", "p").alias("aupr"),
        )
    )


def binary_areas(df: DataFrame, label: str = "label", score: str = "rawPrediction") -> DataFrame:
    """One row: area under the ROC curve and area under the precision-recall curve.

    Both are trapezoid sums over the distinct scores, so ties count half and nothing is
    down-sampled. The precision-recall curve starts at the precision of the first score.
    """
    return _areas(score_curve(df, label, score))


def grouped_areas(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """``binary_areas`` of every group at once: ``by, auroc, aupr``.

    One pass whatever the number of groups: running totals go digit by digit of the score inside
    each, so neither thousands of small groups nor a few very large ones meet in one task.
    """
    counts = (
        df.select(*by, score_column(df, score).alias("score"), F.col(label).cast("double").alias("y"))
        .groupBy(*by, "score")
        .agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    )
    digits = number_digits(counts, "score")
    return _areas(totals_before(counts.withColumns(digits), by, list(digits), ["pos", "neg"]), by)


def area_under_roc(df: DataFrame, label: str = "label", score: str = "rawPrediction") -> DataFrame:
    return binary_areas(df, label, score).select("auroc")


def area_under_pr(df: DataFrame, label: str = "label", score: str = "rawPrediction") -> DataFrame:
    return binary_areas(df, label, score).select("aupr")


# ---- classes ----------------------------------------------------------------


def confusion_cells(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """``label, prediction, n`` for every pair that occurs (in each group of ``by``)."""
    return df.groupBy(
        *by,
        F.col(label).cast("double").alias("label"),
        F.col(prediction).cast("double").alias("prediction"),
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(cells: DataFrame, classes: Sequence[float]) -> DataFrame:
    """A row per actual class and a column ``p<class>`` per predicted one, zeros filled in.

    ``other`` counts predictions outside ``classes``. Labels outside them get a row of their own.
    """
    said = F.col("prediction")
    lines = cells.sparkSession.createDataFrame([(float(c),) for c in classes], "label double")
    wide = cells.groupBy("label").agg(
        *(
            F.coalesce(F.sum(F.when(F.col("prediction") == float(c), F.col("n"))), F.lit(0))
            .cast("bigint")
            .alias(f"p{int(c)}")
            for c in classes
        ),
        F.coalesce(F.sum(F.when(~F.coalesce(said.isin([float(c) for c in classes]), F.lit(False)), F.col("n"))), F.lit(0))
        .cast("bigint")
        .alias("other"),
    )
    return lines.join(wide, "label", "full").na.fill(0)


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The four binary counts in one row and one pass."""
    actual, said = F.col(label) == 1, F.col(prediction) == 1
    return df.agg(
        F.count_if(actual & said).alias("tp"),
        F.count_if(~actual & ~said).alias("tn"),
        F.count_if(actual & ~said).alias("fn"),
        F.count_if(~actual & said).alias("fp"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / F.nullif(bottom, F.lit(0)))


def per_class_metrics(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of each class; 0 where nothing was predicted or present."""
    n = F.col("n")
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(F.lit(0))
    views = F.array(
        F.struct(F.col("label").alias("class"), hit.alias("tp"), n.alias("actual"), F.lit(0).cast("bigint").alias("said")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("actual"), n.alias("said")),
    )
    sums = (
        cells.select(*by, F.inline(views))
        .groupBy(*by, "class")
        .agg(*(F.sum(c).alias(c) for c in ("tp", "actual", "said")))
    )
    precision, recall = _ratio(F.col("tp"), F.col("said")), _ratio(F.col("tp"), F.col("actual"))
    return sums.select(
        *by,
        "class",
        "actual",
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2.0 * F.col("tp"), F.col("actual") + F.col("said")).alias("f1"),
    )


def overall_metrics(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, and precision, recall and F1 weighted by class size. One row, or one a group.

    Accuracy is what precision, recall and F1 all come to when counted over all classes.
    """
    weight = F.col("actual")
    total = F.sum(weight)
    return per_class_metrics(cells, by).groupBy(*by).agg(
        (F.sum(F.col("recall") * weight) / total).alias("accuracy"),
        (F.sum(F.col("precision") * weight) / total).alias("weighted_precision"),
        (F.sum(F.col("recall") * weight) / total).alias("weighted_recall"),
        (F.sum(F.col("f1") * weight) / total).alias("weighted_f1"),
    )


def _long(df: DataFrame, names: Sequence[str], cls: Column) -> DataFrame:
    rows = F.array(
        *(
            F.struct(F.lit(m).alias("metric"), cls.alias("class"), F.col(m).cast("double").alias("value"))
            for m in names
        )
    )
    return df.select(F.inline(rows))


def classification_report(
    df: DataFrame,
    label: str = "label",
    score: str | None = "rawPrediction",
    prediction: str = "prediction",
) -> DataFrame:
    """Everything above as ``metric, class, value``; without a score, no areas."""
    cells = confusion_cells(df, label, prediction)
    none = F.lit(None).cast("double")
    report = _long(
        overall_metrics(cells), ["accuracy", "weighted_precision", "weighted_recall", "weighted_f1"], none
    ).unionByName(_long(per_class_metrics(cells), ["precision", "recall", "f1"], F.col("class")))
    report = report.unionByName(
        cells.select(
            F.format_string("confusion_as_%d", F.col("prediction").cast("int")).alias("metric"),
            F.col("label").alias("class"),
            F.col("n").cast("double").alias("value"),
        )
    )
    if score is None:
        return report
    return report.unionByName(_long(binary_areas(df, label, score), ["auroc", "aupr"], none))


# ---- regression -------------------------------------------------------------


def rmse(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Root of the mean squared error over rows that have a prediction."""
    kept = drop_nan(df, prediction)
    error = F.col(label).cast("double") - F.col(prediction).cast("double")
    return kept.agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("n_rows"))


# ---- ranking ----------------------------------------------------------------


def ranked_lists(
    scored: DataFrame, predicted: str, actual: str, n: int, user: str = "user_id", item: str = "song_id"
) -> DataFrame:
    """``user, item, said, place``: the top of each user by the prediction (``said``) and by the actual
    number, as one table. Every row is read once, as an entry for either list, and each task cuts both.

    Items without a score (null or NaN) are in neither list: a model that knows nothing of them ranks
    nothing. ``user`` and ``item`` name a row.
    """
    base = drop_nan(scored.select(user, item, predicted, actual), predicted)
    entries = F.array(
        F.struct(F.lit(True).alias("said"), F.col(predicted).cast("double").alias("_value")),
        F.struct(F.lit(False).alias("said"), F.col(actual).cast("double").alias("_value")),
    )
    both = base.select(user, item, F.inline(entries))
    return top_places(both, [user, "said"], "_value", item, n).drop("_value")


def ranking_rows(
    scored: DataFrame,
    predicted: str,
    actual: str,
    n: int,
    user: str = "user_id",
    item: str = "song_id",
) -> DataFrame:
    """Predicted and actual top lists of each user, side by side as rows.

    ``position`` is the place in the predicted list (null outside it), ``relevant`` tells whether the
    item is in the actual list. Both lists hold items of ``scored`` only: with a user's own held-out
    songs scored, this judges the order of those songs, not picks from the whole catalogue.
    """
    lists = ranked_lists(scored, predicted, actual, n, user, item)
    said = F.col("said")
    return lists.groupBy(user, item).agg(
        F.min(F.when(said, F.col("place"))).alias("position"), F.some(~said).alias("relevant")
    )


def ranking_rows_from_lists(
    predicted: DataFrame, relevant: DataFrame, user: str = "user_id", item: str = "song_id"
) -> DataFrame:
    """The same rows from two separate lists: ``predicted`` has user, item, position.

    Users missing from either list are left out later, as in an inner join of the lists.
    """
    said = predicted.select(user, item, F.col("position"), F.lit(False).alias("relevant"))
    good = relevant.select(user, item, F.lit(None).cast("bigint").alias("position"), F.lit(True).alias("relevant"))
    return (
        said.unionByName(good)
        .groupBy(user, item)
        .agg(F.min("position").alias("position"), F.max("relevant").alias("relevant"))
    )


def ranking_by_user(
    rows: DataFrame,
    at_precision: int = 5,
    at_ndcg: int = 10,
    user: str = "user_id",
) -> DataFrame:
    """Precision at k, NDCG at k and average precision of each user with both lists."""
    found = F.col("relevant") & F.col("position").isNotNull()
    # The place of a hit among the hits: non-hits are numbered after all hits.
    counted = position_within(
        rows.withColumn("_found", found),
        user,
        [F.col("_found").desc(), F.col("position").asc_nulls_last(), F.col(_item_of(rows, user)).asc()],
        "_hits",
    )
    hit = F.col("_found")
    gain = 1.0 / F.log(F.col("position") + 1.0)
    sums = counted.groupBy(user).agg(
        F.count_if("relevant").alias("n_relevant"),
        F.count("position").alias("n_predicted"),
        F.count_if(hit & (F.col("position") <= at_precision)).alias("_near"),
        F.sum(F.when(hit & (F.col("position") <= at_ndcg), gain)).alias("_dcg"),
        F.sum(F.when(hit, F.col("_hits") / F.col("position"))).alias("_ap"),
    )
    # Best possible gain for 1, 2, ... relevant items.
    best, total = [], 0.0
    for i in range(1, at_ndcg + 1):
        total += 1.0 / math.log(i + 1)
        best.append(F.lit(total))
    ideal = F.element_at(F.array(*best), F.least(F.col("n_relevant"), F.lit(at_ndcg)).cast("int"))
    zero = F.lit(0.0)
    return sums.where((F.col("n_relevant") > 0) & (F.col("n_predicted") > 0)).select(
        user,
        (F.col("_near") / at_precision).alias("precision_at_k"),
        (F.coalesce("_dcg", zero) / ideal).alias("ndcg_at_k"),
        (F.coalesce("_ap", zero) / F.col("n_relevant")).alias("average_precision"),
    )


def _item_of(rows: DataFrame, user: str) -> str:
    return next(c for c in rows.columns if c not in (user, "position", "relevant"))


def ranking_metrics(
    rows: DataFrame,
    at_precision: int = 5,
    at_ndcg: int = 10,
    user: str = "user_id",
) -> DataFrame:
    """Means over users: ``precision_at_k, ndcg_at_k, mean_average_precision, n_users``."""
    per_user = ranking_by_user(rows, at_precision, at_ndcg, user)
    return per_user.agg(
        F.avg("precision_at_k").alias("precision_at_k"),
        F.avg("ndcg_at_k").alias("ndcg_at_k"),
        F.avg("average_precision").alias("mean_average_precision"),
        F.count(F.lit(1)).alias("n_users"),
    )
