"""Feature preparation: string indexes, vectors, scaling, pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.base import Estimator
from pyspark.ml.feature import (
    MinMaxScaler,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunestrata.operators.ordering import global_positions


def index_table(df: DataFrame, column: str, index: str) -> DataFrame:
    """``column, index``: 0 for the most frequent value, ties in alphabetical order.

    The numbering is that of ``StringIndexer``, but the table stays on the executors, so
    it works for any number of users or songs.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    placed = global_positions(counts, [F.col("_n").desc(), F.col(column).asc()], index)
    return placed.select(column, F.col(index).cast("double").alias(index))


def apply_index(
    df: DataFrame, table: DataFrame, column: str, index: str, unseen: str = "error"
) -> DataFrame:
    """Attach the index by a join. Unseen values raise, are skipped, or get null (``keep``)."""
    if unseen == "skip":
        return df.join(table, column, "inner")
    joined = df.join(table, column, "left")
    if unseen == "keep":
        return joined
    if unseen != "error":
        raise ValueError(f"unknown choice {unseen!r}")
    message = F.concat(F.lit(f"no index for {column} "), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return joined.withColumn(index, F.coalesce(index, F.raise_error(message).cast("double")))


def index_strings(
    df: DataFrame, columns: dict[str, str], named: Column | None = None, mark: str = "named"
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Index several columns; returns the indexed frame and the tables to decode with.

    Each index is a join that shuffles the rows. With ``named``, a condition on the row that goes on as
    the column ``mark``, only rows it holds for keep their strings; the others have null in their place
    once they have the index, and the next join does not carry them.
    """
    tables = {c: index_table(df, c, i) for c, i in columns.items()}
    for place, (column, index) in enumerate(columns.items()):
        df = apply_index(df, tables[column], column, index)
        if named is not None:
            df = df if place else df.withColumn(mark, F.coalesce(named, F.lit(False)))
            df = df.withColumn(column, F.when(F.col(mark), F.col(column)))
    return df, tables


def assemble(columns: Sequence[str], output: str = "features", invalid: str = "error") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid=invalid)


def standardize(column: str = "features_original", output: str = "features") -> StandardScaler:
    """Divide by the sample deviation, without centring; a constant column becomes 0."""
    return StandardScaler(inputCol=column, outputCol=output, withStd=True, withMean=False)


def minmax(column: str = "features_original", output: str = "features") -> MinMaxScaler:
    """Scale to [0, 1]; a constant column becomes 0.5."""
    return MinMaxScaler(inputCol=column, outputCol=output)


def clip_to_unit(df: DataFrame, column: str = "features") -> DataFrame:
    """Bring scaled values back into [0, 1].

    Held-out rows may lie outside the range the scaler saw in training, and naive Bayes
    rejects negative values.
    """
    inside = F.transform(
        vector_to_array(column), lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    )
    return df.withColumn(column, array_to_vector(inside))


def one_hot(column: str, output: str) -> OneHotEncoder:
    return OneHotEncoder(inputCols=[column], outputCols=[output])


def label_indexer(column: str, output: str = "label") -> StringIndexer:
    """For class labels: few values, so Spark's own indexer is right."""
    return StringIndexer(inputCol=column, outputCol=output)


def build_pipeline(stages: Sequence[Estimator | Transformer]) -> Pipeline:
    return Pipeline(stages=list(stages))


def prepare(
    train: DataFrame,
    test: DataFrame,
    columns: Sequence[str],
    label: str,
    scaler: StandardScaler | MinMaxScaler | None = None,
) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """Label, vector and scaled vector for both parts, everything fitted on ``train``."""
    model = build_pipeline(
        [label_indexer(label), assemble(columns, "features_original"), scaler or standardize()]
    ).fit(train)
    return model.transform(train), model.transform(test), model
