"""Fitted models taken apart: objectives and gradients of linear models, trees as tables.

Everything is worked out a second time from the rows and the model's own numbers, as aggregates.
What comes to the driver or is broadcast has a row per column and class, or per node of a tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.classification import LinearSVCModel, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- linear models ----------------------------------------------------------


def _weights(model: Model) -> tuple[list[list[float]], list[float]]:
    """Coefficients and intercept of each class that has its own; two classes share one set."""
    if isinstance(model, LinearSVCModel) or model.numClasses == 2:
        return [[float(w) for w in model.coefficients]], [float(model.intercept)]
    return model.coefficientMatrix.toArray().tolist(), [float(b) for b in model.interceptVector]


def _margins(model: Model, features: str) -> list[Column]:
    weights, intercepts = _weights(model)
    x = vector_to_array(features)
    return [
        F.aggregate(F.zip_with(x, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + b
        for w, b in zip(weights, intercepts, strict=True)
    ]


def _loss(model: Model, margins: Sequence[Column], label: str) -> Column:
    y = F.col(label)
    if isinstance(model, LinearSVCModel):
        return F.greatest(F.lit(0.0), 1.0 - (2.0 * y - 1.0) * margins[0])
    if len(margins) == 1:
        signed = F.when(y == 1, -margins[0]).otherwise(margins[0])
        return F.when(signed > 0, signed + F.log1p(F.exp(-signed))).otherwise(F.log1p(F.exp(signed)))
    top = F.greatest(*margins)
    own = F.element_at(F.array(*margins), (y + 1).cast("int"))
    return F.log(sum((F.exp(m - top) for m in margins), F.lit(0.0))) + top - own


def _standardized(model: Model) -> bool:
    return bool(model.getOrDefault("standardization"))


def column_deviations(df: DataFrame, features: str = "features") -> list[float]:
    """Sample deviation of every entry of a vector column, in one grouped pass."""
    cells = df.select(F.posexplode(vector_to_array(features)).alias("j", "x"))
    rows = cells.groupBy("j").agg(F.stddev_samp("x").alias("sd")).orderBy("j").collect()  # a row per column
    return [float(r["sd"] or 0.0) for r in rows]


def linear_objective(model: Model, df: DataFrame, label: str = "label", features: str = "features") -> float:
    """What the fit minimised, at the model's coefficients: mean loss of ``df`` plus the penalty.

    Equals the last entry of the training summary's objective history.
    """
    rate = float(model.getOrDefault("regParam"))
    share = float(model.getOrDefault("elasticNetParam")) if model.hasParam("elasticNetParam") else 0.0
    scale = column_deviations(df, features) if _standardized(model) else None
    margins = _margins(model, features)
    named = df.select(F.col(label), *(m.alias(f"_m{i}") for i, m in enumerate(margins)))
    mean = named.agg(F.avg(_loss(model, [F.col(f"_m{i}") for i in range(len(margins))], label))).first()[0]
    scaled = [w * (scale[j] if scale else 1.0) for row in _weights(model)[0] for j, w in enumerate(row)]
    return float(mean) + rate * ((1 - share) / 2 * sum(w * w for w in scaled) + share * sum(map(abs, scaled)))


def optimality(model: LogisticRegressionModel, df: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """``cls, j, coefficient, residual``: how far each coefficient is from its optimality condition.

    The gradient of the mean loss is an aggregate over the rows. With the penalty's gradient it has to
    be zero; where an L1 share holds a coefficient at zero, no larger than that share's weight.
    ``j`` is -1 for the intercept, which has no penalty.
    """
    rate, share = float(model.getOrDefault("regParam")), float(model.getOrDefault("elasticNetParam"))
    scale = column_deviations(df, features) if _standardized(model) else None
    weights, intercepts = _weights(model)
    margins, y = [F.col(f"_m{k}") for k in range(len(weights))], F.col(label)
    if len(weights) == 1:
        errors = [1.0 / (1.0 + F.exp(-margins[0])) - y]
    else:
        total = sum((F.exp(m - F.greatest(*margins)) for m in margins), F.lit(0.0))
        errors = [F.exp(m - F.greatest(*margins)) / total - F.when(y == k, 1.0).otherwise(0.0) for k, m in enumerate(margins)]
    named = df.select(label, vector_to_array(features).alias("_x"), *(m.alias(f"_m{k}") for k, m in enumerate(_margins(model, features))))
    named = named.select("_x", *(e.alias(f"_e{k}") for k, e in enumerate(errors)))
    cells = named.select(*(f"_e{k}" for k in range(len(errors))), F.posexplode(F.array_append("_x", F.lit(1.0))).alias("j", "x"))
    sums = cells.groupBy("j").agg(*(F.avg(F.col(f"_e{k}") * F.col("x")).alias(f"_g{k}") for k in range(len(errors))))
    width = len(weights[0])
    rows = [
        (k, j if j < width else -1, j, weights[k][j] if j < width else intercepts[k], (scale[j] if scale else 1.0) if j < width else 0.0)
        for k in range(len(weights))
        for j in range(width + 1)
    ]
    table = df.sparkSession.createDataFrame(rows, "cls int, column int, j int, coefficient double, scale double")
    grads = sums.select("j", F.posexplode(F.array(*(f"_g{k}" for k in range(len(errors))))).alias("cls", "gradient"))
    c, sd = F.col("coefficient") * F.col("scale"), F.col("scale")
    slope = F.when(sd > 0, F.col("gradient") / F.nullif(sd, F.lit(0.0)) + rate * (1 - share) * c).when(F.col("column") < 0, F.col("gradient")).otherwise(0.0)
    held = F.greatest(F.abs(slope) - rate * share, F.lit(0.0))
    residual = F.when(F.col("column") < 0, F.abs(slope)).when(c == 0, held).otherwise(F.abs(slope + rate * share * F.signum(c)))
    return table.join(grads, ["cls", "j"]).select("cls", F.col("column").alias("j"), "coefficient", residual.alias("residual"))


# ---- trees ------------------------------------------------------------------

NODES = (
    "tree int, weight double, node int, feature int, split double, left int, right int, value double, stats array<double>, "
    "impurity double, gain double, n bigint"
)


def node_table(model: Model) -> DataFrame:
    """One row per node of a fitted ensemble: ``NODES``. ``left`` and ``right`` are -1 at a leaf, ``stats``
    the class weights (or moments) that training gathered there, ``n`` its training rows.

    Its size follows from the settings: trees times nodes of a tree of full depth.
    """
    from pyspark.sql import SparkSession

    rows = []
    for tree, (part, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        todo, count = [(part._java_obj.rootNode(), 0)], 1
        while todo:
            node, at = todo.pop()
            stats = [float(s) for s in node.impurityStats().stats()]
            shared = (float(node.prediction()), stats, float(node.impurity()))
            if node.subtreeDepth() == 0:
                rows.append((tree, float(weight), at, -1, 0.0, -1, -1, *shared, 0.0, int(node.impurityStats().rawCount())))
                continue
            split, left, right = node.split(), count, count + 1
            count += 2
            rows.append((tree, float(weight), at, int(split.featureIndex()), float(split.threshold()), left, right, *shared, float(node.gain()), int(node.impurityStats().rawCount())))
            todo += [(node.leftChild(), left), (node.rightChild(), right)]
    return SparkSession.active().createDataFrame(rows, NODES)


def walked(df: DataFrame, nodes: DataFrame, depth: int, key: str, features: str = "features") -> DataFrame:
    """``key, tree, weight, node, value, stats``: the leaf each row reaches in each tree.

    A tree's nodes are one array, so a row needs no join to go down: each step reads the node it is
    at and goes left or right. The trees come as one value; there are as many as the settings say.
    """
    entry = F.struct("node", "feature", "split", "left", "right", "value", "stats")
    trees = nodes.groupBy("tree", "weight").agg(F.array_sort(F.collect_list(entry)).alias("nodes"))
    listed = trees.agg(F.array_sort(F.collect_list(F.struct("tree", "weight", "nodes"))).alias("trees"))
    rows = df.select(key, vector_to_array(features).alias("_x"), listed.scalar().alias("_trees")).select(key, "_x", F.inline("_trees"))

    def down(at: Column, _: Column) -> Column:
        node = F.col("nodes")[at]
        below = F.when(F.col("_x")[node["feature"]] <= node["split"], node["left"]).otherwise(node["right"])
        return F.when(node["left"] < 0, at).otherwise(below)

    at = F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), F.lit(0), down)
    leaf = F.col("nodes")[F.col("node")]
    return rows.withColumn("node", at).select(key, "tree", "weight", "node", leaf["value"].alias("value"), leaf["stats"].alias("stats"))


def boosted_prediction(leaves: DataFrame, key: str) -> DataFrame:
    """``key, score, prediction`` of boosted trees: the weighted sum of the leaves' values."""
    sums = leaves.groupBy(key).agg(F.sum(F.col("weight") * F.col("value")).alias("score"))
    return sums.withColumn("prediction", F.when(F.col("score") > 0, 1.0).otherwise(0.0))


def forest_prediction(leaves: DataFrame, key: str) -> DataFrame:
    """``key, score, prediction`` of a forest of two classes: each tree votes with its leaf's class shares."""
    total = F.aggregate("stats", F.lit(0.0), lambda s, v: s + v)
    sums = leaves.groupBy(key).agg(F.avg(F.col("stats")[1] / total).alias("score"))
    return sums.withColumn("prediction", F.when(F.col("score") > 0.5, 1.0).otherwise(0.0))


def importances(nodes: DataFrame, per_tree: bool) -> DataFrame:
    """``feature, importance``: gains of a feature's splits, weighted by the rows they part, as shares.

    ``per_tree`` first makes each tree's importances shares (forests do, boosted trees do not).
    """
    weight = F.aggregate("stats", F.lit(0.0), lambda s, v: s + v) if per_tree else F.col("stats")[0]
    gains = nodes.where("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * weight).alias("gain"))
    if per_tree:
        totals = gains.groupBy("tree").agg(F.sum("gain").alias("total"))
        gains = gains.join(totals, "tree").withColumn("gain", F.try_divide("gain", "total"))
    sums = gains.groupBy("feature").agg(F.sum("gain").alias("gain"))
    whole = sums.agg(F.sum("gain")).scalar()
    return sums.select("feature", (F.col("gain") / whole).alias("importance"))
