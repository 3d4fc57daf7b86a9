"""Splitting, training, batch scoring and evaluation of sequence classifiers."""

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from hostweave.functions.ordered import position_in_order
from hostweave.operators.propagation import linear_score

# Class weights of benign and malicious sequences.
CLASS_WEIGHTS = {0: 0.3, 1: 0.7}


def stratified_split(
    df: DataFrame, key: str, label: str = "label", train_share: float = 0.8, seed: int = 0,
    time_order: bool = False,
) -> DataFrame:
    """Add ``split``: the first ``train_share`` of every label's rows is ``train``.

    Rows are ranked by a seeded hash of ``key``, or by ``key`` itself with
    ``time_order`` (which keeps later sequences out of training). Ranks are
    taken in slots, so a label of any size is split exactly.
    """
    if time_order:
        ranked = df.withColumn("__h", F.col(key).cast("bigint"))
        width = 65_536
    else:
        digest = F.md5(F.concat_ws("#", F.col(key), F.lit(seed)))
        ranked = df.withColumn("__h", F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint"))
        width = 2 ** 30
    ranked = position_in_order(ranked, [label], "__h", "__rank", width, ties=[key])
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    return ranked.join(sizes, label).withColumn(
        "split", F.when(F.col("__rank") < F.floor(F.col("__n") * train_share), "train")
        .otherwise("test")).drop("__h", "__rank", "__n")


def boundary_split(
    df: DataFrame, key: str = "sequence_id", train_share: float = 0.8, length: int = 3
) -> DataFrame:
    """Add ``split``: sequences before one boundary in time train, later ones test.

    Sequence numbers are dense and overlap by ``length - 1`` windows, so as many
    sequences at the boundary, marked ``gap``, belong to neither side.
    """
    first = F.floor(df.select(F.count(F.lit(1))).scalar() * train_share)
    return df.withColumn(
        "split", F.when(F.col(key) < first, "train").when(F.col(key) < first + (length - 1), "gap").otherwise("test"))


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    weight = F.when(F.col(label) == 1, CLASS_WEIGHTS[1]).otherwise(CLASS_WEIGHTS[0])
    return df.withColumn("class_weight", weight)


def train_classifier(
    train: DataFrame, features: Sequence[str], kind: str = "logistic"
) -> PipelineModel:
    """Assemble, scale and classify; ``kind`` is ``logistic`` or ``trees``."""
    estimators = {"logistic": LogisticRegression, "trees": GBTClassifier}
    classifier = estimators[kind](
        featuresCol="scaled", labelCol="label", weightCol="class_weight",
        **({"maxIter": 50} if kind == "logistic" else {"seed": 0}))
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="assembled", handleInvalid="keep"),
        StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True),
        classifier,
    ]).fit(with_class_weight(train))


def score_sequences(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select(
        "sequence_id", "label", F.col("prediction").cast("int").alias("prediction"))


def score_linear(
    rows: DataFrame, weights: dict[str, float], bias: float = 0.0, cutoff: float = 0.5
) -> DataFrame:
    """Score sequences with given coefficients: the logistic function of the weighted columns.

    For models whose coefficients were exported; a score above ``cutoff`` predicts 1. A missing
    column value makes score and prediction null.
    """
    return rows.select(
        "sequence_id", "label", (1 / (1 + F.exp(-linear_score(weights, bias)))).alias("score")).withColumn(
        "prediction", (F.col("score") > cutoff).cast("int"))


def evaluation(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision and recall of the positive class."""
    label, prediction = F.col("label"), F.col("prediction")
    hit = F.count_if((prediction == 1) & (label == 1))
    def ratio(total: Column) -> Column:
        return F.when(total > 0, hit / total)
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg((prediction == label).cast("double")).alias("accuracy"),
        ratio(F.count_if(prediction == 1)).alias("precision"),
        ratio(F.count_if(label == 1)).alias("recall"))


def node_importance(
    node_values: DataFrame, embedding: DataFrame, weights: dict[str, float],
    key: str = "window_start",
) -> DataFrame:
    """How much a window's linear score moves if one node is left out of its mean.

    With score w·mean(x) over n nodes, leaving out x changes it by
    w·(x - mean)/(n - 1); a node alone in its window has importance 0.
    """
    moved = F.lit(0.0)
    for name, weight in weights.items():
        moved = moved + F.lit(float(weight)) * (F.col(name) - F.col(f"__mean_{name}"))
    means = embedding.select(
        key, "n_nodes", *[F.col(c).alias(f"__mean_{c}") for c in weights])
    return node_values.join(means, key).select(
        key, "node_id",
        F.when(F.col("n_nodes") > 1, F.abs(moved) / (F.col("n_nodes") - 1))
        .otherwise(0.0).alias("importance"))
