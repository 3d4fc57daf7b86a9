"""Explanation documents and their long form."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostweave.functions.timefn import floor_div
from hostweave.operators.story import step_weights
from hostweave.schemas import EXPLANATIONS
from hostweave.sources.graph_docs import PART_ROWS


def explanation_documents(
    predictions: DataFrame, attention: DataFrame, indexed_importance: DataFrame,
    length: int = 3, part_rows: int = PART_ROWS,
) -> DataFrame:
    """Documents per sequence; ``indexed_importance`` has step, node_idx, importance.

    A document holds one score array per step. Nodes beyond ``part_rows`` of a
    step go to further numbered documents of the same sequence.
    """
    key = ["sequence_id", "part"]
    per_step = indexed_importance.withColumn(
        "part", floor_div(F.col("node_idx"), part_rows)).groupBy(*key, "step").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("node_idx", "importance"))),
            lambda s: s["importance"]).alias("scores"))
    by_step = per_step.groupBy(*key).agg(F.map_from_entries(
        F.collect_list(F.struct(F.col("step").cast("int"), "scores"))).alias("m"))
    empty = F.array().cast("array<double>")
    nested = by_step.select(*key, F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)),
        lambda step: F.coalesce(F.col("m")[step], empty)).alias("node_importance"))
    return (
        predictions.select("sequence_id", "prediction")
        .join(step_weights(attention), "sequence_id").join(nested, "sequence_id")
        .select(*key, "prediction", F.col("weights").alias("temporal_attention"),
                "node_importance",
                F.transform("node_importance", lambda _: empty).alias("edge_importance")))


def write_explanations(documents: DataFrame, path: str) -> None:
    documents.write.json(path)


def read_explanations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPLANATIONS).json(path)


def importance_rows(documents: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(sequence_id, step, node_idx, importance)."""
    steps = documents.select(
        "sequence_id", "part", F.posexplode("node_importance").alias("step", "scores"))
    return steps.select(
        "sequence_id", "part", "step", F.posexplode("scores").alias("pos", "importance"),
    ).select("sequence_id", "step", (F.col("part") * part_rows + F.col("pos")).alias("node_idx"),
             "importance")
