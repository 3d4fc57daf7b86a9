"""Incident summaries from explanations: attention per step, importance per node.

Explanations are held as long tables: ``attention`` (sequence_id, step, weight)
and ``importance`` (sequence_id, step, window_start, node_id, importance). A
step's nodes are always resolved in the graph of that step.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostweave.functions.ordered import position_in_order
from hostweave.functions.timefn import to_micros
from hostweave.functions.text import clock, percent, verdict
from hostweave.schemas import TECHNIQUES

TOP_TECHNIQUE = TECHNIQUES["EXECUTE"]

# The wording of a story.
STORY = (
    "Sequence %d is classified as %s.\n"
    "Highest importance occurred at timestep with weight %.3f.\n"
    "Severity Score: %s.\nPossible MITRE Techniques: %s.")


def severity(weights: Column, prediction: Column) -> Column:
    """Weight of the last step, damped for benign sequences."""
    factor = F.when(prediction == 1, 1.0).otherwise(0.3)
    return F.bround(F.element_at(weights, -1) * factor, 2)


def step_weights(attention: DataFrame) -> DataFrame:
    """(sequence_id, weights) with the weights in step order; a sequence has few steps."""
    return attention.groupBy("sequence_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("step", "weight"))),
        lambda s: s["weight"]).alias("weights"))


def flagged_steps(importance: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(sequence_id, step) whose largest node score exceeds the threshold, with the technique."""
    return importance.groupBy("sequence_id", "step").agg(
        F.max("importance").alias("top_score")).filter(
        F.col("top_score") > threshold).withColumn("technique", F.lit(TOP_TECHNIQUE))


def event_techniques(events: DataFrame, key: str = "window_start") -> DataFrame:
    """Distinct techniques per window by event verb."""
    verb = F.regexp_replace("type", "^EVENT_", "")
    pairs = F.create_map(*[F.lit(x) for pair in TECHNIQUES.items() for x in pair])
    return events.select(key, pairs[verb].alias("technique")).filter(
        "technique IS NOT NULL").distinct()


def stories(
    predictions: DataFrame, attention: DataFrame, importance: DataFrame, threshold: float = 0.05
) -> DataFrame:
    """Severity, techniques and text per sequence."""
    techniques = flagged_steps(importance, threshold).groupBy("sequence_id").agg(
        F.collect_list("technique").alias("techniques"))
    rows = (
        predictions.select("sequence_id", "prediction")
        .join(step_weights(attention), "sequence_id")
        .join(techniques, "sequence_id", "left")
        .withColumn("techniques", F.coalesce("techniques", F.array().cast("array<string>")))
        .withColumn("severity", severity(F.col("weights"), F.col("prediction"))))
    named = F.when(F.size("techniques") > 0, F.array_join("techniques", ", ")).otherwise(
        "None detected")
    text = F.format_string(
        STORY, F.col("sequence_id"), verdict("prediction"), F.array_max("weights"),
        F.col("severity").cast("string"), named)
    return rows.withColumn("story", text)


def top_nodes(importance: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most important nodes of each sequence over all of its steps.

    Spark turns the rank filter into a group limit before the shuffle, so each
    task sends at most ``k`` rows per sequence.
    """
    best = Window.partitionBy("sequence_id").orderBy(F.desc("importance"), "step", "node_id")
    ranked = importance.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(nodes.select("window_start", "node_id", "node_type"),
                       ["window_start", "node_id"]).select(
        "sequence_id", "rank", "step", "node_id", "node_type", "importance",
        percent("importance", 2).alias("score_text"))


def timeline(edges: DataFrame) -> DataFrame:
    """One line of text per edge with its place in its window, by time and first mention."""
    line = F.concat(clock("ts"), F.lit(" → "), F.concat_ws(" ", "source", "event", "target"))
    placed = position_in_order(
        edges.withColumn("__us", to_micros("ts")), ["window_start"], "__us", "position",
        width=3_600_000_000, ties=["first_ordinal", "target"])
    return placed.select("window_start", "position", "ts", line.alias("line"))


def hot_nodes(importance: DataFrame, above: float = 0.6, key: str = "window_start") -> DataFrame:
    """Nodes whose score is close to the largest of their window."""
    largest = importance.groupBy(key).agg(
        F.greatest(F.max("importance"), F.lit(1e-5)).alias("__top"))
    return importance.join(largest, key).withColumn(
        "heat", F.col("importance") / F.col("__top")).filter(F.col("heat") > above).drop("__top")


def by_role(nodes: DataFrame, role: str) -> DataFrame:
    """Nodes that ended a window as ``subject`` or as ``object``."""
    return nodes.filter(F.col("node_type_flag") == (1 if role == "subject" else 0))


def write_by_sequence(table: DataFrame, path: str, buckets: int = 64) -> None:
    """Rows with a ``sequence_id`` as Parquet, partitioned by a part of the id."""
    table.withColumn("bucket", F.pmod(F.col("sequence_id"), F.lit(buckets)).cast("int")).write.partitionBy(
        "bucket").parquet(path)


def lookup_sequence(table: DataFrame, sequence_id: int, buckets: int = 64) -> DataFrame:
    """Rows of one sequence; only the files of its partition are read."""
    return table.filter(
        (F.col("bucket") == sequence_id % buckets) & (F.col("sequence_id") == sequence_id)).drop("bucket")


def lookup(table: DataFrame, column: str, value) -> DataFrame:
    """Rows of a stored table by id; on a partition column only that partition is read."""
    return table.filter(F.col(column) == F.lit(value))
