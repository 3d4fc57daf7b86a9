"""Sequences of consecutive non-empty windows."""

from pyspark.sql import DataFrame, functions as F


def sequence_steps(labels: DataFrame, length: int = 3) -> DataFrame:
    """(sequence_id, step, window_id, label) for every full run of ``length`` windows.

    ``labels`` has dense window ids, so window i is step k of sequence i-k. No
    ordering of the whole window table is needed.
    """
    columns = [c for c in ("window_start",) if c in labels.columns]
    spread = labels.select(
        "window_id", "label", *columns,
        F.posexplode(F.sequence(F.lit(0), F.lit(length - 1))).alias("step", "__k"),
    ).withColumn("sequence_id", F.col("window_id") - F.col("step")).filter("sequence_id >= 0")
    last = labels.select(F.max("window_id")).scalar()
    return spread.filter(F.col("sequence_id") + (length - 1) <= last).select(
        "sequence_id", "step", "window_id", *columns, "label")


def sequences(steps: DataFrame) -> DataFrame:
    """One row per sequence: its windows in order and the OR of their labels."""
    return steps.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list("window_id")).alias("window_ids"),
        F.max("label").alias("label"))


def centre_windows(steps: DataFrame) -> DataFrame:
    return steps.filter("step = 1").select("sequence_id", "window_id")


def sequence_members(steps: DataFrame, per_window: DataFrame, key: str = "window_start") -> DataFrame:
    """Rows of a per-window table (nodes, edges, embeddings) for each step of each sequence."""
    return steps.join(per_window, key)
