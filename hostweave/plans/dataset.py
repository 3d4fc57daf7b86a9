"""End-to-end builds."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from hostweave.functions.durable import durable
from hostweave.functions.timefn import from_micros, to_micros
from hostweave.operators import clean, graph, sequences, windows
from hostweave.operators.features import node_features
from hostweave.schemas import GRAPH_EVENT_TYPES
from hostweave.sources.tables import write_table


def labelled_windows(
    node_rows: DataFrame, seconds: int, attacks: Sequence[tuple[datetime, datetime]] | DataFrame
) -> DataFrame:
    """The label table: dense ids, bounds, label and graph size per window."""
    starts = durable(node_rows.groupBy("window_start").agg(
        F.count(F.lit(1)).alias("num_nodes"), F.sum("out_degree").alias("num_edges")))
    timed = starts.withColumn("window_end", from_micros(
        to_micros("window_start") + seconds * 1_000_000))
    numbered = windows.number_windows(timed, seconds)
    return windows.label_windows(numbered, attacks).select(
        "window_id", "window_start", "window_end", "label", "num_nodes", "num_edges")


def window_pairs(
    events: DataFrame, seconds: int, allowed: Sequence[str] | None = GRAPH_EVENT_TYPES,
    null_subject: str | None = None,
) -> DataFrame:
    """Cleaned events to per-window pairs; ``allowed=None`` keeps every event type.

    A list of event types is also the code book of the pairs; without a list, or
    with one too long for codes, types travel as texts.
    """
    codes = allowed if allowed is not None and len(allowed) <= graph.MOST_CODES else None
    return graph.interactions(windows.with_tumbling_window(
        clean.graph_events(events, allowed, null_subject), seconds), codes)


def build(
    events: DataFrame, folder: str, seconds: int = 1,
    attacks: Sequence[tuple[datetime, datetime]] | DataFrame = (), length: int = 3,
    allowed: Sequence[str] | None = GRAPH_EVENT_TYPES, null_subject: str | None = None,
) -> None:
    """Write the node, edge, label and sequence tables below ``folder``."""
    pairs = durable(window_pairs(events, seconds, allowed, null_subject))
    features = node_features(pairs, cut=False)
    day = F.col("window_start").cast("date")
    write_table(features.withColumn("day", day), f"{folder}/nodes", "day")
    write_table(graph.edges(pairs).withColumn("day", day), f"{folder}/edges", "day")
    labels = durable(labelled_windows(graph.nodes(pairs), seconds, attacks))
    write_table(labels, f"{folder}/labels")
    write_table(sequences.sequence_steps(labels, length), f"{folder}/sequences")
