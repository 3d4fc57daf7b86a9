"""The full 18-feature node table."""

from pyspark.sql import DataFrame, functions as F

from hostweave.functions.durable import durable
from hostweave.operators.centrality import centrality
from hostweave.operators.graph import GRAPH_KEY, basic_features, edges, nodes
from hostweave.operators.temporal import bursts, gap_entropy, out_ticks
from hostweave.schemas import NODE_FEATURES

_NODE = [GRAPH_KEY, "node_id"]


def node_features(
    pairs: DataFrame, burst_run: int = 6, burst_within_us: int = 200_000, cut: bool = True
) -> DataFrame:
    """All features of every node; ``pairs`` is materialised first unless ``cut`` is false."""
    pairs = durable(pairs) if cut else pairs
    ticks = out_ticks(edges(pairs))
    entropy = gap_entropy(ticks).withColumnRenamed("source", "node_id")
    burst = bursts(ticks, burst_run, burst_within_us).withColumnRenamed("source", "node_id")
    return (
        basic_features(nodes(pairs))
        .join(entropy, _NODE, "left")
        .join(burst, _NODE, "left")
        .join(centrality(pairs), _NODE)
        .fillna(0, ["temporal_entropy", "burst_flag"])
        .select(*_NODE, "node_type", "first_pos", *NODE_FEATURES))


def feature_vector(features: DataFrame) -> DataFrame:
    """``features`` as one array of doubles in vector order; a missing value is 0."""
    return features.withColumn("features", F.array(
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NODE_FEATURES]))
