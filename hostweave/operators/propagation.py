"""Feature propagation and pooling over window graphs, as joins and groupings."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from hostweave.functions.durable import durable
from hostweave.functions.hubs import dealt, hub_parts, repeated
from hostweave.operators.graph import GRAPH_KEY
from hostweave.schemas import GRAPH_EVENT_TYPES

_NODE = [GRAPH_KEY, "node_id"]


def edge_type_counts(
    edge_rows: DataFrame, vocabulary: Sequence[str] = GRAPH_EVENT_TYPES
) -> DataFrame:
    """Out-edges of every node by event type, one column per type."""
    return edge_rows.groupBy(GRAPH_KEY, F.col("source").alias("node_id")).agg(*[
        F.count_if(F.col("event") == name).alias(name.removeprefix("EVENT_").lower())
        for name in vocabulary])


def neighbour_means(
    node_values: DataFrame, edge_rows: DataFrame, columns: Sequence[str], hops: int = 1, hub_edges: int = 100_000
) -> DataFrame:
    """Mean of ``columns`` over in-neighbours, repeated ``hops`` times.

    Adds ``<column>_h<i>`` per hop beside the node's own values; a node without
    in-neighbours gets 0. The out-edges of a node with more than ``hub_edges`` of
    them are dealt over parts, each with a copy of the node's values; a node with
    many in-edges is averaged from partial sums, as any grouping is.
    """
    keys = [GRAPH_KEY, "source"]
    links = edge_rows.select(*keys, "target")
    hubs = durable(hub_parts(links, keys, hub_edges))
    links = dealt(links, hubs, keys, F.col("target"))
    out = node_values.select(*_NODE, *columns)
    current = list(columns)
    for hop in range(1, hops + 1):
        fresh = [f"{c}_h{hop}" for c in columns]
        source = repeated(out.select(GRAPH_KEY, F.col("node_id").alias("source"), *current), hubs, keys)
        means = (
            links.join(source, [*keys, "__part"])
            .groupBy(GRAPH_KEY, F.col("target").alias("node_id"))
            .agg(*[F.avg(c).alias(n) for c, n in zip(current, fresh, strict=True)]))
        out = out.join(means, _NODE, "left").fillna(0.0, fresh)
        if hop < hops:
            # The next hop reads this twice; without a cut the plan doubles per hop.
            out = durable(out)
        current = fresh
    return out


def graph_embedding(node_values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of the node features per window."""
    return node_values.groupBy(GRAPH_KEY).agg(
        F.count(F.lit(1)).alias("n_nodes"), *[F.avg(c).alias(c) for c in columns])


def linear_score(weights: dict[str, float], bias: float = 0.0):
    score = F.lit(float(bias))
    for name, weight in weights.items():
        score = score + F.lit(float(weight)) * F.col(name)
    return score


def temporal_attention(
    step_embeddings: DataFrame, weights: dict[str, float], bias: float = 0.0
) -> DataFrame:
    """Softmax over the steps of each sequence of a linear score of the step embedding."""
    steps = Window.partitionBy("sequence_id")
    scored = step_embeddings.withColumn("score", linear_score(weights, bias))
    raised = scored.withColumn("__e", F.exp(F.col("score") - F.max("score").over(steps)))
    return raised.withColumn("weight", F.col("__e") / F.sum("__e").over(steps)).drop("__e")


def attended_embedding(attention: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Weighted sum of the step embeddings."""
    return attention.groupBy("sequence_id").agg(
        F.max("label").alias("label"),
        *[F.sum(F.col(c) * F.col("weight")).alias(c) for c in columns])


def step_matrix(step_embeddings: DataFrame, columns: Sequence[str], length: int = 3) -> DataFrame:
    """One row per sequence with the embedding of every step side by side."""
    cells = [
        F.max(F.when(F.col("step") == step, F.col(c))).alias(f"{c}_t{step}")
        for step in range(length) for c in columns]
    return step_embeddings.groupBy("sequence_id").agg(F.max("label").alias("label"), *cells)
