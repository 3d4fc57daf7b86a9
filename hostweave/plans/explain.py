"""From stored node tables to scored, explained and told sequences."""

from pyspark.sql import DataFrame, Window, functions as F

from hostweave.functions.durable import durable
from hostweave.operators import propagation, scoring, sequences, story


class Explanation:
    """Tables of a linear score over windows and their sequences.

    ``nodes`` has one row per (window_start, node_id) with the weighted
    features; ``labels`` has window_id, window_start and label. Both should be
    stored or materialised tables: every result below reads them.
    """

    def __init__(
        self, nodes: DataFrame, labels: DataFrame, weights: dict[str, float],
        bias: float = 0.0, cutoff: float = 0.0, length: int = 3, digits: int = 6,
    ):
        self.nodes, self.weights, self.bias, self.cutoff = nodes, weights, bias, cutoff
        self.digits = digits
        self.features = list(weights)
        self.steps = durable(sequences.sequence_steps(labels, length))
        self.embedding = propagation.graph_embedding(nodes, self.features)

    def members(self) -> DataFrame:
        """Pooled embedding of every step of every sequence."""
        return sequences.sequence_members(self.steps, self.embedding)

    def attention(self) -> DataFrame:
        return propagation.temporal_attention(self.members(), self.weights, self.bias)

    def rounded_attention(self) -> DataFrame:
        """Weights rounded, so that texts and ranks do not hang on the last bit."""
        return self.attention().withColumn("weight", F.round("weight", self.digits))

    def predictions(self, attention: DataFrame) -> DataFrame:
        score = propagation.linear_score(self.weights, self.bias)
        return propagation.attended_embedding(attention, self.features).withColumn(
            "prediction", (F.round(score, self.digits) > self.cutoff).cast("int")).select(
            "sequence_id", "label", "prediction")

    def window_importance(self) -> DataFrame:
        return scoring.node_importance(self.nodes, self.embedding, self.weights).withColumn(
            "importance", F.round("importance", self.digits))

    def importance(self) -> DataFrame:
        return sequences.sequence_members(self.steps, self.window_importance())

    def stories(self, threshold: float = 0.05) -> DataFrame:
        attention = durable(self.rounded_attention())
        return story.stories(
            self.predictions(attention), attention, self.largest(), threshold)

    def largest(self) -> DataFrame:
        """The largest node score of every step: taken per window, then joined to the steps."""
        top = self.window_importance().groupBy("window_start").agg(
            F.max("importance").alias("importance"))
        return sequences.sequence_members(self.steps, top)

    def foremost(self, k: int) -> DataFrame:
        """The ``k`` largest node scores of every step's window, joined to the steps."""
        best = Window.partitionBy("window_start").orderBy(F.desc("importance"), "node_id")
        top = self.window_importance().withColumn("__rank", F.row_number().over(best)).filter(
            F.col("__rank") <= k).drop("__rank")
        return sequences.sequence_members(self.steps, top)
