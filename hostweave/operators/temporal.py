"""Node features from the order of a node's out-edge times.

A node can own most edges of a busy window, so nothing here sorts a whole node
in one task: times are first merged to one row per microsecond, then handled
in slots (see ``functions.ordered``).
"""

from pyspark.sql import DataFrame, Window, functions as F

from hostweave.functions.ordered import latest_before
from hostweave.functions.timefn import floor_div, to_micros
from hostweave.operators.graph import GRAPH_KEY

_SECOND = 1_000_000
_NODE = [GRAPH_KEY, "source"]


def out_ticks(edge_rows: DataFrame) -> DataFrame:
    """Distinct out-edge times per node with the number of edges at each."""
    return edge_rows.groupBy(*_NODE, to_micros("ts").alias("ts_us")).agg(
        F.count(F.lit(1)).alias("n_edges"))


def gap_entropy(ticks: DataFrame) -> DataFrame:
    """Entropy of the shares that consecutive gaps have in a node's active span.

    Edges at the same instant have gap 0 and add nothing, so distinct times suffice.
    """
    spans = ticks.groupBy(*_NODE).agg(
        (F.max("ts_us") - F.min("ts_us")).alias("__span")).filter("__span > 0")
    # Slots are seconds of one window, so their table needs no further level.
    gaps = latest_before(ticks.select(*_NODE, "ts_us"), _NODE, "ts_us", F.col("ts_us"),
                         "__prev", _SECOND, levels=0).filter(F.col("__prev").isNotNull())
    share = (F.col("ts_us") - F.col("__prev")) / F.col("__span")
    return gaps.join(spans, _NODE).groupBy(*_NODE).agg(
        (-F.sum(share * F.log(share + F.lit(1e-9)))).alias("temporal_entropy"))


def bursts(ticks: DataFrame, run: int = 6, within_us: int = 200_000) -> DataFrame:
    """Nodes with ``run`` consecutive out-edges inside less than ``within_us``."""
    width = max(_SECOND, within_us)
    slot = floor_div(F.col("ts_us"), width)
    # A run may cross into the next slot, so the head of a slot is shown to the
    # slot before it too. More than `run` edges at one instant change nothing.
    # A run of copies that lies wholly in the head is found in its own slot.
    in_head = (F.col("ts_us") - slot * F.lit(width)) < within_us
    views = F.when(in_head, F.array(slot, slot - 1)).otherwise(F.array(slot))
    rows = ticks.select(
        *_NODE, "ts_us", F.explode(views).alias("__slot"), "n_edges",
    ).select(
        *_NODE, "__slot", "ts_us",
        F.explode(F.array_repeat(F.lit(1), F.least(F.col("n_edges"), F.lit(run)).cast("int"))))
    ordered = Window.partitionBy(*_NODE, "__slot").orderBy("ts_us")
    reach = F.lead("ts_us", run - 1).over(ordered) - F.col("ts_us")
    return rows.withColumn("__reach", reach).filter(F.col("__reach") < within_us).select(
        *_NODE).distinct().withColumn("burst_flag", F.lit(1))
