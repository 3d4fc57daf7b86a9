"""Window graphs as node-link documents.

The two graph tables are the storage form. Documents gather nodes and edges in
rows; a window with more than ``PART_ROWS`` of either becomes several numbered
documents, so no row grows without bound.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostweave.functions.ordered import position_in_order
from hostweave.functions.timefn import floor_div
from hostweave.operators.graph import GRAPH_KEY
from hostweave.schemas import GRAPH_DOCUMENT, TIMESTAMP_FORMAT

PART_ROWS = 100_000


def write_graph_tables(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges as Parquet, partitioned by day."""
    day = F.col(GRAPH_KEY).cast("date")
    for name, rows in (("nodes", nodes), ("edges", edges)):
        rows.withColumn("day", day).write.partitionBy("day").parquet(f"{folder}/{name}")


def read_graph_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def graph_documents(
    indexed_nodes: DataFrame, edges: DataFrame, part_rows: int = PART_ROWS
) -> DataFrame:
    """Node-link documents per window and part, nodes and edges in first-mention order.

    ``indexed_nodes`` comes from ``with_node_index``.
    """
    key = [GRAPH_KEY, "part"]
    node = F.struct("node_idx", F.struct(
        F.col("node_id").alias("id"), "node_type", "in_degree", "out_degree").alias("v"))
    edge = F.struct("edge_idx", F.struct("source", "target", "event", "ts").alias("v"))
    # Every edge begins with its own event, so first ordinals are distinct in a window.
    placed = position_in_order(
        edges, [GRAPH_KEY], "first_ordinal", "edge_idx", width=65_536, ties=["target"])

    def gathered(rows: DataFrame, index: str, item: Column, name: str) -> DataFrame:
        parts = rows.withColumn("part", floor_div(F.col(index), part_rows))
        return parts.groupBy(*key).agg(F.transform(
            F.array_sort(F.collect_list(item)), lambda s: s["v"]).alias(name))

    node_lists = gathered(indexed_nodes, "node_idx", node, "nodes")
    edge_lists = gathered(placed, "edge_idx", edge, "edges")

    def filled(name: str, lists: DataFrame) -> Column:
        return F.coalesce(name, F.array().cast(lists.schema[name].dataType)).alias(name)

    return node_lists.join(edge_lists, key, "full_outer").select(
        *key, F.lit(True).alias("directed"), F.lit(False).alias("multigraph"),
        filled("nodes", node_lists), filled("edges", edge_lists))


def write_graph_documents(documents: DataFrame, path: str) -> None:
    documents.write.option("timestampNTZFormat", TIMESTAMP_FORMAT).json(path)


def read_graph_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GRAPH_DOCUMENT).option(
        "timestampNTZFormat", TIMESTAMP_FORMAT).json(path)


def document_nodes(documents: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    place = (F.col("part") * part_rows + F.col("pos")).alias("node_idx")
    return documents.select(GRAPH_KEY, "part", F.posexplode("nodes").alias("pos", "n")).select(
        GRAPH_KEY, place, F.col("n.id").alias("node_id"), "n.node_type", "n.in_degree",
        "n.out_degree")


def document_edges(documents: DataFrame) -> DataFrame:
    return documents.select(GRAPH_KEY, F.explode("edges").alias("e")).select(GRAPH_KEY, "e.*")
