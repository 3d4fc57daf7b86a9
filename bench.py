"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR  table folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hostweave.functions.durable import durable  # noqa: E402
from hostweave.operators.centrality import centrality  # noqa: E402
from hostweave.operators.features import node_features  # noqa: E402
from hostweave.plans import catalog, dataset, testview as view  # noqa: E402
from hostweave.session import local_session  # noqa: E402


def hour_features(spark, folder):
    return node_features(dataset.window_pairs(view.events(spark, folder), view.HOUR))


def one_window_centrality(spark, folder):
    """The whole log in a single window: the worst skew there is."""
    month = 40 * view.DAY
    return centrality(durable(dataset.window_pairs(view.events(spark, folder), month)))


NAMED = [
    "tumbling_windows", "overlapping_windows", "anchored_windows", "label_table", "graph_nodes",
    "graph_edges", "overlapping_graph_edges", "node_index", "basic_node_features",
    "temporal_entropy", "burst_flags", "betweenness", "cluster_coeff_by_joins",
    "all_node_features", "sequence_windows", "type_distribution", "summary_report",
    "burst_minutes", "long_gaps", "findings_report", "top_remote_addresses", "read_then_send",
    "process_ancestry", "forward_reach", "neighbour_means", "temporal_attention", "stories",
    "top_nodes", "live_window_counts", "live_node_features",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    todo = {name: catalog.QUERIES[name] for name in NAMED}
    todo["hour_features"] = hour_features
    todo["one_window_centrality"] = one_window_centrality
    view.events(spark, folder).count()  # start the JVM and the file cache
    seconds = {}
    for name, run in todo.items():
        start = time.time()
        run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
