"""Closeness, betweenness, PageRank and clustering of every node.

Windows are routed by measured size. Small windows run in ``mapInArrow``: whole
windows are packed into numpy batches. Paths of a costlier window are cut by
source nodes: what nothing reaches can only start a path, so its links go to one
task each, and only the core, the links of all other nodes, is in every task. A
core beyond a task is searched by joins with 64 source nodes in a row, for
betweenness a block of rows at a time. PageRank and clustering are never cut by
source nodes; beyond a task they run as joins. Both ways first fold leaves and
twins of the graph away, exactly, and give the same values.
"""

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hostweave.functions import kernels
from hostweave.functions.durable import durable
from hostweave.operators.graph import GRAPH_KEY, undirected

# Pair rows of one window that a single task may hold.
TASK_PAIRS = 200_000
# Source nodes times pairs that one task should work through.
TASK_WORK = 200_000_000
# Pair rows gathered into one numpy batch.
BATCH_PAIRS = 50_000
# Links of reduced graphs that a join may broadcast.
NEAR_LINKS = 50_000

MEASURES = ("closeness", "betweenness", "pagerank", "cluster_coeff")
_BY_PATHS = {"closeness", "betweenness"}

_NODE = [GRAPH_KEY, "node_id"]
_PARTIAL_SCHEMA = (
    "window_start timestamp_ntz, node_id string, n bigint, dependency double,"
    " reached bigint, distance bigint, pagerank double, cluster_coeff double")


def window_sizes(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(GRAPH_KEY).agg(F.count(F.lit(1)).alias("n_pairs"))


# --- windows that fit a task ----------------------------------------------


def _measure(rows: pd.DataFrame, measures: frozenset[str]) -> pd.DataFrame:
    """Partial measures of the windows in ``rows`` (complete windows or parts, sorted); others are 0."""
    starts = rows["window_start"].to_numpy()
    part = rows["slice"].to_numpy()
    opens = np.ones(len(rows), dtype=bool)
    opens[1:] = (starts[1:] != starts[:-1]) | (part[1:] != part[:-1])
    group = np.cumsum(opens) - 1
    has_target = rows["object"].notna().to_numpy()
    names = pd.concat([rows["subject"], rows["object"][has_target]], ignore_index=True)
    groups = np.concatenate((group, group[has_target]))
    codes, labels = pd.factorize(names)
    node, inverse = np.unique(groups * np.int64(len(labels)) + codes, return_inverse=True)
    node_window = node // len(labels)
    source = inverse[: len(rows)][has_target]
    target = inverse[len(rows):]
    batch = kernels.Batch(node_window, source, target)
    mine = np.unique(source[rows["root"].to_numpy()[has_target]])
    nothing = np.zeros(batch.n)
    dependency, reached, distance = kernels.path_sums(batch, mine) if measures & _BY_PATHS else (
        nothing, nothing.astype("int64"), nothing.astype("int64"))
    return pd.DataFrame({
        "window_start": starts[np.flatnonzero(opens)][batch.window],
        "node_id": np.asarray(labels)[node % len(labels)],
        "n": batch.node_size.astype("int64"),
        "dependency": dependency, "reached": reached, "distance": distance,
        "pagerank": kernels.pagerank(batch) if "pagerank" in measures else 0.0,
        "cluster_coeff": kernels.clustering(batch) if "cluster_coeff" in measures else 0.0})


def _measure_partition(
    measures: frozenset[str], batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Cut a sorted partition into batches of complete windows."""
    held: list[pd.DataFrame] = []
    count = 0

    def flush(rows: pd.DataFrame) -> pa.RecordBatch:
        out = _measure(rows, measures)
        return pa.RecordBatch.from_pandas(out, schema=_ARROW, preserve_index=False)

    for batch in batches:
        held.append(batch.to_pandas())
        count += batch.num_rows
        if count < BATCH_PAIRS:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = rows.iloc[-1]
        open_window = (
            (rows["window_start"] == last["window_start"]) & (rows["slice"] == last["slice"])
        ).to_numpy()
        if not open_window.all():
            yield flush(rows[~open_window].reset_index(drop=True))
        held = [rows[open_window]]
        count = int(open_window.sum())
    rows = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
    if len(rows):
        yield flush(rows)


_ARROW = pa.schema([
    ("window_start", pa.timestamp("us")), ("node_id", pa.string()), ("n", pa.int64()),
    ("dependency", pa.float64()), ("reached", pa.int64()), ("distance", pa.int64()),
    ("pagerank", pa.float64()), ("cluster_coeff", pa.float64())])


def _in_tasks(parts: DataFrame, measures: frozenset[str]) -> DataFrame:
    """``parts`` are pairs with the ``slice`` of the window they belong to and whether the subject is a ``root`` there."""
    return (
        parts.select(GRAPH_KEY, "subject", "object", "slice", "root").repartition(GRAPH_KEY, "slice")
        .sortWithinPartitions(GRAPH_KEY, "slice")
        .mapInArrow(functools.partial(_measure_partition, measures), _PARTIAL_SCHEMA))


def _whole(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"slice": F.lit(0), "root": F.lit(True)})


# --- windows of any size --------------------------------------------------


def wide_clustering(edge_rows: DataFrame) -> DataFrame:
    """Clustering by joins; pairs point to the end with more neighbours, so hubs do not fan out."""
    pair = undirected(edge_rows).filter("a <> b")
    ends = pair.select(GRAPH_KEY, F.explode(F.array("a", "b")).alias("node_id"))
    degree = ends.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("k"))
    da = degree.withColumnsRenamed({"node_id": "a", "k": "ka"})
    db = degree.withColumnsRenamed({"node_id": "b", "k": "kb"})
    low_first = F.struct("ka", "a") < F.struct("kb", "b")
    directed = durable(pair.join(da, [GRAPH_KEY, "a"]).join(db, [GRAPH_KEY, "b"]).select(
        GRAPH_KEY,
        F.when(low_first, F.col("a")).otherwise(F.col("b")).alias("tail"),
        F.when(low_first, F.col("b")).otherwise(F.col("a")).alias("head")))
    left = directed.withColumnRenamed("head", "x")
    right = directed.withColumnRenamed("head", "y")
    wedges = left.join(right, [GRAPH_KEY, "tail"]).filter("x < y")
    closing = directed.select(
        GRAPH_KEY, F.least("tail", "head").alias("x"), F.greatest("tail", "head").alias("y"))
    corners = wedges.join(closing, [GRAPH_KEY, "x", "y"]).select(
        GRAPH_KEY, F.explode(F.array("tail", "x", "y")).alias("node_id"))
    triangles = corners.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("t"))
    return degree.join(triangles, _NODE, "left").select(
        *_NODE,
        F.when(F.col("k") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1)))
        .otherwise(0.0).alias("cluster_coeff"))


def wide_pagerank(
    node_rows: DataFrame, edge_rows: DataFrame,
    damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, check_every: int = 2,
) -> DataFrame:
    """PageRank of all windows together by repeated joins; finished windows are left alone.

    Nodes without incoming links have one common rank in their window, so one row
    stands for them all, and rounds go over the other nodes and their links only.
    """
    links = edge_rows.select(GRAPH_KEY, "source", "target")
    out = links.groupBy(GRAPH_KEY, F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("out"))
    fed = links.select(GRAPH_KEY, F.col("target").alias("node_id"), F.lit(True).alias("fed")).distinct()
    nodes = durable(node_rows.select(*_NODE).join(out, _NODE, "left").join(fed, _NODE, "left").select(
        *_NODE, "out", F.coalesce("fed", F.lit(False)).alias("fed")))
    counts = nodes.groupBy(GRAPH_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("fed")).alias("times"),
        F.count_if(~F.col("fed") & F.col("out").isNull()).alias("ends"))
    own, unfed = F.concat(F.lit("n"), F.col("node_id")), F.lit("unfed")
    once = F.lit(1).cast("bigint")
    state = durable(
        nodes.filter("fed").join(counts.select(GRAPH_KEY, "n"), GRAPH_KEY).select(
            GRAPH_KEY, own.alias("key"), "n", once.alias("times"),
            F.col("out").isNull().cast("bigint").alias("ends"))
        .unionByName(counts.select(GRAPH_KEY, unfed.alias("key"), "n", "times", "ends"))
        .withColumns({"rank": F.lit(None).cast("double"), "fresh": 1.0 / F.col("n"), "active": F.lit(True)}))
    sources = nodes.filter("out IS NOT NULL").select(
        GRAPH_KEY, F.col("node_id").alias("source"),
        F.when(F.col("fed"), own).otherwise(unfed).alias("from"), (1.0 / F.col("out")).alias("part"))
    links = durable(links.join(sources, [GRAPH_KEY, "source"]).groupBy(
        GRAPH_KEY, "from", F.concat(F.lit("n"), F.col("target")).alias("key")).agg(F.sum("part").alias("part")))
    for turn in range(rounds + 1):
        sums = state.groupBy(GRAPH_KEY).agg(
            F.sum(F.col("times") * F.abs(F.col("fresh") - F.col("rank"))).alias("change"),
            F.sum(F.col("fresh") * F.col("ends")).alias("loose"))
        moves = F.col("active") & F.coalesce(F.col("change") >= F.col("n") * tolerance, F.lit(True))
        if turn and (turn % check_every == 0 or turn == rounds) and state.join(sums, GRAPH_KEY).filter(moves).isEmpty():
            common = state.filter(F.col("key") == unfed).select(GRAPH_KEY, F.col("fresh").alias("pagerank"))
            alone = state.select(GRAPH_KEY, "key", F.col("fresh").alias("pagerank"))
            return nodes.filter("NOT fed").join(common, GRAPH_KEY).select(*_NODE, "pagerank").unionByName(
                nodes.filter("fed").withColumn("key", own).join(alone, [GRAPH_KEY, "key"]).select(*_NODE, "pagerank"))
        share = state.filter("active").select(GRAPH_KEY, F.col("key").alias("from"), "fresh")
        spread = links.join(share, [GRAPH_KEY, "from"]).groupBy(GRAPH_KEY, "key").agg(
            F.sum(F.col("fresh") * F.col("part")).alias("spread"))
        moved = damping * (F.coalesce("spread", F.lit(0.0)) + F.col("loose") / F.col("n")) + (1 - damping) / F.col("n")
        state = durable(
            state.join(spread, [GRAPH_KEY, "key"], "left").join(sums, GRAPH_KEY).withColumn("active", moves).select(
                GRAPH_KEY, "key", "n", "times", "ends", F.col("fresh").alias("rank"),
                F.when(F.col("active"), moved).otherwise(F.col("fresh")).alias("fresh"), "active"))
    raise ArithmeticError(f"PageRank has not converged after {rounds} rounds")


def _twins(sides: DataFrame) -> DataFrame:
    """(window, node_id, first): nodes of ``sides`` (window, node_id, other) with all the others of an earlier node.

    Equal sums of hashes only suggest a pair; it counts if every other of the node
    is one of the first node's, of which there are as many.
    """
    marked = sides.groupBy(*_NODE).agg(
        F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("other")).alias("a"),
        F.bit_xor(F.xxhash64(F.lit("b"), "other")).alias("b"))
    pairs = marked.withColumn("first", F.min("node_id").over(
        Window.partitionBy(GRAPH_KEY, "k", "a", "b"))).filter("first <> node_id")
    own = sides.withColumnRenamed("node_id", "first")
    shared = sides.join(pairs, _NODE).join(own, [GRAPH_KEY, "first", "other"])
    return shared.groupBy(*_NODE, "first", "k").agg(F.count(F.lit(1)).alias("n")).filter("n = k").select(*_NODE, "first")


class _Reduced:
    """Tables of the graph without what cannot lie on a path between others (as ``kernels.Reduced``).

    ``links`` (source, target, weight and leaves of the target; broadcast if they are few),
    ``roots`` (node_id, times, tails, word, bit), ``leaf`` (node_id, of), ``sinks`` (node_id, first).
    """

    def __init__(self, edge_rows: DataFrame):
        links = durable(edge_rows.select(GRAPH_KEY, "source", "target").filter("source <> target"))
        out = links.groupBy(GRAPH_KEY, "source").agg(F.count(F.lit(1)).alias("out"))
        into = links.groupBy(GRAPH_KEY, "target").agg(F.count(F.lit(1)).alias("into"))
        of_target = out.withColumnsRenamed({"source": "target", "out": "target_out"})
        of_source = into.withColumnsRenamed({"target": "source", "into": "source_into"})
        tagged = durable(
            links.join(out, [GRAPH_KEY, "source"]).join(into, [GRAPH_KEY, "target"])
            .join(of_target, [GRAPH_KEY, "target"], "left").join(of_source, [GRAPH_KEY, "source"], "left")
            .select(
                GRAPH_KEY, "source", "target",
                (F.col("target_out").isNull() & (F.col("into") == 1)).alias("leaf"),
                (F.col("source_into").isNull() & (F.col("out") == 1)).alias("tail"),
                (F.col("target_out").isNull() & (F.col("into") > 1)).alias("sink"),
                (F.col("source_into").isNull() & (F.col("out") > 1)).alias("start")))
        source, target = F.col("source").alias("node_id"), F.col("target").alias("node_id")
        self.leaf = tagged.filter("leaf").select(GRAPH_KEY, target, F.col("source").alias("of"))
        leaves = self.leaf.groupBy(GRAPH_KEY, F.col("of").alias("node_id")).agg(F.count(F.lit(1)).alias("leaves"))
        tails = tagged.filter("tail AND NOT leaf").groupBy(GRAPH_KEY, target).agg(F.count(F.lit(1)).alias("tails"))
        self.sinks = durable(_twins(tagged.filter("sink").select(GRAPH_KEY, target, F.col("source").alias("other"))))
        starts = durable(_twins(tagged.filter("start").select(GRAPH_KEY, source, F.col("target").alias("other"))))

        def weights(twins: DataFrame, name: str) -> DataFrame:
            return twins.groupBy(GRAPH_KEY, F.col("first").alias("node_id")).agg((F.count(F.lit(1)) + 1).alias(name))

        sink_weight = weights(self.sinks, "weight").join(leaves, _NODE, "full").withColumnRenamed("node_id", "target")
        self.links = durable(
            tagged.filter("NOT leaf AND NOT tail").select(GRAPH_KEY, "source", "target")
            .join(self.sinks.select(GRAPH_KEY, F.col("node_id").alias("target")), [GRAPH_KEY, "target"], "left_anti")
            .join(starts.select(GRAPH_KEY, F.col("node_id").alias("source")), [GRAPH_KEY, "source"], "left_anti")
            .join(sink_weight, [GRAPH_KEY, "target"], "left").select(
                GRAPH_KEY, "source", "target", F.coalesce("weight", F.lit(1)).alias("weight"),
                F.coalesce("leaves", F.lit(0)).alias("leaves")))
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        rooted = (
            self.links.select(GRAPH_KEY, source).union(leaves.select(*_NODE)).union(tails.select(*_NODE)).distinct()
            .join(weights(starts, "times"), _NODE, "left").join(tails, _NODE, "left").join(leaves, _NODE, "left")
            .select(*_NODE, F.coalesce("times", one).alias("times"), F.coalesce("tails", none).alias("tails"),
                    F.coalesce("leaves", none).alias("own_leaves")))
        # 64 roots of like weights share a word; a word belongs to one task's run of ids
        serial = durable(rooted.repartitionByRange(GRAPH_KEY, "times", "tails", "node_id").sortWithinPartitions(
            GRAPH_KEY, "times", "tails").withColumn("serial", F.monotonically_increasing_id()))
        self.roots = serial.withColumns({
            "word": F.shiftright("serial", 6), "bit": F.col("serial").bitwiseAND(63).cast("int")}).drop("serial")
        self.near = self.links.count() <= NEAR_LINKS

    def steps(self, *columns: Column | str) -> DataFrame:
        """Columns of the links, to be joined with rows at their ends."""
        links = self.links.select(GRAPH_KEY, *columns)
        return F.broadcast(links) if self.near else links


_WORD = [GRAPH_KEY, "word", "times", "tails"]


def _bit() -> Column:
    """The root's place in the masks of its word."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))


def reach_masks(small: _Reduced) -> list[DataFrame]:
    """Level by level, which roots of a word first reach a node: (window, word, weights, node_id, mask).

    64 roots travel as one row; the masks of a node are merged by OR.
    """
    links = small.steps("source", F.col("target").alias("node_id"))
    none = F.lit(0).cast("bigint")

    def next_level(level: DataFrame, seen: DataFrame) -> DataFrame:
        found = level.select(*_WORD, F.col("node_id").alias("source"), "mask").join(links, [GRAPH_KEY, "source"]).select(
            *_WORD, "node_id", none.alias("seen"), "mask")
        merged = found.unionByName(seen).groupBy(*_WORD, "node_id").agg(
            F.bit_or("seen").alias("seen"), F.bit_or("mask").alias("mask"))
        return durable(merged.withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.col("seen")))))

    roots = small.roots.select(*_WORD, "node_id", _bit().alias("mask")).groupBy(*_WORD, "node_id").agg(
        F.bit_or("mask").alias("mask"))
    state = next_level(roots, roots.select(*_WORD, "node_id", F.col("mask").alias("seen"), none.alias("mask")))
    levels = []
    while True:
        level = state.filter("mask <> 0").select(*_WORD, "node_id", "mask")
        if level.isEmpty():
            return levels
        levels.append(level)
        state = next_level(level, state.select(
            *_WORD, "node_id", F.col("seen").bitwiseOR(F.col("mask")).alias("seen"), none.alias("mask")))


def _distances(small: _Reduced, levels: list[DataFrame]) -> DataFrame:
    """(window, node_id, reached, distance) of every node that something reaches."""
    times, tails = F.col("times"), F.col("tails")
    rows = [small.roots.filter("tails > 0").select(*_NODE, tails.alias("reached"), tails.alias("distance"))]
    for depth, level in enumerate(levels, 1):
        n = F.bit_count("mask").cast("bigint")
        rows.append(level.select(
            *_NODE, (n * (times + tails)).alias("reached"), (n * (times * depth + tails * (depth + 1))).alias("distance")))
    core = durable(functools.reduce(DataFrame.unionByName, rows).groupBy(*_NODE).agg(
        F.sum("reached").alias("reached"), F.sum("distance").alias("distance")))
    none = F.lit(0).cast("bigint")
    at_leaf = small.leaf.join(core.withColumnRenamed("node_id", "of"), [GRAPH_KEY, "of"], "left").select(
        *_NODE, (F.coalesce("reached", none) + 1).alias("reached"),
        (F.coalesce("distance", none) + F.coalesce("reached", none) + 1).alias("distance"))
    at_twin = small.sinks.join(core.withColumnRenamed("node_id", "first"), [GRAPH_KEY, "first"]).select(
        *_NODE, "reached", "distance")
    return core.unionByName(at_leaf).unionByName(at_twin)


#: Roots of a word, each with its place in the arrays of the word's rows.
_LANES = range(64)


def _lane_sums(column: str, name: str) -> Column:
    """Arrays of a group summed place by place."""
    return F.array(*[F.sum(F.get(F.col(column), F.lit(i))) for i in _LANES]).alias(name)


def _dependencies(small: _Reduced, levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """(window, node_id, dependency) summed over ``roots``; the masks tell which steps are shortest ones.

    Like the masks, path counts and credits of a word's 64 roots travel as one row.
    """
    links = small.steps("source", F.col("target").alias("node_id"), "weight", "leaves")
    none = F.lit(0.0)

    def reached(mask: Column, at: Column) -> Column:
        return F.call_function("shiftright", mask, at).bitwiseAND(F.lit(1).cast("bigint")) == 1

    lanes = F.array(*[F.lit(i) for i in _LANES])
    step = roots.select(*_WORD, "bit", F.col("node_id").alias("source")).join(links, [GRAPH_KEY, "source"])
    first = step.groupBy(*_WORD, "node_id", "weight", "leaves").agg(F.bit_or(_bit()).alias("mask"))
    fronts = [durable(first.select(
        *_WORD, "node_id", "weight", "leaves",
        F.transform(lanes, lambda i: reached(F.col("mask"), i).cast("double")).alias("paths")))]
    for level in levels[1:]:
        step = fronts[-1].select(*_WORD, F.col("node_id").alias("source"), "paths").join(links, [GRAPH_KEY, "source"])
        found = step.groupBy(*_WORD, "node_id", "weight", "leaves").agg(_lane_sums("paths", "paths"))
        fronts.append(durable(found.join(level, [*_WORD, "node_id"]).select(
            *_WORD, "node_id", "weight", "leaves", F.transform("paths", lambda p, i: F.when(
                reached(F.col("mask"), i), p).otherwise(none)).alias("paths"))))

    def credit(per_path: Column | None) -> Column:
        own = F.col("leaves").cast("double")
        if per_path is None:
            return F.transform("paths", lambda p: F.when(p > 0, own).otherwise(none))
        return F.zip_with("paths", per_path, lambda p, c: F.when(
            p > 0, own + p * F.coalesce(c, none)).otherwise(none))

    credited = [fronts[-1].withColumn("credit", credit(None))]
    for front in reversed(fronts[:-1]):
        below = credited[-1].select(*_WORD, "node_id", F.zip_with("paths", "credit", lambda p, c: F.when(
            p > 0, (F.col("weight") + c) / p).otherwise(none)).alias("per_path"))
        back = below.join(
            small.steps("source", F.col("target").alias("node_id")), [GRAPH_KEY, "node_id"]).groupBy(
            *_WORD, F.col("source").alias("node_id")).agg(_lane_sums("per_path", "per_path"))
        credited.append(durable(front.join(back, [*_WORD, "node_id"], "left").withColumn(
            "credit", credit(F.coalesce("per_path", F.array()))).drop("per_path")))
    rows = functools.reduce(DataFrame.unionByName, credited)
    inner = rows.select(*_NODE, (F.aggregate("credit", none, lambda a, x: a + x) * (
        F.col("times") + F.col("tails"))).alias("dependency"))
    reach = rows.filter("tails > 0").withColumn("beyond", F.transform("paths", lambda p: F.when(
        p > 0, (F.col("weight") + F.col("leaves")).cast("double")).otherwise(none)))
    beyond = reach.groupBy(*_WORD).agg(_lane_sums("beyond", "beyond"))
    own = roots.filter("tails > 0").join(beyond, _WORD, "left").select(
        *_NODE, (F.col("tails") * (F.coalesce(F.get("beyond", F.col("bit")), none) + F.col("own_leaves"))).alias("dependency"))
    return inner.unionByName(own).groupBy(*_NODE).agg(F.sum("dependency").alias("dependency"))


def wide_path_sums(
    edge_rows: DataFrame, block_rows: int, measures: frozenset[str] = frozenset(_BY_PATHS),
) -> DataFrame:
    """Dependencies, reach counts and distance sums of nodes by joins; nodes without any may be missing.

    The graph is reduced first. One search carries 64 roots in a row; it gives
    reach and distances, and for betweenness it tells where to count paths, which
    is done for a block of words at a time, of about ``block_rows`` pairs of root and node.
    """
    small = _Reduced(edge_rows)
    levels = reach_masks(small)
    out = _distances(small, levels)
    if "betweenness" in measures:
        cells = functools.reduce(DataFrame.unionByName, levels).agg(
            F.sum(F.bit_count("mask").cast("bigint"))).first()[0] if levels else 0
        blocks, done = max(1, -int(-cells // block_rows)), None
        for block in range(blocks):
            chosen = small.roots.filter(F.pmod(F.xxhash64("word"), F.lit(blocks)) == block)
            part = durable(_dependencies(small, levels, chosen))
            done = part if done is None else durable(done.unionByName(part).groupBy(*_NODE).agg(
                F.sum("dependency").alias("dependency")))
        out = out.join(done, _NODE, "full")
    else:
        out = out.withColumn("dependency", F.lit(0.0))
    return _sums(out.select(
        *_NODE, F.coalesce("dependency", F.lit(0.0)).alias("dependency"),
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("reached", "distance")]))


def _sums(path_rows: DataFrame) -> DataFrame:
    """Path sums as partial measures."""
    return path_rows.select(
        *_NODE, F.lit(0).cast("bigint").alias("n"), "dependency", "reached", "distance",
        F.lit(0.0).alias("pagerank"), F.lit(0.0).alias("cluster_coeff"))


def _paths(
    pairs: DataFrame, core_pairs: int, task_work: int, block_rows: int, measures: frozenset[str],
) -> DataFrame:
    """Partial path sums of windows that are more than one task's work.

    A start, a node that nothing reaches, is on no path between others. So a task
    can have its share of the starts and the core, the links of all other nodes.
    Links from starts to nodes outside the core are whole paths, and only counted.
    """
    links = pairs.filter("subject <> object").select(GRAPH_KEY, "subject", "object")
    fed = links.select(GRAPH_KEY, F.col("object").alias("subject"), F.lit(True).alias("fed")).distinct()
    tagged = durable(links.join(fed, [GRAPH_KEY, "subject"], "left").withColumn("fed", F.col("fed").isNotNull()))
    core = tagged.filter("fed")
    ends = core.select(GRAPH_KEY, F.explode(F.array("subject", "object")).alias("object")).distinct()
    starts = durable(tagged.filter("NOT fed").join(
        ends.withColumn("inner", F.lit(True)), [GRAPH_KEY, "object"], "left").select(
        GRAPH_KEY, "subject", "object", F.col("inner").isNotNull().alias("inner")))
    outer = starts.filter("NOT inner").groupBy(GRAPH_KEY, F.col("object").alias("node_id")).agg(
        F.count(F.lit(1)).alias("reached"))
    partial = _sums(outer.withColumns({"dependency": F.lit(0.0), "distance": F.col("reached")}))

    starts = starts.filter("inner").drop("inner")
    n_core = core.groupBy(GRAPH_KEY).agg(F.count(F.lit(1)).alias("n_core"))
    n_starts = starts.groupBy(GRAPH_KEY).agg(F.count(F.lit(1)).alias("n_starts"))
    work = (F.col("n_core") + F.col("n_starts")) * F.col("n_core")
    sizes = durable(n_core.join(n_starts, GRAPH_KEY, "left").fillna(0, ["n_starts"]).select(
        GRAPH_KEY, "n_core", F.greatest(
            F.ceil(work / F.lit(task_work)), F.ceil(F.col("n_starts") / F.lit(max(core_pairs, 1))),
            F.lit(1)).cast("int").alias("slices")))
    fits, beyond = (sizes.filter(F.col("n_core") <= core_pairs), sizes.filter(F.col("n_core") > core_pairs))
    if not fits.isEmpty():
        turn = F.pmod(F.xxhash64("subject"), F.col("slices")).cast("int")
        spread = core.join(fits, GRAPH_KEY).withColumn(
            "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("root", F.col("slice") == turn)
        dealt = starts.join(fits, GRAPH_KEY).withColumns({"slice": turn, "root": F.lit(True)})
        columns = [GRAPH_KEY, "subject", "object", "slice", "root"]
        # A part knows only its own nodes; how many the window has comes with the other measures.
        partial = partial.unionByName(_in_tasks(
            spread.select(*columns).unionByName(dealt.select(*columns)), measures & _BY_PATHS
        ).withColumn("n", F.lit(0).cast("bigint")))
    if not beyond.isEmpty():
        kept = core.select(GRAPH_KEY, "subject", "object").unionByName(starts).join(
            beyond.select(GRAPH_KEY), GRAPH_KEY, "left_semi")
        partial = partial.unionByName(wide_path_sums(
            kept.withColumnsRenamed({"subject": "source", "object": "target"}), block_rows, measures))
    return partial


def _by_joins(pairs: DataFrame, measures: frozenset[str]) -> DataFrame:
    """All nodes with those of the measures that are not sums over paths."""
    edge_rows = pairs.filter("object IS NOT NULL").select(
        GRAPH_KEY, F.col("subject").alias("source"), F.col("object").alias("target"))
    node_rows = durable(pairs.select(
        GRAPH_KEY, F.explode(F.array("subject", "object")).alias("node_id"),
    ).filter("node_id IS NOT NULL").distinct())
    counts = node_rows.groupBy(GRAPH_KEY).agg(F.count(F.lit(1)).alias("n"))
    out = node_rows.join(counts, GRAPH_KEY).withColumns({
        "dependency": F.lit(0.0), "reached": F.lit(0).cast("bigint"), "distance": F.lit(0).cast("bigint")})
    if "pagerank" in measures:
        out = out.join(wide_pagerank(node_rows, edge_rows), _NODE)
    else:
        out = out.withColumn("pagerank", F.lit(0.0))
    if "cluster_coeff" in measures:
        out = out.join(wide_clustering(edge_rows), _NODE, "left").fillna(0.0, ["cluster_coeff"])
    else:
        out = out.withColumn("cluster_coeff", F.lit(0.0))
    return (
        out.select(*_NODE, "n", "dependency", "reached", "distance", "pagerank", "cluster_coeff"))


# --- entry point ----------------------------------------------------------


def centrality(
    pairs: DataFrame, task_pairs: int = TASK_PAIRS, task_work: int = TASK_WORK,
    block_rows: int = 2_000_000_000, measures: Sequence[str] = MEASURES, core_pairs: int = TASK_PAIRS,
) -> DataFrame:
    """The chosen ``measures`` for every node of every window in ``pairs``.

    ``pairs`` is read more than once, so pass a materialised table. Closeness
    uses incoming distances scaled by the reachable share; betweenness is
    directed and normalised, without end points. ``task_pairs`` bounds the windows that
    a task may hold, ``core_pairs`` the cores of those cut by source nodes.
    """
    wanted = frozenset(measures)
    if not wanted <= set(MEASURES):
        raise ValueError(f"unknown measures: {sorted(wanted - set(MEASURES))}")
    sizes = window_sizes(pairs)
    # A window of p pairs has at most 2p nodes, hence the work bound 2·p·p.
    p = F.col("n_pairs")
    small, middle = (2 * p * p <= task_work) & (p <= task_pairs), (2 * p * p > task_work) & (p <= task_pairs)
    n_small, n_middle, n_large = sizes.agg(
        F.count_if(small), F.count_if(middle), F.count_if(p > task_pairs)).first()
    if not n_middle and not n_large:
        partial = _in_tasks(_whole(pairs), wanted)
    else:
        sized = durable(pairs.select(GRAPH_KEY, "subject", "object").join(sizes, GRAPH_KEY))
        others = wanted - _BY_PATHS
        parts = [_in_tasks(_whole(sized.filter(small)), wanted)] if n_small else []
        if n_middle:
            parts.append(_in_tasks(_whole(sized.filter(middle)), others))
        if n_large:
            parts.append(_by_joins(sized.filter(p > task_pairs), others))
        if wanted & _BY_PATHS:
            parts.append(_paths(sized.filter(~small), core_pairs, task_work, block_rows, wanted))
        partial = functools.reduce(DataFrame.unionByName, parts)
    n, r = F.col("n"), F.col("reached")
    return partial.groupBy(*_NODE).agg(
        F.max("n").alias("n"), F.sum("dependency").alias("dependency"),
        F.sum("reached").alias("reached"), F.sum("distance").alias("distance"),
        F.max("pagerank").alias("pagerank"), F.max("cluster_coeff").alias("cluster_coeff"),
    ).select(
        *_NODE,
        F.when(F.col("distance") > 0, r / F.col("distance") * r / (n - 1))
        .otherwise(0.0).alias("closeness"),
        F.when(n > 2, F.col("dependency") / ((n - 1) * (n - 2)))
        .otherwise(F.lit(0.0)).alias("betweenness"),
        "pagerank", "cluster_coeff").select(*_NODE, *[m for m in MEASURES if m in wanted])
