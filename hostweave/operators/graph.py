"""One directed graph per window, as tables keyed by ``window_start``.

``interactions`` has one row per (window, subject, object) pair and is the only
step that shuffles the events; nodes, edges and most features derive from it.
All of its aggregates are fixed-width numbers, so the partial aggregation
before the shuffle is a hash aggregation. Input order is carried by
``ordinal``, which must be unique per event.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hostweave.functions.ordered import position_in_order
from hostweave.functions.timefn import seconds_of_day
from hostweave.operators.sliding import sliding
from hostweave.schemas import GRAPH_EVENT_TYPES

GRAPH_KEY = "window_start"
MOST_CODES = 64  # event types that travel as codes


def type_code(column: str, vocabulary: Sequence[str]) -> Column:
    """Position of an event type in the vocabulary; an unknown type is an error."""
    if len(vocabulary) > MOST_CODES:
        raise ValueError(f"a vocabulary has at most {MOST_CODES} event types")
    names = F.array(*[F.lit(v) for v in vocabulary])
    code = F.array_position(names, F.col(column)) - 1
    return F.when(code >= 0, code).otherwise(
        F.raise_error(F.concat(F.lit("event type outside the vocabulary: "), F.col(column))))


def interactions(
    events: DataFrame, vocabulary: Sequence[str] | None = GRAPH_EVENT_TYPES,
    key: str = GRAPH_KEY,
) -> DataFrame:
    """Pairs of each window with the last event type and time between them.

    The last row in input order decides ``event`` and ``ts``. Subjects without
    an object keep a row with a null object. ``vocabulary=None`` accepts any
    event type, at the price of a sort-based partial aggregation. ``key`` names
    the window column; on a stream it is the watermarked window itself.
    """
    prepared = events
    if vocabulary is None:
        last_event = F.max_by("type", "ordinal").alias("event")
    else:
        prepared = events.withColumn("__code", type_code("type", vocabulary))
        last_event = F.max_by("__code", "ordinal").alias("event_code")
    pairs = prepared.groupBy(key, "subject", "object").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("ordinal").alias("first_ordinal"),
        F.max("ordinal").alias("last_ordinal"),
        last_event,
        F.max_by("ts", "ordinal").alias("ts"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"))
    return pairs if vocabulary is None else _with_event_name(pairs, vocabulary)


def _with_event_name(pairs: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(v) for v in vocabulary])
    return pairs.withColumn("event", F.get(names, F.col("event_code").cast("int")))


def overlapping_interactions(
    panes: DataFrame, seconds: int, step_seconds: int = 1,
    vocabulary: Sequence[str] = GRAPH_EVENT_TYPES,
) -> DataFrame:
    """Pairs of the overlapping windows that start at every non-empty bin.

    ``panes`` are the pairs of the bins themselves; ``sliding`` merges them, so
    neither events nor pairs are copied to all the windows that cover them.
    ``seconds`` must be a multiple of ``step_seconds``.
    """
    kind = "event_code" if "event_code" in panes.columns else "event"
    merged = sliding(
        panes.withColumn("__last", F.struct("last_ordinal", kind, "ts")), ["subject", "object"],
        {"n_events": "sum", "first_ordinal": "min", "first_ts": "min", "last_ts": "max", "__last": "max"},
        seconds, step_seconds, GRAPH_KEY).select("*", "__last.*").drop("__last")
    return _with_event_name(merged, vocabulary) if kind == "event_code" else merged


def edges(pairs: DataFrame) -> DataFrame:
    """One edge per (window, subject, object)."""
    return pairs.filter(F.col("object").isNotNull()).select(
        GRAPH_KEY, F.col("subject").alias("source"), F.col("object").alias("target"),
        *[c for c in ("event", "event_code") if c in pairs.columns],
        "ts", "n_events", "first_ts", "last_ts", "first_ordinal")


def nodes(pairs: DataFrame) -> DataFrame:
    """Nodes with their role, degrees and the features of their out-edges' times.

    A mention as subject sits at position 2·ordinal and as object at
    2·ordinal+1, so the parity of the last position is the role. Degrees and
    time statistics come out of the same aggregation, because each pair is one
    out-edge of its subject and one in-edge of its object.
    """
    coded = "event_code" in pairs.columns
    kind = "event_code" if coded else "event"
    has_object = F.col("object").isNotNull()
    as_subject = F.struct(
        F.col("subject").alias("node_id"),
        (F.col("first_ordinal") * 2).alias("first_pos"),
        (F.col("last_ordinal") * 2).alias("last_pos"),
        has_object.cast("int").alias("is_out"),
        F.lit(0).alias("is_in"),
        F.when(has_object, F.col("ts")).alias("out_ts"),
        F.when(has_object, F.col(kind)).alias("out_type"))
    as_object = F.struct(
        F.col("object").alias("node_id"),
        (F.col("first_ordinal") * 2 + 1).alias("first_pos"),
        (F.col("last_ordinal") * 2 + 1).alias("last_pos"),
        F.lit(0).alias("is_out"),
        F.lit(1).alias("is_in"),
        F.lit(None).cast("timestamp_ntz").alias("out_ts"),
        F.lit(None).cast(pairs.schema[kind].dataType).alias("out_type"))
    mentions = pairs.select(
        GRAPH_KEY,
        F.explode(F.when(has_object, F.array(as_subject, as_object))
                  .otherwise(F.array(as_subject))).alias("m"),
    ).select(GRAPH_KEY, "m.*")
    offset = (F.col("out_ts") - F.col(GRAPH_KEY)).cast("decimal(18,6)").cast("double")
    # One bit per event type (a vocabulary has at most 64) counts types without a set.
    type_count = (
        F.bit_count(F.coalesce(F.bit_or(F.expr("shiftleft(1L, cast(out_type AS int))")),
                               F.lit(0).cast("bigint"))).cast("bigint")
        if coded else F.count_distinct("out_type"))
    return mentions.withColumn("__offset", offset).groupBy(GRAPH_KEY, "node_id").agg(
        F.min("first_pos").alias("first_pos"),
        F.max("last_pos").alias("last_pos"),
        F.sum("is_in").alias("in_degree"),
        F.sum("is_out").alias("out_degree"),
        type_count.alias("event_type_count"),
        F.var_pop("__offset").alias("__var"),
        F.min("out_ts").alias("first_out"),
        F.max("out_ts").alias("last_out"),
    ).select(
        GRAPH_KEY, "node_id",
        F.when(F.col("last_pos") % 2 == 0, "subject").otherwise("object").alias("node_type"),
        "first_pos", "in_degree", "out_degree", "event_type_count",
        F.when(F.col("out_degree") > 1, F.col("__var")).otherwise(0.0).alias("ts_var"),
        "first_out", "last_out")


def basic_features(node_rows: DataFrame) -> DataFrame:
    """Features that need no further shuffle once ``nodes`` exists."""
    out = F.col("out_degree")
    span = (F.col("last_out") - F.col("first_out")).cast("decimal(18,6)").cast("double")
    degree = F.col("in_degree") + out
    angle = 2 * F.pi() * seconds_of_day("first_out") / 86_400
    return node_rows.withColumns({
        "node_type_flag": (F.col("node_type") == "subject").cast("int"),
        "degree": degree,
        "event_count": degree,
        "activity_rate": degree,
        "avg_ts_gap": F.when(out > 1, span / (out - 1)).otherwise(0.0),
        "last_seen_delta": F.coalesce(span, F.lit(0.0)),
        "time_sin": F.coalesce(F.sin(angle), F.lit(0.0)),
        "time_cos": F.coalesce(F.cos(angle), F.lit(0.0))})


def with_node_index(node_rows: DataFrame, width: int = 131_072) -> DataFrame:
    """``node_idx`` per window in order of first mention.

    Positions are distinct within a window, so a slot of ``width`` positions
    holds at most that many nodes, however large the window is.
    """
    return position_in_order(
        node_rows, [GRAPH_KEY], "first_pos", "node_idx", width, ties=["node_id"])


def edge_index(edge_rows: DataFrame, indexed_nodes: DataFrame) -> DataFrame:
    """Edges as (source index, target index)."""
    index = indexed_nodes.select(GRAPH_KEY, "node_id", "node_idx")
    source = index.withColumnsRenamed({"node_id": "source", "node_idx": "source_idx"})
    target = index.withColumnsRenamed({"node_id": "target", "node_idx": "target_idx"})
    return edge_rows.join(source, [GRAPH_KEY, "source"]).join(target, [GRAPH_KEY, "target"])


def resolved_edges(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Edges with the node rows of both ends as structs."""
    ends = [c for c in node_rows.columns if c not in (GRAPH_KEY, "node_id")]
    def side(name: str) -> DataFrame:
        return node_rows.select(
            GRAPH_KEY, F.col("node_id").alias(name), F.struct(*ends).alias(f"{name}_node"))
    return edge_rows.join(side("source"), [GRAPH_KEY, "source"]).join(
        side("target"), [GRAPH_KEY, "target"])


def edge_index_or_placeholder(indexed_edges: DataFrame, windows: DataFrame) -> DataFrame:
    """Index pairs per window; a window without edges gets one pair (0, 0) without a type."""
    return windows.select(GRAPH_KEY).join(
        indexed_edges.select(GRAPH_KEY, "source_idx", "target_idx", "event"), GRAPH_KEY, "left",
    ).withColumns({
        "source_idx": F.coalesce("source_idx", F.lit(0)),
        "target_idx": F.coalesce("target_idx", F.lit(0))})


def undirected(edge_rows: DataFrame) -> DataFrame:
    """Distinct unordered pairs; self-loops stay as (a, a)."""
    return edge_rows.select(
        GRAPH_KEY, F.least("source", "target").alias("a"),
        F.greatest("source", "target").alias("b")).distinct()


def one_hot(edge_rows: DataFrame, vocabulary: Sequence[str] = GRAPH_EVENT_TYPES) -> DataFrame:
    """``event_vector`` over the vocabulary; an unknown type gives zeros."""
    return edge_rows.withColumn("event_vector", F.array(
        *[F.coalesce((F.col("event") == e).cast("double"), F.lit(0.0)) for e in vocabulary]))
