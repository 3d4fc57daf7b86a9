"""Time windows, their numbering and their labels."""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from hostweave.functions.ordered import latest_before, position_in_order
from hostweave.functions.timefn import floor_div, from_micros, to_micros
from hostweave.operators.sliding import sliding

_SECOND = 1_000_000


def in_range(ts: str, start, end) -> Column:
    """Half-open time range."""
    return (F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end))


def with_tumbling_window(events: DataFrame, seconds: int = 1) -> DataFrame:
    """Add ``window_start`` and ``window_end``; events without a time are in no window."""
    return events.withColumn("__w", F.window("ts", f"{seconds} seconds")).withColumns(
        {"window_start": F.col("__w.start"), "window_end": F.col("__w.end")}).drop("__w")


def tumbling_windows(events: DataFrame, seconds: int = 1) -> DataFrame:
    """Distinct non-empty windows with their event counts."""
    return events.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("n_events")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_events")


def window_starts(events: DataFrame, step_seconds: int = 1) -> DataFrame:
    return with_tumbling_window(events.select("ts"), step_seconds).select("window_start").distinct()


def with_overlapping_windows(
    events: DataFrame, seconds: int, step_seconds: int = 1
) -> DataFrame:
    """Windows of ``seconds`` anchored at every non-empty ``step_seconds`` bin.

    An event belongs to each window that starts in a non-empty bin at most
    ``seconds`` before it, and has a row for each. Aggregates per window need no
    such copies: see ``overlapping_statistics`` and ``graph.overlapping_interactions``.
    """
    micros = to_micros("ts")
    step, length = step_seconds * _SECOND, seconds * _SECOND
    bin_start = micros - F.pmod(micros, F.lit(step))
    steps_back = -(-length // step) - 1
    candidates = F.transform(
        F.sequence(F.lit(0), F.lit(steps_back)), lambda k: bin_start - k.cast("bigint") * F.lit(step))
    covering = F.filter(candidates, lambda s: micros < s + F.lit(length))
    spread = events.withColumn("__start", F.explode(covering)).withColumns({
        "window_start": from_micros("__start"),
        "window_end": from_micros(F.col("__start") + length)}).drop("__start")
    return spread.join(window_starts(events, step_seconds), "window_start", "left_semi")


def overlapping_statistics(events: DataFrame, seconds: int, step_seconds: int = 1) -> DataFrame:
    """Count, first and last input position per window of ``with_overlapping_windows``, without copies of events.

    ``seconds`` must be a multiple of ``step_seconds``.
    """
    panes = with_tumbling_window(events, step_seconds).groupBy("window_start").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ordinal").alias("first_ordinal"),
        F.max("ordinal").alias("last_ordinal"))
    merged = sliding(
        panes, [], {"n_events": "sum", "first_ordinal": "min", "last_ordinal": "max"}, seconds, step_seconds)
    return merged.withColumn("window_end", from_micros(to_micros("window_start") + seconds * _SECOND))


def with_anchored_window(events: DataFrame, seconds: int = 1) -> DataFrame:
    """Windows counted from the first event; the number has gaps where no event falls.

    The last window of the log is open to the right only up to the last event:
    an event that starts a new window exactly at the end of the log has none.
    """
    bounds = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    lo = to_micros(bounds.select("lo").scalar())
    hi = to_micros(bounds.select("hi").scalar())
    step = seconds * _SECOND
    offset = to_micros("ts") - lo
    number = floor_div(offset, step)
    return (
        events.withColumn("window_id", number)
        .filter(F.col("window_id") * step < hi - lo)
        .withColumns({
            "window_start": from_micros(lo + F.col("window_id") * step),
            "window_end": from_micros(lo + (F.col("window_id") + 1) * step)}))


def number_windows(starts: DataFrame, unit_seconds: int = 1) -> DataFrame:
    """Dense ``window_id`` from 0 in time order over distinct ``window_start`` rows."""
    timed = starts.withColumn("__us", to_micros("window_start"))
    return position_in_order(
        timed, [], "__us", "window_id", width=65_536 * unit_seconds * _SECOND).drop("__us")


def _overlaps(interval_start: Column, interval_end: Column) -> Column:
    return (F.col("window_start") <= interval_end) & (F.col("window_end") >= interval_start)


def label_windows(
    windows: DataFrame, attacks: Sequence[tuple[datetime, datetime]] | DataFrame = ()
) -> DataFrame:
    """``label`` 1 where the window touches an attack interval, both ends inclusive.

    ``attacks`` is a short list of intervals, or a table ``(start, end)`` of any
    size, which is matched by one ordered look-up per window.
    """
    if not isinstance(attacks, DataFrame):
        hit = F.lit(False)
        for start, end in attacks:
            hit = hit | _overlaps(F.lit(start), F.lit(end))
        return windows.withColumn("label", hit.cast("int"))

    # some interval that starts by the window's end lasts to its start or beyond exactly if
    # the latest end among those intervals does
    spans = windows.select("window_start", "window_end").distinct()
    none = F.lit(None).cast("timestamp_ntz")
    order = attacks.select(
        to_micros("start").alias("__us"), F.lit(0).alias("__kind"), to_micros("end").alias("__until"),
        none.alias("window_start"), none.alias("window_end")).unionByName(spans.select(
            to_micros("window_end").alias("__us"), F.lit(1).alias("__kind"),
            F.lit(None).cast("bigint").alias("__until"), "window_start", "window_end"))
    reached = latest_before(
        order, [], "__us", F.col("__until"), "__latest", width=3600 * _SECOND, ties=["__kind"])
    hits = reached.filter(
        (F.col("__kind") == 1) & (F.col("__latest") >= to_micros("window_start"))).select(
        "window_start", "window_end", F.lit(1).alias("label"))
    return windows.join(hits, ["window_start", "window_end"], "left").fillna(0, ["label"])


def window_statistics(nodes: DataFrame, windows: DataFrame) -> DataFrame:
    """Node and edge counts per labelled window.

    Every edge leaves exactly one node, so the edge count is the sum of out-degrees.
    """
    sizes = nodes.groupBy("window_start").agg(
        F.count(F.lit(1)).alias("num_nodes"), F.sum("out_degree").alias("num_edges"))
    return windows.join(sizes, "window_start")


