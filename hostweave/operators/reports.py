"""Exploration and pattern reports over events, subjects and network flows.

Each report aggregates first; whatever is ranked or compared afterwards is the
small aggregate. Every top-k has a second sort key, so ties are reproducible.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hostweave.functions.durable import durable
from hostweave.functions.ids import short_id
from hostweave.functions.ordered import latest_before
from hostweave.functions.timefn import floor_div, from_micros, to_micros
from hostweave.schemas import COMMON_PORTS



def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_events"))


def top(counts: DataFrame, k: int, name: str, size: str = "n_events") -> DataFrame:
    return counts.orderBy(F.desc(size), name).limit(k)


def share_of_total(counts: DataFrame, size: str, digits: int = 1) -> Column:
    """Percentage of the column total, as a scalar subquery on the aggregate.

    Both readings of ``counts`` share one shuffle when the plan is executed.
    """
    total = counts.select(F.sum(size)).scalar()
    return F.round(F.col(size) * 100.0 / total, digits)


# --- events ----------------------------------------------------------------


def type_distribution(events: DataFrame, k: int = 10) -> DataFrame:
    counts = count_by(events, "type")
    return top(counts.withColumn("share", share_of_total(counts, "n_events")), k, "type")


def time_range(events: DataFrame) -> DataFrame:
    return events.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).withColumn(
        "duration_s", (to_micros("last_ts") - to_micros("first_ts")) / 1_000_000.0)


def events_per_minute(events: DataFrame, seconds: int = 60) -> DataFrame:
    return events.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("minute"), "n_events")


def first_per_id(subjects: DataFrame) -> DataFrame:
    """First row of each id, by start time."""
    rest = [c for c in subjects.columns if c != "uuid"]
    return subjects.groupBy("uuid").agg(
        F.min_by(F.struct(*rest), F.struct("start_timestamp", "cid")).alias("r")).select(
        "uuid", "r.*")


def most_active_subjects(events: DataFrame, k: int = 10) -> DataFrame:
    return top(count_by(events.filter(F.col("subject").isNotNull()), "subject"), k, "subject")


def described_subjects(active: DataFrame, subjects: DataFrame) -> DataFrame:
    """Process number and type of each ranked subject, or its shortened id if unknown.

    ``active`` is a top-k table, so it is the side that is sent to the
    dimension: only matching dimension rows are grouped.
    """
    known = first_per_id(subjects.join(
        F.broadcast(active.select(F.col("subject").alias("uuid"))), "uuid", "left_semi"))
    text = F.concat(F.lit("PID "), F.col("cid"), F.lit(" ("), F.col("type"), F.lit(")"))
    return active.join(known, F.col("subject") == F.col("uuid"), "left").select(
        "subject", "n_events", F.coalesce(text, short_id("subject")).alias("description"))


def top_types_over_time(events: DataFrame, k: int = 5, seconds: int = 60) -> DataFrame:
    leading = top(count_by(events, "type"), k, "type").select("type")
    return (
        events.join(F.broadcast(leading), "type", "left_semi")
        .groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "type")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(F.col("w.start").alias("minute"), "type", "n_events"))


def global_summary(events: DataFrame, subjects: DataFrame, network: DataFrame) -> DataFrame:
    """One row of totals; each distinct count is its own aggregation."""
    def one(df: DataFrame, value: Column) -> Column:
        return df.select(value.alias("v")).scalar()
    span = time_range(events).select("duration_s")
    return events.sparkSession.range(1).select(
        one(events, F.count(F.lit(1))).alias("total_events"),
        one(events, F.count_distinct("type")).alias("event_types"),
        one(subjects, F.count(F.lit(1))).alias("total_processes"),
        one(events, F.count_distinct("subject")).alias("subjects_in_events"),
        one(events, F.count_distinct("object")).alias("objects_in_events"),
        one(network, F.count(F.lit(1))).alias("network_connections"),
        span.scalar().alias("time_span_s"))


def distinct_sketches(rows: DataFrame, columns: Sequence[str], by: Column, lg_size: int = 12) -> DataFrame:
    """Per value of ``by`` (a minute, a port): its rows, and for each column a sketch of its distinct values.

    Sketches are at most 2 ** ``lg_size`` bytes, so a stored table of them answers for
    any set of its rows what the distinct counts are, without the rows it came from.
    Nulls are not counted.
    """
    return rows.groupBy(by.alias("slice")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.hll_sketch_agg(c, lg_size).alias(f"{c}_sketch") for c in columns])


def sketched_counts(sketches: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows and estimated distinct values of the columns over all given sketches, per value of ``by``.

    The standard error of a count is ``sketch_error`` of it; filter ``sketches`` for
    a range. Without any sketch all counts are 0.
    """
    return sketches.groupBy(*by).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")), F.lit(0)).alias(c) for c in columns])


def sketch_error(lg_size: int = 12) -> float:
    """Relative standard error of a distinct count from merged sketches."""
    return 1.04 / 2 ** (lg_size / 2)


def activity(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Counts and first times per (minute, type): the one pass that several reports share."""
    return events.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "type").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts")).select(
        F.col("w.start").alias("minute"), "type", "n_events", "first_ts")


def _bursts(minutes: DataFrame, factor: float) -> DataFrame:
    mean = minutes.select(F.avg("n_events")).scalar()
    return minutes.withColumn("ratio", F.col("n_events") / mean).filter(
        F.col("n_events") > F.lit(factor) * mean)


def burst_minutes(events: DataFrame, factor: float = 2.0, seconds: int = 60) -> DataFrame:
    """Minutes with more than ``factor`` times the mean of the non-empty minutes."""
    return _bursts(events_per_minute(events, seconds), factor)


def rare_types(events: DataFrame, below: float = 10) -> DataFrame:
    return events.groupBy("type").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts")).filter(
        F.col("n_events") < below)


def _activity_parts(
    events: DataFrame, seconds: int, rare_below: float
) -> tuple[DataFrame, DataFrame]:
    """(bursts, rare types) from one scan of the events."""
    cells = durable(activity(events, seconds))
    minutes = cells.groupBy("minute").agg(F.sum("n_events").alias("n_events"))
    types = cells.groupBy("type").agg(
        F.sum("n_events").alias("n_events"), F.min("first_ts").alias("first_ts"))
    return _bursts(minutes, 2.0), types.filter(F.col("n_events") < rare_below)


def long_gaps(events: DataFrame, seconds: int = 60, k: int | None = 5) -> DataFrame:
    """Silences longer than ``seconds``, longest first.

    Events are merged to one row per bin of that width before any ordering: a
    longer silence cannot start and end in one bin. Bins are then compared in
    time order slot by slot.
    """
    width = seconds * 1_000_000
    merged = events.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    bins = durable(merged.select(
        floor_div(to_micros("w.start"), width).alias("bin"),
        to_micros("first_ts").alias("first_us"), to_micros("last_ts").alias("last_us")))
    gaps = latest_before(
        bins, [], "bin", F.col("last_us"), "before_us", width=65_536,
    ).filter(F.col("first_us") - F.col("before_us") > width).select(
        from_micros("before_us").alias("gap_start"), from_micros("first_us").alias("gap_end"),
        ((F.col("first_us") - F.col("before_us")) / 1_000_000.0).alias("gap_s"))
    return gaps if k is None else gaps.orderBy(F.desc("gap_s"), "gap_start").limit(k)


# --- subjects --------------------------------------------------------------


def parent_coverage(subjects: DataFrame) -> DataFrame:
    return subjects.agg(
        F.count("parent_subject").alias("with_parent"), F.count(F.lit(1)).alias("total"))


def top_parents(subjects: DataFrame, k: int = 5) -> DataFrame:
    """Parents by number of children; a parent without a row is dropped after the cut."""
    counts = subjects.filter(F.col("parent_subject").isNotNull()).groupBy(
        "parent_subject").agg(F.count(F.lit(1)).alias("n_children"))
    leading = top(counts, k, "parent_subject", "n_children")
    rows = first_per_id(subjects.join(
        F.broadcast(leading.select(F.col("parent_subject").alias("uuid"))), "uuid", "left_semi"))
    return leading.join(rows.select("uuid", "cid"), F.col("parent_subject") == F.col("uuid")).select(
        F.col("parent_subject").alias("parent"), "cid", "n_children")


# --- network ---------------------------------------------------------------


def address_counts(network: DataFrame) -> DataFrame:
    spark = network.sparkSession
    def distinct(name: str) -> Column:
        return network.select(F.count_distinct(name)).scalar().alias(f"{name}es")
    return spark.range(1).select(distinct("local_address"), distinct("remote_address"))


def top_remotes(network: DataFrame, column: str, k: int = 10, at_least: int = 1) -> DataFrame:
    """Most frequent non-null values of ``remote_address`` or ``remote_port``."""
    counts = network.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("n_flows")).filter(F.col("n_flows") >= at_least)
    return top(counts, k, column, "n_flows")


def unusual_port_flows(network: DataFrame, common: Sequence[int] = COMMON_PORTS) -> DataFrame:
    """Flows not on a common port; a flow without a port counts as unusual."""
    return network.filter(~F.coalesce(F.col("remote_port").isin(list(common)), F.lit(False)))


def unusual_ports(network: DataFrame, common: Sequence[int] = COMMON_PORTS, k: int = 10) -> DataFrame:
    return top_remotes(unusual_port_flows(network, common), "remote_port", k)


# --- combined --------------------------------------------------------------


def _ranked(section: str, rows: DataFrame, key: Column, value: Column, order: list) -> DataFrame:
    """A short list (cut to a top-k, or one row per event type) as (section, rank, key, value)."""
    packed = rows.agg(F.array_sort(F.collect_list(F.struct(*order, key.alias("key"), value.alias("value")))).alias("l"))
    return packed.select(F.posexplode("l").alias("pos", "r")).select(
        F.lit(section).alias("section"), (F.col("pos") + 1).alias("rank"), "r.key", "r.value")


def _first(section: str, rows: DataFrame, key: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("target"), key.alias("value"))


def investigation_targets(
    events: DataFrame, subjects: DataFrame, seconds: int = 60, rare_below: float = 10
) -> DataFrame:
    """Largest burst, most frequent rare type, most active subject if it is known."""
    return _targets(events, subjects, *_activity_parts(events, seconds, rare_below))


def _targets(
    events: DataFrame, subjects: DataFrame, bursts: DataFrame, rare: DataFrame
) -> DataFrame:
    burst = bursts.orderBy(F.desc("n_events"), "minute").limit(1)
    rarest = rare.orderBy(F.desc("n_events"), "type").limit(1)
    active = most_active_subjects(events, 1)
    known = first_per_id(subjects.join(
        F.broadcast(active.select(F.col("subject").alias("uuid"))), "uuid", "left_semi"))
    return (
        _first("burst", burst, F.date_format("minute", "yyyy-MM-dd HH:mm:ss"))
        .unionByName(_first("rare_type", rarest, F.col("type")))
        .unionByName(_first("active_subject", known, F.concat(F.lit("PID "), F.col("cid")))))


def findings(
    events: DataFrame, subjects: DataFrame, seconds: int = 60, rare_below: float = 10
) -> DataFrame:
    """The findings report: top five bursts, rare types, targets."""
    bursts, rare = _activity_parts(events, seconds, rare_below)
    leading = bursts.orderBy(F.desc("n_events"), "minute").limit(5)
    size = F.col("n_events").cast("string")
    return (
        _ranked("activity_bursts", leading, F.date_format("minute", "yyyy-MM-dd HH:mm:ss"), size,
                [(-F.col("n_events")).alias("o1"), F.col("minute").alias("o2")])
        .unionByName(_ranked("rare_events", rare, F.col("type"), size,
                             [(-F.col("n_events")).alias("o1"), F.col("type").alias("o2")]))
        .unionByName(_ranked(
            "targets", _targets(events, subjects, bursts, rare), F.col("target"), F.col("value"),
            [F.when(F.col("target") == "burst", 1).when(F.col("target") == "rare_type", 2)
             .otherwise(3).alias("o1")])))
