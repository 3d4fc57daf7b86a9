"""The windowed operators on unbounded input.

Watermarks need ``TIMESTAMP``, while the tables hold naive times, so streams run
in a UTC session: ``event_time`` is then the naive value itself. Results leave
in append mode, once a window can no longer change.
"""

import contextlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hostweave.functions.durable import new_path
from hostweave.functions.ids import clean_id
from hostweave.functions.timefn import floor_div, from_micros, nanos_to_local, to_micros
from hostweave.operators.features import node_features
from hostweave.operators.graph import interactions
from hostweave.operators.reports import events_per_minute
from hostweave.sources.cdm import RECORD_TYPES

_UTC = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def with_event_time(events: DataFrame, delay: str) -> DataFrame:
    """Add the watermarked ``event_time``; events later than ``delay`` are dropped downstream."""
    zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in _UTC:
        raise ValueError(f"streams over naive times need a UTC session, not {zone}")
    return events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark(
        "event_time", delay)


def live_window_counts(
    events: DataFrame, seconds: int, delay: str, by: Sequence[str] = ()
) -> DataFrame:
    """Events per closed window, and per value of the columns ``by``."""
    return (
        with_event_time(events, delay)
        .groupBy(F.window("event_time", f"{seconds} seconds").alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(*by, F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n_events"))


def burst_baseline(history: DataFrame, seconds: int) -> DataFrame:
    """One row with the mean event count of the non-empty windows of past data."""
    return events_per_minute(history, seconds).agg(F.avg("n_events").alias("mean_events"))


def live_burst_flags(
    counts: DataFrame, baseline: DataFrame, factor: float = 2.0
) -> DataFrame:
    """Closed windows flagged against a static one-row baseline."""
    mean = F.broadcast(baseline.select(F.lit(1).alias("__one"), "mean_events"))
    return counts.withColumn("__one", F.lit(1)).join(mean, "__one").withColumn(
        "burst", (F.col("n_events") > F.lit(factor) * F.col("mean_events")).cast("int")).drop(
        "__one", "mean_events")


def deduplicated(records: DataFrame, delay: str, key: str = "uuid") -> DataFrame:
    """Copies of a record within the watermark are dropped, with bounded state."""
    return with_event_time(records, delay).dropDuplicatesWithinWatermark([key]).drop("event_time")


def closed_interactions(events: DataFrame, seconds: int, delay: str) -> DataFrame:
    """``interactions`` of every window, emitted when the window closes.

    All pairs of a window leave in the same micro-batch.
    """
    windowed = with_event_time(events, delay).withColumn(
        "w", F.window("event_time", f"{seconds} seconds"))
    pairs = interactions(windowed, key="w")
    return pairs.withColumn("window_start", F.col("w.start").cast("timestamp_ntz")).drop("w")


def feature_writer(folder: str, **options) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes all node features of the closed windows.

    The batch number names the output partition, so a repeated batch overwrites itself.
    Pairs are staged and read again by the session that made the writer: in the stream's own
    session plans are not adaptive, and a batch that closes windows without new events passes
    for empty, so every join would broadcast. One writer serves one stream.
    """
    spark = SparkSession.active()
    path = new_path(spark, "closed-pairs")

    def write(pairs: DataFrame, batch_id: int) -> None:
        pairs.write.mode("overwrite").parquet(path)  # the stateful batch must not run once for each reader
        closed = spark.read.schema(pairs.schema).parquet(path)
        if closed.isEmpty():
            return
        node_features(closed, **{"cut": False, **options}).write.mode("overwrite").parquet(
            f"{folder}/batch_id={batch_id}")
    return write


def live_sequences(windows: DataFrame, length: int = 3) -> DataFrame:
    """The last ``length`` non-empty windows of each host whenever a window closes.

    ``windows`` has host_id, window_start and label, one row per closed window.
    Windows close in time order, so a batch continues the host's state, its last
    ``length - 1`` windows; a window older than the state is an error, since
    sequences over it have left already.
    """
    def roll(
        key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        starts, labels = ([], []) if not state.exists else (
            list(state.get[0]), list(state.get[1]))
        fresh = pd.concat(list(chunks)).sort_values("window_start")
        first = int(pd.to_datetime(fresh["window_start"]).iloc[0].value // 1000)
        if starts and first <= starts[-1]:
            raise ValueError(f"host {key[0]}: a window at {first} us after one at {starts[-1]} us")
        starts += [int(v.value // 1000) for v in pd.to_datetime(fresh["window_start"])]
        labels += [int(v) for v in fresh["label"]]
        rows = [
            (key[0], starts[i], starts[i + length - 1], max(labels[i:i + length]))
            for i in range(len(starts) - length + 1)
            if length > 1 or i >= len(starts) - len(fresh)]
        keep = max(1, length - 1)  # the newest window also tells what comes too late
        state.update((starts[-keep:], labels[-keep:]))
        yield pd.DataFrame(rows, columns=["host_id", "first_us", "last_us", "label"])

    return windows.groupBy("host_id").applyInPandasWithState(
        roll, "host_id string, first_us bigint, last_us bigint, label int",
        "starts array<bigint>, labels array<int>", "append", GroupStateTimeout.NoTimeout)


class _InOrder(StatefulProcessor):
    """Rows of a key in the order of their time, however they arrive, and runs of ``length`` of them.

    A row waits in ``pending`` until the watermark has passed its end; one timer, at
    the earliest of them, wakes the key. Then it joins the last rows of the key, of
    which ``length - 1`` are kept. A key that has been without rows for ``idle_us`` of
    event time has no state any more.
    """

    def __init__(self, length: int, idle_us: int | None):
        self.length, self.idle_us = length, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = "start_us bigint, end_us bigint, label int"
        self.pending, self.recent = handle.getListState("pending", row), handle.getListState("recent", row)

    def _timer(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(a), int(b), int(label)) for chunk in rows for a, b, label in zip(
            chunk["start_us"], chunk["end_us"], chunk["label"])]
        self.pending.appendList(fresh)
        self._timer(min(end for _, end, _ in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        spans: dict[int, tuple[int, int]] = {}
        for start, end, label in self.pending.get():  # the same span may have come twice
            old = spans.get(start, (end, label))
            spans[start] = max(end, old[0]), max(label, old[1])
        ready = sorted((a, b, label) for a, (b, label) in spans.items() if b < passed)
        held = sorted((int(a), int(b), int(label)) for a, b, label in self.recent.get())
        if not ready:
            if held and self.idle_us is not None and held[-1][1] + self.idle_us < passed:
                self.recent.clear()
            return
        rest = [(a, b, label) for a, (b, label) in spans.items() if b >= passed]
        if rest:
            self.pending.put(rest)
            self._timer(min(end for _, end, _ in rest))
        else:
            self.pending.clear()
        out = []
        for row in ready:
            if held and self.idle_us is not None and row[0] - held[-1][1] > self.idle_us:
                held = []
            held = [*held, row][-self.length:]
            if len(held) == self.length:
                out.append((key[0], *held[0][:2], *held[-1][:2], max(r[2] for r in held)))
        held = held[-(self.length - 1):] if self.length > 1 else []
        if held:
            self.recent.put(held)
            if self.idle_us is not None:
                self._timer(held[-1][1] + self.idle_us)
        if out:
            yield pd.DataFrame(out, columns=RUN_COLUMNS)

    def close(self) -> None:
        pass


_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers and maps need."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


RUN_COLUMNS = ["key", "first_us", "first_end_us", "last_us", "last_end_us", "label"]


def ordered_runs(
    spans: DataFrame, key: str, delay: str, length: int = 3, idle_seconds: int | None = None,
) -> DataFrame:
    """Each run of ``length`` consecutive spans of a key, once nothing earlier can arrive.

    ``spans`` has the key, ``start`` and ``end`` (naive times) and ``label``, in any
    order within ``delay`` of the newest; later ones are dropped. Gives (key, first_us,
    first_end_us, last_us, last_end_us, label), ends from the first and last span,
    label the largest. With ``idle_seconds`` a key without spans for so long is
    forgotten, and no run reaches over such a pause. Run it within ``rocksdb_state``.
    """
    zone = spans.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in _UTC:
        raise ValueError(f"streams over naive times need a UTC session, not {zone}")
    timed = spans.select(
        F.col(key).alias("key"), to_micros("start").alias("start_us"), to_micros("end").alias("end_us"), "label",
        F.col("end").cast("timestamp").alias("event_time")).withWatermark("event_time", delay)
    idle = None if idle_seconds is None else idle_seconds * 1_000_000
    return timed.groupBy("key").transformWithStateInPandas(
        _InOrder(length, idle), "key string, first_us bigint, first_end_us bigint, last_us bigint, last_end_us bigint, label int",
        "append", "EventTime")


def live_sessions(events: DataFrame, gap: str, delay: str, by: str) -> DataFrame:
    """Closed activity sessions: (by, start, end, n_events), parted by pauses of ``gap`` or more."""
    return with_event_time(events, delay).groupBy(F.session_window("event_time", gap).alias("w"), by).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n_events")).drop("w")


def live_gaps(sessions: DataFrame, by: str, delay: str) -> DataFrame:
    """Pauses between consecutive sessions of a key, as (key, gap_start, gap_end, gap_s)."""
    pairs = ordered_runs(sessions.withColumn("label", F.lit(0)), by, delay, length=2)
    return pairs.select(
        "key", from_micros("first_end_us").alias("gap_start"), from_micros("last_us").alias("gap_end"),
        ((F.col("last_us") - F.col("first_end_us")) / 1_000_000.0).alias("gap_s"))


class _ByMarkers(StatefulProcessor):
    """Events per window of one session, each given out when the session's own markers have passed it.

    ``passed`` is the time up to which the session is complete; ``open`` holds the
    counts of the windows that end after it.
    """

    ENDED = 1 << 62  # later than any time in microseconds

    def __init__(self, width_us: int):
        self.width = width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.passed = handle.getValueState("passed", "us bigint")
        self.open = handle.getMapState("open", "start_us bigint", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: Counter[int] = Counter()
        before = now = self.passed.get()[0] if self.passed.exists() else -self.ENDED
        for chunk in rows:
            at, kind = chunk["at_us"], chunk["kind"]
            starts = at[kind == "events"] // self.width * self.width
            fresh.update({int(start): int(n) for start, n in starts.value_counts().items()})
            if (kind == "end_markers").any():
                now = self.ENDED
            now = max([now, *at[kind == "time_markers"].tolist()])
        out = [(start, n, True) for start, n in sorted(fresh.items()) if start + self.width <= before]
        for start, n in fresh.items():
            if start + self.width > before:
                held = self.open.getValue((start,))[0] if self.open.containsKey((start,)) else 0
                self.open.updateValue((start,), (held + n,))
        if now > before:
            self.passed.update((now,))
            ready = sorted((k[0], v[0]) for k, v in self.open.iterator() if k[0] + self.width <= now)
            for start, _ in ready:
                self.open.removeKey((start,))
            out += [(start, n, False) for start, n in ready]
        if out:
            frame = pd.DataFrame(out, columns=["start_us", "n_events", "late"])
            frame.insert(0, "host_id", key[0])
            frame.insert(1, "session_number", key[1])
            yield frame

    def close(self) -> None:
        pass


def windows_by_markers(records: DataFrame, seconds: int, zone: str = "America/New_York", parts: int = 1) -> DataFrame:
    """Events per window of each session, closed by the session's own time and end markers.

    ``records`` are envelopes as ``read_records`` gives them. A marker says that its
    session has told all before its time, an end marker that nothing follows; other
    sessions, silent ones too, do not matter, and there is no watermark. Gives
    (host_id, session_number, window_start, window_end, n_events, late) with local
    times. Events of a window that is closed already leave at once, as a row with
    ``late``. Windows are cut in absolute time, so a change of the clock parts them.
    With ``parts`` the events of every session are dealt over so many tasks, and a
    window has up to so many rows, which add up. Events without a time are left out;
    a missing session number counts as 0. A session that has ended leaves one number
    per part in the state. Run it within ``rocksdb_state``.
    """
    kind = F.lit(None).cast("string")
    for table in ("events", "time_markers", "end_markers"):
        kind = F.when(F.col("type") == RECORD_TYPES[table], table).otherwise(kind)
    nanos = F.coalesce(*[F.variant_get("datum", f"$.{name}", "bigint") for name in ("timestampNanos", "tsNanos")])
    told = records.select(
        F.coalesce(clean_id("hostId"), F.lit("")).alias("host_id"),
        F.coalesce("sessionNumber", F.lit(0)).alias("session_number"), kind.alias("kind"),
        floor_div(nanos, 1000).alias("at_us"), F.xxhash64(F.col("datum").cast("string")).alias("__hash")
    ).filter((F.col("kind") == "end_markers") | F.col("at_us").isNotNull() & F.col("kind").isNotNull())
    part = F.when(F.col("kind") == "events", F.array(F.pmod("__hash", F.lit(parts)).cast("int"))).otherwise(
        F.sequence(F.lit(0), F.lit(parts - 1)))
    counts = told.select(
        "host_id", "session_number", F.explode(part).alias("part"), "kind", F.coalesce("at_us", F.lit(0)).alias("at_us")
    ).groupBy("host_id", "session_number", "part").transformWithStateInPandas(
        _ByMarkers(seconds * 1_000_000), "host_id string, session_number int, start_us bigint, n_events bigint, late boolean",
        "append", "None")

    def local(us: Column) -> Column:
        return nanos_to_local(us * 1000, zone)

    return counts.select(
        "host_id", "session_number", local(F.col("start_us")).alias("window_start"),
        local(F.col("start_us") + seconds * 1_000_000).alias("window_end"), "n_events", "late")


def run_to_end(stream: DataFrame, name: str, sink: Callable | None = None) -> DataFrame | None:
    """Drain an available-now stream into Parquet (or ``sink``) and return what was written."""
    spark = SparkSession.active()
    folder = new_path(spark, name)
    writer = stream.writeStream.trigger(availableNow=True).option(
        "checkpointLocation", f"{folder}-checkpoint").outputMode("append")
    if sink is not None:
        writer.foreachBatch(sink).start().awaitTermination()
        return None
    writer.format("parquet").start(folder).awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)
