from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from hostweave.functions.durable import durable
from hostweave.operators import graph, windows
from hostweave.operators.features import node_features
from hostweave.sources.cdm import ENVELOPE
from hostweave.streaming import live
from tests.conftest import T0, rows


def stream(spark, folder, *batches):
    """Each batch is one file, read in its own micro-batch."""
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(folder)


def part(log, events, lo, hi):
    return log(*events).filter(F.col("ordinal").between(lo, hi))


EVENTS = [(0.1, "READ", "a", "x"), (0.2, "WRITE", "a", "x"), (1.3, "OPEN", "x", "b"), (0.9, "READ", "b", "a"),
          (2.2, "READ", "a", "y"), (9.0, "READ", "q", "r")]


def test_counts_equal_the_batch_result(spark, log, tmp_path):
    source = stream(spark, str(tmp_path), part(log, EVENTS, 0, 2), part(log, EVENTS, 3, 5))
    got = live.run_to_end(live.live_window_counts(source, 1, "2 seconds"), "t")
    batch = windows.tumbling_windows(log(*EVENTS)).filter(F.col("window_end") <= T0 + timedelta(seconds=7))
    assert rows(got) == rows(batch, "window_start", "window_end", "n_events")


def test_late_events_are_dropped(spark, log, tmp_path):
    """A batch is filtered with the watermark of the batch before, hence one batch in between."""
    events = [(0.1, "READ", "a", "x"), (50.0, "READ", "a", "x"), (50.5, "READ", "a", "x"),
              (0.2, "READ", "a", "x"), (99.0, "READ", "a", "x")]
    source = stream(spark, str(tmp_path), *[
        part(log, events, lo, hi) for lo, hi in ((0, 1), (2, 2), (3, 3), (4, 4))])
    got = live.run_to_end(live.live_window_counts(source, 1, "5 seconds"), "t")
    assert [(r.window_start, r.n_events) for r in got.orderBy("window_start").collect()] == [
        (T0, 1), (T0 + timedelta(seconds=50), 2)]


def test_burst_flags(spark, log, tmp_path):
    events = [(0.1 * i, "READ", "a", "x") for i in range(8)] + [(3, "READ", "a", "x"), (99, "READ", "a", "x")]
    baseline = live.burst_baseline(log(*[(s, "READ", "a", "x") for s in range(6)]), 1)
    source = stream(spark, str(tmp_path), log(*events))
    got = live.run_to_end(live.live_burst_flags(live.live_window_counts(source, 1, "1 second"), baseline), "t")
    assert [r.burst for r in got.orderBy("window_start").collect()] == [1, 0]


def test_features_equal_the_batch_result(spark, log, tmp_path):
    events = EVENTS + [(60, "READ", "z", "z")]
    source = stream(spark, str(tmp_path / "in"), part(log, events, 0, 2), part(log, events, 3, 4), part(log, events, 5, 6))
    out = str(tmp_path / "out")
    live.run_to_end(live.closed_interactions(source, 1, "2 seconds"), "t", live.feature_writer(out))
    batch = node_features(graph.interactions(windows.with_tumbling_window(
        log(*events).filter("ordinal < 6"))))
    columns = [c for c in batch.columns]
    assert rows(spark.read.parquet(out), *columns) == rows(batch, *columns)


def test_closed_windows_are_planned_by_their_size(spark, log, tmp_path, monkeypatch):
    """The batch that closes a window may read no events; joins over its pairs are not planned as over nothing."""
    plans = []

    def features(pairs, **options):
        joined = pairs.join(pairs.select("window_start", "subject").distinct(), ["window_start", "subject"])
        plans.append(joined._jdf.queryExecution().executedPlan().toString())
        return node_features(pairs, **options)

    monkeypatch.setattr(live, "node_features", features)
    events = [(0.0001 * i, "READ", f"s{i}", f"o{i % 70}") for i in range(3000)] + [(60, "READ", "z", "z")]
    source = stream(spark, str(tmp_path / "in"), log(*events))
    out, before = str(tmp_path / "out"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")  # 3,000 subjects are more
    try:
        live.run_to_end(live.closed_interactions(source, 1, "2 seconds"), "t", live.feature_writer(out))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 1 and "Broadcast" not in plans[0] and "AdaptiveSparkPlan" in plans[0]
    assert spark.read.parquet(out).count() == 3070


def test_sequences_per_host_across_batches(spark, tmp_path):
    def closed(*items):
        return spark.createDataFrame(
            [(host, T0 + timedelta(seconds=s), label) for host, s, label in items],
            "host_id string, window_start timestamp_ntz, label int")
    source = stream(
        spark, str(tmp_path), closed(("h", 2, 0), ("h", 0, 1), ("g", 0, 0)),
        closed(("h", 9, 0)), closed(("h", 20, 0), ("h", 30, 0), ("g", 5, 0), ("g", 6, 1)))
    got = live.run_to_end(live.live_sequences(source), "t")
    base = int((T0 - T0.replace(year=1970, month=1, day=1, hour=0)).total_seconds()) * 1_000_000
    assert sorted((r.host_id, (r.first_us - base) / 1e6, (r.last_us - base) / 1e6, r.label)
                  for r in got.collect()) == [
        ("g", 0, 6, 1), ("h", 0, 9, 1), ("h", 2, 20, 0), ("h", 9, 30, 0)]


def test_a_window_older_than_the_state_is_an_error(spark, tmp_path):
    def closed(*seconds):
        return spark.createDataFrame(
            [("h", T0 + timedelta(seconds=s), 0) for s in seconds], "host_id string, window_start timestamp_ntz, label int")
    source = stream(spark, str(tmp_path), closed(5, 7, 6), closed(1, 2))
    with pytest.raises(Exception, match="a window at"):
        live.run_to_end(live.live_sequences(source), "t")


def test_duplicates_within_the_watermark(spark, log, tmp_path):
    feed = log((0, "READ", "a", "x"), (1, "READ", "a", "x")).withColumn("uuid", F.lit("e1"))
    source = stream(spark, str(tmp_path), feed.filter("ordinal = 0"), feed.filter("ordinal = 1"))
    assert live.run_to_end(live.deduplicated(source, "10 seconds"), "t").count() == 1


def test_streams_need_a_utc_session(spark, log):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError, match="UTC"):
            live.with_event_time(log((0, "READ", "a", "x")), "1 second")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_durable_cuts_lineage(log):
    assert "Scan ExistingRDD" in durable(log((0, "READ", "a", "x")))._jdf.queryExecution().toString()


def spans_of(spark, items):
    return spark.createDataFrame(
        [(host, T0 + timedelta(seconds=s), T0 + timedelta(seconds=s), label) for host, s, label in items],
        "host_id string, start timestamp_ntz, end timestamp_ntz, label int")


def seconds_of(got):
    base = int((T0 - T0.replace(year=1970, month=1, day=1, hour=0)).total_seconds()) * 1_000_000
    return sorted((r.key, (r.first_us - base) / 1e6, (r.last_us - base) / 1e6, r.label) for r in got.collect())


def test_runs_in_any_order_of_arrival(spark, tmp_path):
    """Shuffled rows in four batches give the runs of the sorted table; repeated rows count once."""
    import random

    r = random.Random(6)
    items = [(f"h{i % 3}", s, r.randint(0, 1)) for i in range(3) for s in r.sample(range(200), 30)]
    items = list({(h, s): (h, s, l) for h, s, l in items}.values())
    want = []
    for host in {i[0] for i in items}:
        own = sorted(i[1:] for i in items if i[0] == host)
        want += [(host, own[k][0], own[k + 2][0], max(x[1] for x in own[k:k + 3])) for k in range(len(own) - 2)]
    r.shuffle(items)
    quarter = len(items) // 4 + 1
    batches = [spans_of(spark, items[i:i + quarter]) for i in range(0, len(items), quarter)]
    source = stream(spark, str(tmp_path), *batches, spans_of(spark, items[:5]), spans_of(spark, [("end", 9999, 0)]))
    with live.rocksdb_state(spark):
        got = live.run_to_end(live.ordered_runs(source, "host_id", "300 seconds"), "t")
    assert seconds_of(got) == sorted(want)


def test_late_rows_do_not_stop_the_stream(spark, tmp_path):
    source = stream(spark, str(tmp_path), spans_of(spark, [("h", 0, 0), ("h", 50, 0)]), spans_of(spark, [("h", 100, 0)]),
                    spans_of(spark, [("h", 10, 1)]), spans_of(spark, [("h", 999, 0)]), spans_of(spark, [("end", 9999, 0)]))
    with live.rocksdb_state(spark):
        got = live.run_to_end(live.ordered_runs(source, "host_id", "5 seconds", length=2), "t")
    assert seconds_of(got) == [("h", 0, 50, 0), ("h", 50, 100, 0), ("h", 100, 999, 0)]


def test_idle_keys_are_forgotten(spark, tmp_path):
    """No run reaches over a pause that is longer than a key is kept."""
    batches = [[("h", 0, 0), ("g", 0, 0)], [("h", 10, 0)], [("x", 500, 0)], [("x", 900, 0)], [("h", 1000, 0), ("g", 1001, 0)],
               [("h", 1010, 0)], [("end", 9999, 0)]]
    source = stream(spark, str(tmp_path), *[spans_of(spark, b) for b in batches])
    with live.rocksdb_state(spark):
        got = live.run_to_end(live.ordered_runs(source, "host_id", "5 seconds", length=2, idle_seconds=100), "t")
    assert seconds_of(got) == [("h", 0, 10, 0), ("h", 1000, 1010, 0)]


def test_sessions_and_gaps(spark, log, tmp_path):
    times = [0, 10, 30, 200, 210, 900, 2000]
    events = log(*[(s, "READ", "a", "x") for s in times]).withColumn("host_id", F.lit("h"))
    source = stream(spark, str(tmp_path / "in"), events.filter("ordinal < 3"), events.filter("ordinal >= 3"))
    sessions = live.run_to_end(live.live_sessions(source, "60 seconds", "10 seconds", "host_id"), "s")
    assert rows(sessions, "start", "end", "n_events") == [
        (T0, T0 + timedelta(seconds=30), 3), (T0 + timedelta(seconds=200), T0 + timedelta(seconds=210), 2),
        (T0 + timedelta(seconds=900), T0 + timedelta(seconds=900), 1)]
    last = spark.createDataFrame([("end", T0 + timedelta(days=9), T0 + timedelta(days=9), 1)], sessions.schema)
    again = stream(spark, str(tmp_path / "s"), sessions, last)
    with live.rocksdb_state(spark):
        gaps = live.run_to_end(live.live_gaps(again, "host_id", "10 seconds"), "g")
    assert rows(gaps, "gap_s") == [(170.0,), (690.0,)]


def marked(spark, folder, *files):
    """Each file holds (host, session, kind, second) and is read in its own micro-batch."""
    for i, told in enumerate(files):
        lines = []
        for host, session, kind, second in told:
            field = {"EVENT": "timestampNanos", "TIME_MARKER": "tsNanos"}.get(kind, "sessionNumber")
            value = session if second is None else int(second * 1_000_000_000)
            lines.append((f'{{"type":"RECORD_{kind}","hostId":"{host}","sessionNumber":{session},"datum":{{"{field}":{value}}}}}',))
        spark.createDataFrame(lines, "value string").coalesce(1).write.text(f"{folder}/b{i}")
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").json(folder)


def marker_windows(spark, folder, *files, parts=1):
    with live.rocksdb_state(spark):
        got = live.run_to_end(live.windows_by_markers(marked(spark, folder, *files), 10, "UTC", parts), "t")
    summed = got.groupBy("host_id", "session_number", "window_start", "late").agg(F.sum("n_events").alias("n"))
    return rows(summed.withColumn("start", F.unix_timestamp(F.col("window_start").cast("timestamp"))),
                "host_id", "session_number", "start", "late", "n")


@pytest.mark.parametrize("parts", [1, 3])
def test_markers_close_the_windows_of_their_own_session(spark, tmp_path, parts):
    got = marker_windows(
        spark, str(tmp_path),
        [("a", 1, "EVENT", 1), ("a", 1, "EVENT", 9.999999), ("b", 1, "EVENT", 2), ("a", 1, "EVENT", 12)],
        [("a", 1, "TIME_MARKER", 10), ("a", 1, "EVENT", 13), ("a", 2, "EVENT", 3)],
        [("a", 1, "EVENT", 4), ("a", 1, "TIME_MARKER", 19.9)],          # late, and no further window has passed
        [("a", 1, "EVENT", 25), ("a", 1, "END_MARKER", None)],
        [("a", 1, "EVENT", 26), ("a", 2, "TIME_MARKER", 100), ("b", 1, "HOST", None)],
        parts=parts)
    assert got == [("a", 1, 0, False, 2), ("a", 1, 0, True, 1), ("a", 1, 10, False, 2), ("a", 1, 20, False, 1),
                   ("a", 1, 20, True, 1), ("a", 2, 0, False, 1)]


def test_an_earlier_marker_does_not_reopen_windows(spark, tmp_path):
    got = marker_windows(
        spark, str(tmp_path), [("a", 1, "EVENT", 1), ("a", 1, "TIME_MARKER", 30)],
        [("a", 1, "TIME_MARKER", 5), ("a", 1, "EVENT", 2)], [("a", 1, "TIME_MARKER", 40)])
    assert got == [("a", 1, 0, False, 1), ("a", 1, 0, True, 1)]


def test_records_without_markers_give_nothing(spark, tmp_path):
    assert marker_windows(spark, str(tmp_path), [("a", 1, "EVENT", 1)], [("a", 1, "EVENT", 900)]) == []
