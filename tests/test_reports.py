from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hostweave.operators import reports
from tests.conftest import T0, rows

SUBJECTS = "uuid string, type string, cid int, parent_subject string, start_timestamp timestamp_ntz"
FLOWS = "uuid string, local_address string, remote_address string, remote_port int"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def many(*groups):
    return [(s + i * 0.001, kind, subject, "x") for s, kind, subject, n in groups for i in range(n)]


def test_type_distribution_and_ties(log):
    events = log(*many((0, "READ", "a", 3), (1, "WRITE", "a", 3), (2, "OPEN", "a", 2)))
    got = reports.type_distribution(events, 2).collect()
    assert [tuple(r) for r in got] == [("EVENT_READ", 3, 37.5), ("EVENT_WRITE", 3, 37.5)]


def test_bursts_need_more_than_twice_the_mean(log):
    exactly = log(*many((0, "READ", "a", 4), (60, "READ", "a", 1), (120, "READ", "a", 1)))
    assert reports.burst_minutes(exactly).count() == 0
    above = log(*many((0, "READ", "a", 5), (60, "READ", "a", 1), (600, "READ", "a", 1)))
    assert [(r.minute, r.n_events, round(r.ratio, 3)) for r in reports.burst_minutes(above).collect()] == [
        (at(0), 5, 2.143)]


def test_exactly_ten_is_not_rare(log):
    events = log(*many((0, "READ", "a", 10), (5, "FORK", "a", 9)))
    assert rows(reports.rare_types(events)) == [("EVENT_FORK", 9, at(5))]


def test_gap_of_exactly_one_minute_is_not_reported(log):
    events = log((0, "READ", "a", "x"), (60, "READ", "a", "x"), (120.001, "READ", "a", "x"),
                 (119, "READ", "a", "x"), (500, "READ", "a", "x"), (900, "READ", "a", "x"))
    got = [(r.gap_start, r.gap_end, r.gap_s) for r in reports.long_gaps(events).collect()]
    assert got == [(at(500), at(900), 400.0), (at(120.001), at(500), 379.999)]
    assert reports.long_gaps(events, k=1).count() == 1
    assert reports.long_gaps(log((0, "READ", "a", "x"), (60, "READ", "a", "x"))).count() == 0


def test_missing_parent_takes_a_place_and_is_skipped(spark):
    data = [("p1", "SUBJECT_PROCESS", 1, None, T0)] + [
        (f"c{i}", "SUBJECT_THREAD", 10 + i, parent, T0)
        for i, parent in enumerate(["gone"] * 3 + ["p1"] * 2 + ["c0"])]
    subjects = spark.createDataFrame(data, SUBJECTS)
    assert rows(reports.top_parents(subjects, 2)) == [("p1", 1, 2)]
    assert rows(reports.parent_coverage(subjects)) == [(6, 7)]


def test_descriptions_use_the_first_row_or_a_short_id(spark, log):
    events = log(*many((0, "READ", "known", 3), (1, "READ", "x" * 30, 2)))
    subjects = spark.createDataFrame(
        [("known", "SUBJECT_THREAD", 8, None, datetime(2024, 5, 2)),
         ("known", "SUBJECT_PROCESS", 7, None, datetime(2024, 5, 1))], SUBJECTS)
    got = reports.described_subjects(reports.most_active_subjects(events), subjects)
    assert {r.description for r in got.collect()} == {"PID 7 (SUBJECT_PROCESS)", "x" * 20 + "..."}


def flows(spark):
    return spark.createDataFrame(
        [("f1", "l1", None, None), ("f2", "l1", "r1", 53), ("f3", "l2", "r1", 5355),
         ("f4", "l2", "r2", 5355), ("f5", "l2", "r3", 138)], FLOWS)


def test_network_reports(spark):
    net = flows(spark)
    assert rows(reports.address_counts(net)) == [(2, 3)]
    assert rows(reports.unusual_port_flows(net), "uuid") == [("f1",), ("f3",), ("f4",), ("f5",)]
    assert [tuple(r) for r in reports.unusual_ports(net).collect()] == [(5355, 2), (138, 1)]
    assert [tuple(r) for r in reports.top_remotes(net, "remote_address", 2).collect()] == [
        ("r1", 2), ("r2", 1)]
    assert rows(reports.top_remotes(net, "remote_address", 10, at_least=2)) == [("r1", 2)]


def test_summary_and_targets(spark, log):
    events = log(*many((0, "READ", "a", 40), (600, "FORK", "b", 1), (1200, "READ", "b", 2)))
    subjects = spark.createDataFrame([("a", "SUBJECT_PROCESS", 44, None, T0)], SUBJECTS)
    row = reports.global_summary(events, subjects, flows(spark)).first()
    assert (row.total_events, row.event_types, row.total_processes, row.subjects_in_events,
            row.objects_in_events, row.network_connections) == (43, 2, 1, 2, 1, 5)
    assert row.time_span_s == pytest.approx(1200.001)
    targets = {r.target: r.value for r in reports.investigation_targets(events, subjects).collect()}
    assert targets == {"burst": "2024-05-01 10:00:00", "rare_type": "EVENT_FORK", "active_subject": "PID 44"}
    found = [(r.section, r["rank"], r.key, r.value) for r in reports.findings(events, subjects).collect()]
    assert ("activity_bursts", 1, "2024-05-01 10:00:00", "40") in found
    assert ("rare_events", 1, "EVENT_FORK", "1") in found
    assert ("targets", 3, "active_subject", "PID 44") in found
    unknown = reports.investigation_targets(events, subjects.filter("uuid = 'z'"))
    assert "active_subject" not in {r.target for r in unknown.collect()}


def test_top_types_over_time(log):
    events = log(*many((0, "READ", "a", 3), (60, "READ", "a", 1), (0, "OPEN", "a", 2), (0, "FORK", "a", 1)))
    assert rows(reports.top_types_over_time(events, 2)) == [
        (at(0), "EVENT_OPEN", 2), (at(0), "EVENT_READ", 3), (at(60), "EVENT_READ", 1)]


def test_sketches_merge_over_any_range(spark):
    values = spark.range(60_000).select(
        (F.col("id") % 50).alias("port"), (F.col("id") * 7919 % 20_011).cast("string").alias("address"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 4).alias("few"))
    sketches = reports.distinct_sketches(values, ["address", "few"], F.col("port"))
    for ports in (50, 7):
        some = values.filter(F.col("port") < ports)
        exact = some.agg(F.count_distinct("address"), F.count_distinct("few"), F.count(F.lit(1))).first()
        got = reports.sketched_counts(sketches.filter(F.col("slice") < ports), ["address", "few"]).first()
        assert abs(got.address - exact[0]) <= 4 * reports.sketch_error() * exact[0]
        assert (got.few, got.n_rows) == (exact[1], exact[2])


def test_sketches_of_nothing(spark):
    empty = reports.distinct_sketches(spark.range(0), ["id"], F.lit(1))
    assert rows(reports.sketched_counts(empty, ["id"])) == [(0, 0)]
    nulls = reports.distinct_sketches(spark.range(3).select(F.lit(None).cast("string").alias("v")), ["v"], F.lit(1))
    assert rows(reports.sketched_counts(nulls, ["v"])) == [(3, 0)]
