from datetime import timedelta

import pytest

from hostweave.functions.durable import durable
from hostweave.operators import clean, windows
from hostweave.operators.graph import edges, interactions, overlapping_interactions
from tests.conftest import T0, rows


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_tumbling_windows_exist_only_with_events(log):
    events = log((0.2, "READ", "a", "x"), (0.9, "READ", "a", "x"), (5.0, "READ", "a", "x"))
    assert rows(windows.tumbling_windows(events)) == [(at(0), at(1), 2), (at(5), at(6), 1)]
    assert [tuple(r) for r in rows(windows.with_tumbling_window(events), "ordinal", "window_start")] == [
        (0, at(0)), (1, at(0)), (2, at(5))]


def test_longer_windows_overlap_and_start_at_each_nonempty_second(log):
    events = log((0.5, "READ", "a", "x"), (3.2, "READ", "b", "y"))
    got = rows(windows.with_overlapping_windows(events, 5), "window_start", "window_end", "ordinal")
    assert got == [(at(0), at(5), 0), (at(0), at(5), 1), (at(3), at(8), 1)]


def test_pane_merge_equals_windows_over_events(log):
    events = log((0.1, "READ", "a", "x"), (1.5, "WRITE", "a", "x"), (1.6, "READ", "a", "y"),
                 (4.0, "OPEN", "a", "x"), (2.2, "EXECUTE", "a", "x"), (9.0, "READ", "x", None))
    direct = edges(interactions(windows.with_overlapping_windows(events, 3)))
    panes = interactions(windows.with_tumbling_window(events))
    merged = edges(overlapping_interactions(panes, 3))
    columns = ["window_start", "source", "target", "event", "ts", "n_events", "first_ts", "last_ts"]
    assert rows(direct, *columns) == rows(merged, *columns)
    with pytest.raises(ValueError):
        overlapping_interactions(panes, 3, 2)


def test_anchored_windows_drop_a_last_event_on_the_boundary(log):
    events = log((0.5, "READ", "a", "x"), (1.4, "READ", "a", "x"), (3.5, "READ", "a", "x"))
    got = rows(windows.with_anchored_window(events), "ordinal", "window_id", "window_start")
    assert got == [(0, 0, at(0.5)), (1, 0, at(0.5))]
    inside = log((0.5, "READ", "a", "x"), (3.4, "READ", "a", "x"))
    assert rows(windows.with_anchored_window(inside), "ordinal", "window_id") == [(0, 0), (1, 2)]


def test_anchored_windows_of_a_single_instant(log):
    assert windows.with_anchored_window(log((1, "READ", "a", "x"))).count() == 0


def test_window_numbers_are_dense(spark, log):
    events = log(*[(s, "READ", "a", "x") for s in (700, 0, 0.5, 3, 90_000)])
    numbered = windows.number_windows(durable(windows.window_starts(events)))
    assert rows(numbered, "window_id", "window_start") == [
        (0, at(0)), (1, at(3)), (2, at(700)), (3, at(90_000))]


@pytest.mark.parametrize("start, end, label", [
    (10, 20, 1),    # window [20,21) starts exactly at the attack end
    (21, 30, 1),    # window ends exactly at the attack start
    (21.001, 30, 0), (0, 19.999, 0), (0, 100, 1)])
def test_labels_are_inclusive_at_both_ends(spark, log, start, end, label):
    spans = windows.with_tumbling_window(log((20.5, "READ", "a", "x"))).select(
        "window_start", "window_end")
    attack = (at(start), at(end))
    assert windows.label_windows(spans, [attack]).first()["label"] == label
    table = spark.createDataFrame([attack, attack], "start timestamp_ntz, end timestamp_ntz")
    assert rows(windows.label_windows(spans, table), "label") == [(label,)]


def test_labels_without_attacks(log):
    spans = windows.with_tumbling_window(log((1, "READ", "a", "x")))
    assert windows.label_windows(spans).first()["label"] == 0


def test_attack_table_across_days(spark, log):
    events = log((0, "READ", "a", "x"), (3 * 86400, "READ", "a", "x"), (9 * 86400, "READ", "a", "x"))
    spans = windows.with_tumbling_window(events, 3600).select("window_start", "window_end")
    table = spark.createDataFrame(
        [(at(-86400), at(4 * 86400)), (at(0), at(60))], "start timestamp_ntz, end timestamp_ntz")
    assert [r.label for r in windows.label_windows(spans, table).orderBy("window_start").collect()] == [1, 1, 0]


def test_allow_list_and_null_subject(spark, log):
    events = log((0, "CLOSE", "a", "x"), (0, "READ", None, "x"), (0, "CREATE", "a", ""))
    assert rows(clean.graph_events(events), "ordinal", "subject", "object") == [(2, "a", None)]
    # Kept on request under the id that a missing value prints as.
    assert rows(clean.graph_events(events, null_subject="nan"), "ordinal", "subject") == [
        (1, "nan"), (2, "a")]
    assert clean.keep_event_types(events, None).count() == 3


def test_missing_object_column(log):
    bare = log((0, "READ", "a", "x")).drop("object")
    assert rows(clean.clean_identifiers(bare), "subject", "object") == [("a", None)]
