import random
from datetime import timedelta

import pytest

from hostweave.operators import graph, windows
from hostweave.operators.features import feature_vector, node_features
from hostweave.schemas import NODE_FEATURES
from tests import replay
from tests.conftest import T0, rows


def pairs_of(events, seconds=1, vocabulary=graph.GRAPH_EVENT_TYPES):
    return graph.interactions(windows.with_tumbling_window(events, seconds), vocabulary)


def test_last_event_of_a_pair_wins(log):
    pairs = pairs_of(log((0.1, "READ", "a", "x"), (0.9, "WRITE", "a", "x"), (0.5, "OPEN", "a", "x")))
    assert rows(graph.edges(pairs), "event", "ts", "n_events") == [
        ("EVENT_OPEN", T0 + timedelta(seconds=0.5), 3)]


@pytest.mark.parametrize("vocabulary", [graph.GRAPH_EVENT_TYPES, None])
def test_text_and_code_forms_agree(log, vocabulary):
    events = log((0.1, "READ", "a", "x"), (0.2, "WRITE", "a", "x"), (0.3, "READ", "a", "y"),
                 (0.4, "READ", "y", None))
    pairs = pairs_of(events, vocabulary=vocabulary)
    assert rows(graph.edges(pairs), "source", "target", "event") == [
        ("a", "x", "EVENT_WRITE"), ("a", "y", "EVENT_READ")]
    assert rows(graph.nodes(pairs), "node_id", "node_type", "in_degree", "out_degree", "event_type_count") == [
        ("a", "subject", 0, 2, 2), ("x", "object", 1, 0, 0), ("y", "subject", 1, 0, 0)]


def test_unknown_type_is_an_error(log):
    with pytest.raises(Exception, match="outside the vocabulary"):
        pairs_of(log((0, "NEW_KIND", "a", "x"))).collect()


@pytest.mark.parametrize("order, role", [((0, 1), "object"), ((1, 0), "subject")])
def test_role_is_the_last_mention(log, order, role):
    two = [(0.1, "READ", "n", "x"), (0.2, "READ", "m", "n")]
    nodes = graph.nodes(pairs_of(log(*[two[i] for i in order])))
    assert {r.node_id: r.node_type for r in nodes.collect()}["n"] == role


def test_self_loop(log):
    nodes = graph.basic_features(graph.nodes(pairs_of(log((0.1, "READ", "a", "a")))))
    assert rows(nodes, "node_id", "node_type", "degree", "event_count", "activity_rate") == [
        ("a", "object", 2, 2, 2)]


def test_isolated_subject(log):
    nodes = graph.basic_features(graph.nodes(pairs_of(log((0.1, "READ", "a", None)))))
    row = nodes.first()
    assert (row.node_type_flag, row.degree, row.event_type_count, row.time_sin, row.time_cos) == (
        1, 0, 0, 0.0, 0.0)


def test_node_index_and_edge_index(log):
    pairs = pairs_of(log((0.1, "READ", "c", "b"), (0.2, "READ", "a", "c"), (0.3, "READ", "a", "b")))
    indexed = graph.with_node_index(graph.nodes(pairs), width=2)
    assert rows(indexed, "node_idx", "node_id") == [(0, "c"), (1, "b"), (2, "a")]
    assert rows(graph.edge_index(graph.edges(pairs), indexed), "source_idx", "target_idx") == [
        (0, 1), (2, 0), (2, 1)]


def test_placeholder_for_windows_without_edges(log):
    pairs = pairs_of(log((0.1, "READ", "a", None), (1.1, "READ", "a", "b")))
    index = graph.edge_index(graph.edges(pairs), graph.with_node_index(graph.nodes(pairs)))
    got = graph.edge_index_or_placeholder(index, pairs.select("window_start").distinct())
    assert sorted((r.source_idx, r.target_idx, r.event) for r in got.collect() if r.event) == [
        (0, 1, "EVENT_READ")]
    assert [(r.source_idx, r.target_idx) for r in got.collect() if r.event is None] == [(0, 0)]


def test_undirected_pairs_and_one_hot(log):
    pairs = pairs_of(log((0.1, "READ", "a", "b"), (0.2, "FORK", "b", "a"), (0.3, "READ", "a", "a")))
    assert rows(graph.undirected(graph.edges(pairs)), "a", "b") == [("a", "a"), ("a", "b")]
    vectors = {(r.source, r.target): r.event_vector for r in graph.one_hot(graph.edges(pairs)).collect()}
    assert len(vectors["a", "b"]) == 22
    assert vectors["b", "a"].index(1.0) == 1 and sum(vectors["a", "b"]) == 1.0
    outside = graph.one_hot(graph.edges(pairs), ["EVENT_OTHER"])
    assert {tuple(r.event_vector) for r in outside.collect()} == {(0.0,)}


def random_log(log, seed, n=260, ids=14, windows_used=4):
    random.seed(seed)
    kinds = ["READ", "WRITE", "OPEN", "EXECUTE"]
    return [
        (random.randrange(windows_used) * 7 + random.randrange(0, 1_000_000, 40_000) / 1e6,
         random.choice(kinds), f"n{random.randrange(ids)}",
         None if random.random() < 0.1 else f"n{random.randrange(ids)}") for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_features_match_a_replay(log, seed):
    data = random_log(log, seed)
    got = node_features(pairs_of(log(*data)), burst_run=3, burst_within_us=90_000).collect()
    found = {(r.window_start, r.node_id): r for r in got}
    by_window = {}
    for s, kind, subject, target in data:
        by_window.setdefault(int(s), []).append((s, kind, subject, target))
    checked = 0
    for second, events in by_window.items():
        roles, edges = replay.window_graph(events)
        centre = replay.centralities(list(roles), list(edges))
        for v, role in roles.items():
            row = found[T0 + timedelta(seconds=second), v]
            outs = [edges[e] for e in edges if e[0] == v]
            degree_in = sum(1 for e in edges if e[1] == v)
            degree = degree_in + len(outs)
            offset = 10 * 3600
            var, gap, span, burst, entropy, sine, cosine = replay.temporal(
                [ts + offset for _, ts in outs], 0, run=3, within=0.09)
            close, between, rank, cluster = centre[v]
            expected = dict(
                node_type_flag=int(role == "subject"), degree=degree, in_degree=degree_in,
                out_degree=len(outs), event_count=degree,
                event_type_count=len({k for k, _ in outs}), ts_var=var, closeness=close,
                betweenness=between, pagerank=rank, cluster_coeff=cluster, avg_ts_gap=gap,
                last_seen_delta=span, burst_flag=burst, activity_rate=degree,
                temporal_entropy=entropy, time_sin=sine, time_cos=cosine)
            for name, value in expected.items():
                assert row[name] == pytest.approx(value, abs=1e-9), (name, v)
            checked += 1
    assert checked == len(got)


def test_feature_vector_order(log):
    vectors = feature_vector(node_features(pairs_of(log((0.1, "READ", "a", "b"))))).collect()
    for row in vectors:
        assert len(row.features) == 18
        assert row.features[NODE_FEATURES.index("pagerank")] == row.pagerank
