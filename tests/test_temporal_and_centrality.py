import random

import pytest
from pyspark.sql import functions as F

from hostweave.operators import centrality as c, graph, temporal, windows
from tests import replay
from tests.conftest import rows


def ticks(log, *seconds):
    events = log(*[(s, "READ", "a", f"x{i}") for i, s in enumerate(seconds)])
    pairs = graph.interactions(windows.with_tumbling_window(events, 60))
    return temporal.out_ticks(graph.edges(pairs))


@pytest.mark.parametrize("seconds, flagged", [
    ([0.01 * i for i in range(5)], 0), ([0.01 * i for i in range(6)], 1),
    ([0.04 * i for i in range(6)], 0),                       # exactly 0.2 s
    ([0.9 + 0.035 * i for i in range(6)], 1),                # crosses into the next second
    ([0.5] * 6, 1), ([0.5] * 5, 0), ([0.5] * 5 + [0.69], 1), ([0.95] * 3 + [1.1] * 3, 1),
    ([0.5] * 5 + [1.2] * 5, 0)])
def test_burst_rule(log, seconds, flagged):
    assert temporal.bursts(ticks(log, *seconds)).count() == flagged


def test_entropy_of_one_instant_and_of_even_gaps(log):
    assert temporal.gap_entropy(ticks(log, 1, 1, 1)).count() == 0
    value = temporal.gap_entropy(ticks(log, 0, 10, 20, 20, 30, 40)).first().temporal_entropy
    assert value == pytest.approx(replay.temporal([0, 10, 20, 20, 30, 40], 0)[4], abs=1e-12)


def random_pairs(spark, seed, sizes):
    """One window per (nodes, edges); some nodes isolated."""
    random.seed(seed)
    data = []
    for w, (n, m) in enumerate(sizes):
        links = {(random.randrange(n), random.randrange(n)) for _ in range(m)}
        data += [(w, f"n{a}", f"n{b}") for a, b in links]
        data += [(w, f"n{v}", None) for v in range(n)]
    return spark.createDataFrame(data, "w int, subject string, object string").select(
        F.timestamp_add("HOUR", F.col("w"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("window_start"),
        "subject", "object")


def links_of(pairs):
    return pairs.filter("object IS NOT NULL").select(
        "window_start", F.col("subject").alias("source"), F.col("object").alias("target"))


def as_dict(df):
    return {(r.window_start.hour, r.node_id): (r.closeness, r.betweenness, r.pagerank, r.cluster_coeff)
            for r in df.collect()}


def assert_close(got, want):
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1e-9), key


@pytest.mark.parametrize("options", [
    {},                                                     # whole windows in tasks
    {"task_work": 300},                                     # sources spread over tasks
    {"task_pairs": 22, "block_rows": 200},                  # larger windows by joins, many blocks
    {"task_pairs": 0}])                                     # every window by joins
def test_every_route_matches_brute_force(spark, options):
    sizes = [(1, 0), (1, 1), (2, 1), (3, 0), (8, 12), (12, 20), (14, 35)]
    pairs = random_pairs(spark, 3, sizes)
    got = as_dict(c.centrality(pairs, **options))
    for w, (n, _) in enumerate(sizes):
        links = [(r.subject, r.object) for r in pairs.collect()
                 if r.window_start.hour == w and r.object is not None]
        for v, want in replay.centralities([f"n{i}" for i in range(n)], links).items():
            assert got[w, v] == pytest.approx(want, abs=1e-9), (w, v, options)
    assert len(got) == sum(n for n, _ in sizes)


def test_small_batches_and_cells(spark, monkeypatch):
    pairs = random_pairs(spark, 9, [(9, 20), (12, 30), (5, 9), (30, 80)])
    whole = as_dict(c.centrality(pairs))
    monkeypatch.setattr(c, "BATCH_PAIRS", 3)
    monkeypatch.setattr(c.kernels, "path_sums", lambda b, s: PATH_SUMS(b, s, 50))
    assert_close(as_dict(c.centrality(pairs)), whole)


PATH_SUMS = c.kernels.path_sums


def test_dangling_nodes_share_rank_evenly(spark):
    got = as_dict(c.centrality(random_pairs(spark, 0, [(4, 0)])))
    assert {v[2] for v in got.values()} == {0.25}


def test_hub_window(spark):
    """A star: one node has every edge; routes must agree on it too."""
    data = [(f"s{i}", "hub") for i in range(150)] + [("hub", f"t{i}") for i in range(150)]
    pairs = spark.createDataFrame(data, "subject string, object string").withColumn(
        "window_start", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    a = as_dict(c.centrality(pairs))
    b = as_dict(c.centrality(pairs, task_pairs=10))
    assert_close(a, b)
    assert a[0, "hub"][1] == pytest.approx(150 * 150 / (300 * 299))


def test_wide_clustering(spark):
    pairs = random_pairs(spark, 4, [(12, 50), (6, 20)])
    want = {k: v[3] for k, v in as_dict(c.centrality(pairs)).items()}
    got = {(r.window_start.hour, r.node_id): r.cluster_coeff
           for r in c.wide_clustering(links_of(pairs)).collect()}
    assert got == pytest.approx({k: want[k] for k in got})


def test_sizes(spark):
    assert [r.n_pairs for r in c.window_sizes(random_pairs(spark, 0, [(2, 0)])).collect()] == [2]
    assert rows(graph.undirected(links_of(random_pairs(spark, 0, [(2, 0)])))) == []


def leafy_pairs(spark, seed):
    """Windows of mostly sources, leaves and twins around a small core, as provenance graphs are."""
    r = random.Random(seed)
    data = []
    for w in range(6):
        core = [f"c{i}" for i in range(r.randint(1, 5))]
        data += [(w, r.choice(core), r.choice(core)) for _ in range(r.randint(0, 8))]
        data += [(w, f"s{i}", c) for i in range(r.randint(0, 8)) for c in r.sample(core, r.randint(1, min(2, len(core))))]
        data += [(w, c, f"t{i}") for i in range(r.randint(0, 8)) for c in r.sample(core, r.randint(1, min(2, len(core))))]
        data += [(w, "pair", "end"), (w, "a", "b"), (w, "b", "c"), (w, "alone", None), (w, "self", "self")]
    return spark.createDataFrame(sorted(set(data), key=str), "w int, subject string, object string").select(
        F.timestamp_add("HOUR", F.col("w"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("window_start"),
        "subject", "object")


@pytest.mark.parametrize("options", [{}, {"task_work": 100}, {"task_pairs": 0}, {"task_pairs": 0, "block_rows": 20}])
def test_leaves_and_twins_are_folded_exactly(spark, options):
    pairs = leafy_pairs(spark, 5)
    data = [(r.window_start.hour, r.subject, r.object) for r in pairs.collect()]
    got = as_dict(c.centrality(pairs, **options))
    for w in range(6):
        names = {v for x, a, b in data if x == w for v in (a, b) if v is not None}
        for v, want in replay.centralities(sorted(names), [(a, b) for x, a, b in data if x == w and b is not None]).items():
            assert got[w, v] == pytest.approx(want, abs=1e-9), (w, v, options)


def test_kernel_against_plain_search():
    """Path sums of many small graphs, whole and in slices."""
    import numpy as np

    r = random.Random(0)
    for trial in range(300):
        n, m, core = r.randint(1, 12), r.randint(0, 24), r.randint(1, 4)
        links = sorted({(r.randrange(n), r.randrange(min(n, core))) if r.random() < .5 else (r.randrange(min(n, core)), r.randrange(n))
                        for _ in range(m)})
        want = replay.centralities(list(range(n)), links)
        source, target = (np.array([x[i] for x in links], dtype=np.int64) for i in (0, 1))
        batch = c.kernels.Batch(np.zeros(n, dtype=np.int64), source, target)
        sums = [c.kernels.path_sums(batch, np.flatnonzero(np.arange(n) % 2 == i), r.choice([1, 50])) for i in (0, 1)]
        dependency, reached, distance = (a + b for a, b in zip(*sums))
        for v in range(n):
            close = reached[v] / distance[v] * reached[v] / (n - 1) if distance[v] else 0.0
            between = dependency[v] / ((n - 1) * (n - 2)) if n > 2 else 0.0
            assert (close, between) == (pytest.approx(want[v][0]), pytest.approx(want[v][1])), (trial, v)


def test_twins_need_equal_lists():
    import numpy as np

    start, degree = np.array([0, 2, 4, 6]), np.array([2, 2, 2, 1])
    twins = c.kernels.Twins(np.arange(4), start, degree, np.array([5, 6, 5, 6, 5, 7, 5]), 8)
    assert twins.first.tolist() == [0, 0, 2, 3, 4, 5, 6, 7] and twins.times[:4].tolist() == [2, 0, 1, 1]


def test_levels_carry_64_roots_in_a_row(spark):
    """A layered graph: every level has a row for each word and node, not for each root and node."""
    data = [(f"r{i}", f"m{j}") for i in range(640) for j in range(2)] + [
        (f"m{j}", f"x{k}") for j in range(2) for k in range(3)] + [(f"x{k}", f"y{k}{j}") for k in range(3) for j in range(2)] + [
        (f"y{k}{j}", "z") for k in range(3) for j in range(2)] + [(f"r{i}", f"q{i % 7}{i}") for i in range(640)] + [
        (f"q{i % 7}{i}", "m0") for i in range(640)]
    edge_rows = spark.createDataFrame(data, "source string, target string").withColumn(
        "window_start", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    small = c._Reduced(edge_rows)
    levels = c.reach_masks(small)
    reached = [level.agg(F.sum(F.bit_count("mask")), F.count(F.lit(1))).first() for level in levels]
    for cells, n in reached[1:]:
        assert n <= cells / 8, reached


@pytest.mark.parametrize("options", [
    {"task_pairs": 0, "core_pairs": 0},                     # cores by joins too
    {"task_pairs": 0, "core_pairs": 0, "block_rows": 20},
    {"task_pairs": 0, "task_work": 60}, {"task_work": 60}])  # starts and core nodes spread over many tasks
def test_cut_windows_match_brute_force(spark, options):
    """Starts in several parts: leaves, tails and twins of one part are not those of the window."""
    random.seed(11)
    data = [(0, f"s{i}", f"c{t}") for i in range(12) for t in random.sample(range(5), 1 + i % 3)]
    data += [(0, f"c{a}", f"c{b}") for a, b in [(0, 1), (1, 2), (2, 0), (1, 3), (3, 3)]]
    data += [(0, f"c{a}", f"t{b}") for a in (0, 1, 3) for b in (0, 1)] + [(0, "c2", "leaf"), (0, "s0", "t0")]
    data += [(0, f"s{i}", f"only{i % 2}") for i in range(4)] + [(0, "alone", None), (0, "self", "self")]
    data += [(1, f"s{i}", f"o{i % 2}") for i in range(9)] + [(2, "s", "s"), (2, "z", None)]
    data = sorted(set(data), key=str)
    pairs = spark.createDataFrame(data, "w int, subject string, object string").select(
        F.timestamp_add("HOUR", F.col("w"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("window_start"),
        "subject", "object")
    got = as_dict(c.centrality(pairs, **options))
    for w in range(3):
        names = sorted({v for x, a, b in data if x == w for v in (a, b) if v is not None})
        for v, want in replay.centralities(names, [(a, b) for x, a, b in data if x == w and b is not None]).items():
            assert got.pop((w, v)) == pytest.approx(want, abs=1e-9), (w, v, options)
    assert not got


def test_costly_windows_are_not_copied(spark, monkeypatch):
    """Links of starts are in one task each; PageRank and clustering have every window once."""
    data = [(f"s{i}", f"c{(i + j) % 4}") for i in range(60) for j in range(2)] + [(f"c{i}", f"c{(i + 1) % 4}") for i in range(4)]
    pairs = spark.createDataFrame(data, "subject string, object string").withColumn(
        "window_start", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    taken, whole = [], c._in_tasks

    def counted(parts, measures):
        taken.append((parts.count(), parts.select("slice").distinct().count(), measures))
        return whole(parts, measures)

    monkeypatch.setattr(c, "_in_tasks", counted)
    assert c.centrality(pairs, task_work=100).count() == 64
    (n, slices, light), (cut, parts, paths) = taken
    assert (n, slices, light) == (124, 1, {"pagerank", "cluster_coeff"})
    assert parts > 1 and cut <= 120 + 4 * 5 and paths == {"closeness", "betweenness"}
    for measure in ("pagerank", "cluster_coeff"):
        taken.clear()
        assert c.centrality(pairs, task_work=100, measures=[measure]).count() == 64
        assert taken == [(124, 1, {measure})]


def test_pagerank_rounds_leave_sources_out(spark, monkeypatch):
    """One row stands for all nodes without incoming links."""
    data = [(f"s{i}", f"c{i % 3}") for i in range(90)] + [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("c0", "t")]
    pairs = spark.createDataFrame(data, "subject string, object string").withColumn(
        "window_start", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    sizes, cut = [], c.durable

    def counted(df):
        out = cut(df)
        if "fresh" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(c, "durable", counted)
    got = as_dict(c.centrality(pairs, task_pairs=0, measures=list(c.MEASURES)))
    want = replay.centralities(sorted({v for p in data for v in p}), data)
    for v, values in want.items():
        assert got[0, v] == pytest.approx(values, abs=1e-9), v
    assert set(sizes) == {5}
