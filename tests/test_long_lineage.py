"""Long chains, cycles, hubs and slices of time."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hostweave.functions import hubs
from hostweave.functions.durable import durable
from hostweave.operators import lineage
from tests.conftest import T0, rows

TREE = "uuid string, parent_subject string"


def walks(parent):
    """(node, ancestor, depth) by following parents one by one."""
    for v in parent:
        at, seen = v, {v}
        while (at := parent.get(at)) is not None and at not in seen:
            seen.add(at)
            yield v, at, len(seen) - 1


def random_parents(seed):
    r = random.Random(seed)
    n = r.randint(1, 40)
    return {f"p{i}": r.choice([None, f"p{r.randrange(n)}", f"p{i // 2}", f"p{max(0, i - 1)}", "gone"]) for i in range(n)}


@pytest.mark.parametrize("seed", range(8))
def test_trees_with_cycles_and_lost_parents(spark, seed):
    """Random parents: several cycles, tails into them, self-parents, parents without a record."""
    parent = random_parents(seed)
    tree = spark.createDataFrame(list(parent.items()), TREE)
    want = sorted(walks({k: v for k, v in parent.items() if v != k}))
    assert rows(lineage.ancestry(tree), "uuid", "ancestor", "depth") == want
    chosen = ["p0", "p1", "gone", "absent"]
    starting = spark.createDataFrame([(c,) for c in chosen], "uuid string")
    assert rows(lineage.ancestry(tree, starting), "uuid", "ancestor", "depth") == [w for w in want if w[0] in chosen]
    below = lineage.descent(tree, starting)
    assert rows(below, "root", "uuid", "depth") == sorted((a, v, d) for v, a, d in want if a in chosen)


def test_chain_of_100_000_processes(spark, monkeypatch):
    n = 100_000
    chain = spark.range(n).select(
        F.concat(F.lit("p"), "id").alias("uuid"), F.concat(F.lit("p"), F.col("id") + 1).alias("parent_subject"))
    rounds = []
    monkeypatch.setattr(lineage, "durable", lambda df: rounds.append(1) or durable(df))
    got = lineage.ancestry(chain, spark.createDataFrame([("p0",)], "uuid string"))
    assert got.agg(F.count(F.lit(1)), F.max("depth"), F.count_distinct("ancestor")).first()[:] == (n, n, n)
    assert len(rounds) <= 2 * 20 and "path" not in got.columns
    assert lineage.descent(chain, spark.createDataFrame([(f"p{n}",)], "uuid string")).count() == n


def test_several_named_parents(spark):
    tree = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), ("x", "top"), ("a", "x")], TREE)
    assert rows(lineage.ancestry(tree), "uuid", "ancestor", "depth") == [("a", "top", 2), ("a", "x", 1), ("x", "top", 1)]


def reach(links, start):
    """Earliest time and fewest events to get there, over all ways that follow time."""
    at = {start: {(float("-inf"), 0)}}
    while True:
        fresh = {k: set(v) for k, v in at.items()}
        for a, b, t in links:
            if a != b:
                fresh.setdefault(b, set()).update((t, n + 1) for s, n in at.get(a, ()) if t >= s and n < 30)
        if fresh == at:
            return {k: min(v) for k, v in at.items() if v and k != start}
        at = fresh


@pytest.mark.parametrize("seed, options", [
    (0, {}), (1, {"slice_rows": 40}), (2, {"slice_rows": 1}), (3, {"slice_rows": 60, "hub_rows": 5}), (4, {"hub_rows": 1})])
def test_reach_by_slices(log, seed, options):
    r = random.Random(seed)
    links = [("hub" if r.random() < 0.3 else f"n{r.randrange(25)}", f"n{r.randrange(25)}", r.randrange(60)) for _ in range(200)]
    got = lineage.forward_reach(log(*[(t, "READ", a, b) for a, b, t in links]), "n1", **options)
    want = reach(links, "n1")
    base = got.select("reached_us", "node", "hops").collect()
    zero = int((T0 - T0.replace(year=1970, month=1, day=1, hour=0, minute=0, second=0)).total_seconds()) * 1_000_000
    assert {x.node: (x.reached_us - zero) / 1e6 for x in base} == {k: t for k, (t, _) in want.items()} and len(want) > 5
    assert all(x.hops >= want[x.node][1] for x in base)


def test_links_are_not_moved(spark, log):
    """No exchange above the scan of the links, and only the slice in question is read."""
    events = log(*[(i, "READ", f"n{i % 50}", f"n{i % 7}") for i in range(400)])
    links = lineage._SlicedLinks(events, 100, 1000)
    assert len(links.slices) == 4
    front = durable(spark.range(40).select(F.concat(F.lit("n"), "id").alias("node"), F.struct(
        F.lit(0).cast("bigint").alias("us"), F.lit(0).alias("hops")).alias("label")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        arrived = links.arrivals(front, 2)
        plan = arrived._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and links.name in line)
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    above, at = [], depth[scan]
    for i in range(scan, -1, -1):
        if depth[i] < at:
            above.append(lines[i])
            at = depth[i]
        if "SortMergeJoin" in lines[i] and depth[i] < depth[scan]:
            break
    assert not any("Exchange" in line for line in above[:above.index(next(x for x in above if "SortMergeJoin" in x))])
    assert "Bucketed: true" in lines[scan] and "slice" in lines[scan].split("PartitionFilters")[1]
    links.close()


def test_hubs_are_dealt_and_others_stay(spark):
    edges = spark.range(10_000).select(
        F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("n"), F.col("id") % 500)).alias("k"), "id")
    found = hubs.hub_parts(edges, ["k"], least=400)
    assert [tuple(x) for x in found.collect()] == [("hub", 9)]
    parts = hubs.dealt(edges, found, ["k"], F.col("id")).groupBy("k", "__part").count()
    assert parts.filter("k = 'hub'").agg(F.count(F.lit(1)), F.max("count")).first()[0] == 9
    assert parts.filter("k = 'hub'").agg(F.max("count")).first()[0] < 2 * 3334 / 9
    assert parts.filter("k <> 'hub' AND __part > 0").isEmpty()
    values = spark.createDataFrame([("hub", 1), ("n1", 2), ("other", 3)], "k string, v int")
    assert hubs.repeated(values, found, ["k"]).count() == 11
    joined = hubs.dealt(edges, found, ["k"], F.col("id")).join(hubs.repeated(values, found, ["k"]), ["k", "__part"])
    assert joined.count() == edges.join(values, "k").count()
    assert hubs.hub_parts(edges, ["k"], least=1, most=100).count() == 1
