import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hostweave.operators import graph, sliding, windows
from tests.conftest import rows

VALUES = {"n": "sum", "low": "min", "best": "max"}
SCHEMA = "window_start timestamp_ntz, k string, n bigint, low double, best struct<o: bigint, t: string>"
EPOCH = datetime(1970, 1, 1)


def panes(seed, keys, size, share, zero=EPOCH):
    """At most one pane a key and second, in no order; one key is in most of them."""
    r = random.Random(seed)
    made = [(zero + timedelta(seconds=p), k, r.randint(1, 9), r.choice([None, r.random()]), (r.randrange(10**6), f"t{p}"))
            for p in range(size) for k in keys if r.random() < (0.8 if k == "hot" else share)]
    r.shuffle(made)
    return made


def brute(made, n):
    out = []
    for start in {m[0] for m in made}:
        held = {}
        for m in made:
            if start <= m[0] < start + timedelta(seconds=n):
                held.setdefault(m[1], []).append(m)
        for k, own in held.items():
            lows = [m[3] for m in own if m[3] is not None]
            out.append((start, k, sum(m[2] for m in own), min(lows) if lows else None, max(m[4] for m in own)))
    return out


def key(row):
    return (row[0], row[1] is not None, row[1] or "")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20, 60, 500])
def test_equal_to_every_pane_in_every_window(spark, n):
    made = panes(n, ["hot", "a", "b", None], 130, 0.1, EPOCH - timedelta(seconds=40))
    got = sliding.sliding(spark.createDataFrame(made, SCHEMA), ["k"], VALUES, n).collect()
    assert sorted([(r.window_start, r.k, r.n, r.low, tuple(r.best)) for r in got], key=key) == sorted(brute(made, n), key=key)


def test_rows_do_not_grow_with_the_window(spark):
    df = spark.createDataFrame(panes(1, ["hot", "a", "b"], 900, 0.3), SCHEMA).cache()
    total = df.count()
    for n in (3, 30, 300, 3000):
        made = sliding.changes(sliding.numbered_panes(df, "window_start", 1, n), ["k"], VALUES, n).count()
        assert total <= made <= 3 * total
    df.unpersist()


def test_plan_has_no_copies_before_the_last_shuffle(spark):
    """The only row generators are the three change rows of a pane, the time line and the result itself."""
    df = spark.createDataFrame(panes(2, ["a"], 50, 0.5), SCHEMA)
    plan = sliding.sliding(df, ["k"], VALUES, 300)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 3


def test_statistics_equal_windows_over_events(log):
    r = random.Random(3)
    events = log(*[(r.choice([r.random() * 40, r.random() * 4000]), "READ", "a", "x") for _ in range(300)])
    for seconds, step in ((6, 1), (10, 5), (600, 60)):
        direct = windows.with_overlapping_windows(events, seconds, step).groupBy("window_start", "window_end").agg(
            F.count(F.lit(1)).alias("n_events"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"))
        columns = ["window_start", "window_end", "n_events", "first_ordinal", "last_ordinal"]
        assert rows(windows.overlapping_statistics(events, seconds, step), *columns) == rows(direct, *columns)
    with pytest.raises(ValueError):
        windows.overlapping_statistics(events, 5, 2)


def test_pairs_equal_interactions_over_events(log):
    r = random.Random(4)
    events = log(*[(r.random() * 30, r.choice(["READ", "WRITE", "OPEN"]), r.choice("abc"), r.choice(["a", "x", None]))
                   for _ in range(400)])
    direct = graph.interactions(windows.with_overlapping_windows(events, 9))
    merged = graph.overlapping_interactions(graph.interactions(windows.with_tumbling_window(events)), 9)
    columns = ["window_start", "subject", "object", "event", "ts", "n_events", "first_ts", "last_ts", "first_ordinal", "last_ordinal"]
    found = [sorted((tuple(x) for x in df.select(columns).collect()), key=str) for df in (direct, merged)]
    assert found[0] == found[1] and len(found[0]) > 200


def test_no_panes(spark):
    assert sliding.sliding(spark.createDataFrame([], SCHEMA), ["k"], VALUES, 5).collect() == []
