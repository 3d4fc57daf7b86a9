import random
from datetime import timedelta

from hostweave.functions.timefn import from_micros
from hostweave.operators import clean, lineage
from tests.conftest import T0, rows

TREE = "uuid string, parent_subject string"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_interval_includes_both_ends(log):
    events = log((0, "READ", "a", "x"), (5, "READ", "a", "x"), (9, "READ", "a", "x"), (9.001, "READ", "a", "x"))
    assert rows(lineage.events_between(events, at(5), at(9)), "ordinal") == [(1,), (2,)]


def test_ancestry_and_cycles(spark):
    tree = spark.createDataFrame(
        [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s")], TREE)
    assert rows(lineage.ancestry(tree), "uuid", "ancestor", "depth") == [
        ("b", "a", 1), ("c", "a", 2), ("c", "b", 1), ("x", "y", 1), ("y", "x", 1),
        ("z", "x", 1), ("z", "y", 2)]
    only = lineage.ancestry(tree, spark.createDataFrame([("c",)], "uuid string"))
    assert rows(only, "ancestor", "depth") == [("a", 2), ("b", 1)]
    below = lineage.descent(tree, spark.createDataFrame([("a",), ("x",)], "uuid string"))
    assert rows(below, "root", "uuid", "depth") == [
        ("a", "b", 1), ("a", "c", 2), ("x", "y", 1), ("x", "z", 1)]


def test_reads_before_sends(log):
    data, random_ = [], random.Random(3)
    for i in range(400):
        kind = random_.choice(["READ", "SENDTO", "SENDMSG", "OPEN"])
        subject = "hot" if random_.random() < 0.6 else f"s{random_.randrange(5)}"
        data.append((random_.randrange(0, 900_000, 1000) / 1000, kind, subject, "x"))
    want = []
    for i, (s, kind, subject, _) in enumerate(data):
        reads = [t for j, (t, k, b, _) in enumerate(data)
                 if k == "READ" and b == subject and (t < s or (t == s and j < i))]
        if kind.startswith("SEND") and reads and round((s - max(reads)) * 1e6) <= 7_000_000:
            want.append((i, round(s - max(reads), 6)))
    got = lineage.read_then_send(log(*data), 7_000_000)
    assert sorted((r.ordinal, round(r.lag_s, 6)) for r in got.collect()) == sorted(want)


def test_forward_reach_respects_time(log):
    events = log((5, "READ", "a", "b"), (3, "READ", "b", "c"), (7, "READ", "b", "d"),
                 (9, "READ", "d", "c"), (8, "READ", "d", "a"), (4, "READ", "e", "f"), (6, "READ", "a", "b"))
    got = lineage.forward_reach(events, "a").withColumn("t", from_micros("reached_us"))
    # c is reached through d at 9; the earlier edge b -> c came before a -> b.
    assert rows(got, "node", "t", "hops") == [("b", at(5), 1), ("c", at(9), 3), ("d", at(7), 2)]


def test_triggers_connections_actions_and_run_keys(spark, log):
    events = log((0, "EXECUTE", "a", "f1"), (1, "WRITE", "a", "k1"), (2, "WRITE", "b", "k2"),
                 (3, "SENDTO", "a", "f1"), (4, "READ", "b", "k1"))
    subjects = spark.createDataFrame(
        [("a", "SUBJECT_PROCESS", 5, None, T0)],
        "uuid string, type string, cid int, parent_subject string, start_timestamp timestamp_ntz")
    assert rows(lineage.trigger_events(events, subjects), "ordinal", "cid") == [(0, 5)]
    flows = spark.createDataFrame([("f1", "r", 53)], "uuid string, remote_address string, remote_port int")
    assert rows(lineage.connections(events, flows), "subject", "flow", "n_events") == [("a", "f1", 2)]
    assert rows(lineage.subject_actions(events, "b"), "type", "n_events") == [
        ("EVENT_READ", 1), ("EVENT_WRITE", 1)]
    keys = spark.createDataFrame(
        [("k1", r"\REGISTRY\Software\Microsoft\Windows\CurrentVersion\Run\x"),
         ("k2", r"\REGISTRY\Software\Microsoft\Windows\CurrentVersion\Runtime\x")], "uuid string, key string")
    assert rows(lineage.run_key_writes(events, keys), "ordinal") == [(1,)]


def test_duplicate_records(spark):
    feed = spark.createDataFrame([("e1", 1), ("e1", 1), ("e2", 2)], "uuid string, n int")
    assert rows(clean.drop_duplicate_records(feed)) == [("e1", 1), ("e2", 2)]


def test_long_process_chain(spark):
    """A chain is followed to its end, however long it is."""
    chain = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(30)], "uuid string, parent_subject string")
    start = spark.createDataFrame([("p0",)], "uuid string")
    assert lineage.ancestry(chain, start).count() == 30
