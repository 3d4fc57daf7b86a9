import math

import pytest
from pyspark.sql import functions as F

from hostweave.functions import hubs
from hostweave.operators import propagation, scoring, sequences, story
from hostweave.sources import explanations
from tests.conftest import T0, rows


def labels(spark, *values):
    return spark.createDataFrame(
        list(enumerate(values)), "window_id bigint, label int").withColumn(
        "window_start", F.timestamp_add("HOUR", F.col("window_id"), F.lit(T0).cast("timestamp_ntz")))


def test_sequences_over_nonempty_windows(spark):
    steps = sequences.sequence_steps(labels(spark, 0, 0, 0, 1))
    got = sequences.sequences(steps)
    assert [(r.sequence_id, r.window_ids, r.label) for r in got.orderBy("sequence_id").collect()] == [
        (0, [0, 1, 2], 0), (1, [1, 2, 3], 1)]
    assert rows(sequences.centre_windows(steps)) == [(0, 1), (1, 2)]


@pytest.mark.parametrize("n, expected", [(2, 0), (3, 1), (10, 8)])
def test_number_of_sequences(spark, n, expected):
    steps = sequences.sequence_steps(labels(spark, *[0] * n))
    assert sequences.sequences(steps).count() == expected


def test_attention_is_a_softmax(spark):
    steps = spark.createDataFrame(
        [(0, 0, 1, 1.0), (0, 1, 0, 2.0), (0, 2, 0, 4.0)], "sequence_id int, step int, label int, a double")
    got = propagation.temporal_attention(steps, {"a": 0.5}, 1.0)
    scores = [1.5, 2.0, 3.0]
    total = sum(map(math.exp, scores))
    weights = [r.weight for r in got.orderBy("step").collect()]
    assert weights == pytest.approx([math.exp(s) / total for s in scores])
    row = propagation.attended_embedding(got, ["a"]).first()
    assert row.label == 1
    assert row.a == pytest.approx(sum(w * v for w, v in zip(weights, [1.0, 2.0, 4.0])))


def test_neighbour_means(spark):
    key = F.lit(T0).cast("timestamp_ntz")
    nodes = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 8.0)], "node_id string, v double").withColumn(
        "window_start", key)
    edges = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "a")], "source string, target string").withColumn(
        "window_start", key)
    got = propagation.neighbour_means(nodes, edges, ["v"], hops=2)
    assert rows(got, "node_id", "v", "v_h1", "v_h2") == [
        ("a", 1.0, 8.0, 2.0), ("b", 3.0, 0.0, 0.0), ("c", 8.0, 2.0, 4.0)]


def test_hubs_are_dealt_over_parts(spark):
    """A star out of ``hub`` and one into ``sink``: no part holds much more than the limit."""
    key = F.lit(T0).cast("timestamp_ntz")
    leaf = F.concat(F.lit("x"), F.col("id"))
    edges = spark.range(5_000).select(F.lit("hub").alias("source"), leaf.alias("target")).unionByName(
        spark.range(5_000).select(leaf.alias("source"), F.lit("sink").alias("target"))).withColumn("window_start", key)
    nodes = spark.range(5_000).select(leaf.alias("node_id"), F.col("id").cast("double").alias("v")).unionByName(
        spark.createDataFrame([("hub", 3.0), ("sink", 7.0)], "node_id string, v double")).withColumn("window_start", key)
    keys = ["window_start", "source"]
    found = hubs.hub_parts(edges, keys, 100)
    assert rows(found, "source", "__parts") == [("hub", 50)]
    sizes = hubs.dealt(edges, found, keys, F.col("target")).filter("source = 'hub'").groupBy("__part").count()
    assert sizes.count() == 50 and sizes.agg(F.max("count")).first()[0] < 200
    plain = propagation.neighbour_means(nodes, edges, ["v"], hops=2)
    split = propagation.neighbour_means(nodes, edges, ["v"], hops=2, hub_edges=100)
    assert rows(plain) == rows(split)
    ends = {r.node_id: (r.v_h1, r.v_h2) for r in split.filter("node_id in ('hub', 'sink', 'x7')").collect()}
    assert ends == {"hub": (0.0, 0.0), "sink": (2499.5, 3.0), "x7": (3.0, 0.0)}


def test_importance_equals_leaving_the_node_out(spark):
    values = [1.0, 5.0, 9.0]
    nodes = spark.createDataFrame(
        [("w", f"n{i}", v) for i, v in enumerate(values)] + [("u", "single", 3.0)],
        "window_start string, node_id string, a double")
    got = scoring.node_importance(nodes, propagation.graph_embedding(nodes, ["a"]), {"a": 2.0})
    found = {r.node_id: r.importance for r in got.collect()}
    mean = sum(values) / 3
    for i, v in enumerate(values):
        rest = (sum(values) - v) / 2
        assert found[f"n{i}"] == pytest.approx(abs(2.0 * (mean - rest)))
    assert found["single"] == 0.0


def test_split_is_exact_and_stable(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    split = scoring.stratified_split(df, "id", seed=1)
    assert rows(split.groupBy("label", "split").count()) == [
        (0, "test", 180, ), (0, "train", 720), (1, "test", 20), (1, "train", 80)]
    again = scoring.stratified_split(df.repartition(5), "id", seed=1)
    assert rows(split, "id", "split") == rows(again, "id", "split")
    assert rows(split, "id", "split") != rows(scoring.stratified_split(df, "id", seed=2), "id", "split")
    ordered = scoring.stratified_split(df, "id", time_order=True)
    edge = ordered.groupBy("label", "split").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    assert {(r.label, r.split): (r.lo, r.hi) for r in edge.collect()}[1, "train"] == (0, 790)


@pytest.mark.parametrize("kind", ["logistic", "trees"])
def test_classifier_separates_and_scores(spark, kind):
    df = spark.range(200).select(
        F.col("id").alias("sequence_id"), (F.col("id") >= 100).cast("int").alias("label"),
        (F.col("id") / 10.0).alias("a"), (F.rand(3) * 5).alias("b"))
    model = scoring.train_classifier(df, ["a", "b"], kind)
    row = scoring.evaluation(scoring.score_sequences(model, df)).first()
    assert row.n_rows == 200 and row.accuracy > 0.95 and row.recall > 0.95


def test_given_coefficients(spark):
    values = [(1, 0, 0.5, -2.0), (2, 1, 3.0, 1.0), (3, 1, None, 1.0)]
    df = spark.createDataFrame(values, "sequence_id int, label int, a double, b double")
    got = {r.sequence_id: r for r in scoring.score_linear(df, {"a": 1.5, "b": -0.25}, 0.1, 0.9).collect()}
    for i, label, a, b in values[:2]:
        score = 1 / (1 + math.exp(-(0.1 + 1.5 * a - 0.25 * b)))
        assert got[i].score == pytest.approx(score) and (got[i].label, got[i].prediction) == (label, int(score > 0.9))
    assert got[3].score is None and got[3].prediction is None


def test_evaluation_and_weights(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1)], "label int, prediction int")
    row = scoring.evaluation(df).first()
    assert (row.accuracy, row.precision, row.recall) == (0.5, 0.5, 0.5)
    assert scoring.evaluation(df.filter("prediction = 0")).first().precision is None
    assert rows(scoring.with_class_weight(df), "label", "class_weight")[0] == (0, 0.3)


def story_tables(spark):
    attention = spark.createDataFrame(
        [(0, 1, 0.3), (0, 0, 0.2), (0, 2, 0.5), (1, 0, 0.6), (1, 1, 0.3), (1, 2, 0.1)],
        "sequence_id bigint, step int, weight double")
    importance = spark.createDataFrame(
        [(0, 0, T0, "a", 0.01, 0), (0, 1, T0, "b", 0.2, 0), (0, 2, T0, "c", 0.05, 0), (0, 2, T0, "d", 0.04, 1),
         (1, 0, T0, "a", 0.01, 0)],
        "sequence_id bigint, step int, window_start timestamp_ntz, node_id string, importance double, node_idx bigint")
    predictions = spark.createDataFrame([(0, 1), (1, 0)], "sequence_id bigint, prediction int")
    return predictions, attention, importance


def test_stories(spark):
    got = {r.sequence_id: r for r in story.stories(*story_tables(spark)).collect()}
    # Severity takes the last step's weight from the flat array of weights.
    assert got[0].severity == 0.5 and got[1].severity == 0.03
    assert got[0].techniques == ["T1059 Command Execution"] and got[1].techniques == []
    assert got[0].story == (
        "Sequence 0 is classified as MALICIOUS.\n"
        "Highest importance occurred at timestep with weight 0.500.\n"
        "Severity Score: 0.5.\nPossible MITRE Techniques: T1059 Command Execution.")
    assert got[1].story.endswith("Possible MITRE Techniques: None detected.")


def test_top_nodes_and_hot_nodes(spark):
    _, _, importance = story_tables(spark)
    nodes = importance.select("window_start", "node_id").distinct().withColumn("node_type", F.lit("subject"))
    got = story.top_nodes(importance, nodes, 2).filter("sequence_id = 0")
    assert rows(got, "rank", "node_id", "score_text") == [(1, "b", "20.00%"), (2, "c", "5.00%")]
    one = importance.filter("sequence_id = 0")
    assert rows(story.hot_nodes(one), "node_id") == [("b",)]
    none = one.withColumn("importance", F.lit(0.0))
    assert story.hot_nodes(none).count() == 0


def test_explanation_documents_round_trip(spark, tmp_path):
    predictions, attention, importance = story_tables(spark)
    for size in (100_000, 1):
        docs = explanations.explanation_documents(predictions, attention, importance, part_rows=size)
        path = str(tmp_path / f"docs{size}")
        explanations.write_explanations(docs, path)
        back = explanations.read_explanations(spark, path)
        assert rows(explanations.importance_rows(back, size)) == rows(
            importance, "sequence_id", "step", "node_idx", "importance")
        first = back.filter("sequence_id = 0 AND part = 0").first()
        assert first.temporal_attention == [0.2, 0.3, 0.5] and len(first.edge_importance) == 3


def test_techniques_by_verb(log):
    events = log((0, "EXECUTE", "a", "x"), (1, "EXECUTE", "a", "x"), (2, "SENDTO", "a", "x"), (3, "OPEN", "a", "x"))
    got = story.event_techniques(events.withColumn("window_start", F.lit(T0).cast("timestamp_ntz")))
    assert rows(got, "technique") == [("T1041 Exfiltration Over Network",), ("T1059 Command Execution",)]
