import random

from pyspark.sql import functions as F

from hostweave.functions.ordered import latest_before, position_in_order


def test_position_and_latest_before_match_a_plain_loop(spark):
    """One key holds most rows; tiny slots force carries over several levels."""
    random.seed(5)
    data, used = [], set()
    for i in range(3000):
        key = "hot" if random.random() < 0.7 else f"k{random.randrange(20)}"
        order = random.randrange(-50_000, 400_000)
        if (key, order) in used:
            continue
        used.add((key, order))
        data.append((key, order, random.random() < 0.1))
    df = spark.createDataFrame(data, "key string, o bigint, mark boolean")
    for width, levels in ((3, 2), (100, 1), (1_000_000, 0)):
        placed = position_in_order(df, ["key"], "o", "place", width, levels=levels)
        got = latest_before(placed, ["key"], "o", F.when(F.col("mark"), F.col("o")), "last",
                            width, levels=levels)
        result = {(r.key, r.o): (r.place, r.last) for r in got.collect()}
        assert len(result) == len(data)
        for key in {k for k, _, _ in data}:
            last = None
            for i, (_, order, mark) in enumerate(sorted(d for d in data if d[0] == key)):
                assert result[key, order] == (i, last)
                last = order if mark else last


def test_no_key_and_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (0, "z")], "o bigint, name string")
    got = position_in_order(df, [], "o", "place", 10, ties=["name"])
    assert {r["name"]: r.place for r in got.collect()} == {"z": 0, "a": 1, "b": 2}
