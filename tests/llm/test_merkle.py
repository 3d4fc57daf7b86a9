import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hostweave.llm import merkle
from tests.llm.conftest import DOCUMENTS, ODD


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row):
    return sha(*[field(row[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])


def climbed(hashes):
    """The top of a list of nodes, and (left, right) for each of them level by level."""
    paths = [[] for _ in hashes]
    at = [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        for i, members in enumerate(at):
            run = i // 16 * 16
            for m in members:
                paths[m].append(("".join(hashes[run:i]), "".join(hashes[i + 1:run + 16])))
        hashes = [sha(*hashes[i:i + 16]) for i in range(0, len(hashes), 16)]
        at = [[m for members in at[i:i + 16] for m in members] for i in range(0, len(at), 16)]
    return hashes[0], paths


def brute(rows):
    by_source = defaultdict(list)
    for row in rows:
        by_source[row["source"]].append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        members = sorted(by_source[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[source] = members, *climbed([leaf_of(r) for r in members])
    root, uppers = climbed([trees[s][1] for s in order]) if order else (None, [])
    out = Counter()
    for source, upper in zip(order, uppers):
        members, subroot, paths = trees[source]
        for row, own in zip(members, paths):
            path = own + upper
            h = leaf = leaf_of(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0 and row["text"]:
                h = leaf_of(row | {"text": "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])})
            for left, right in path:
                h = sha(left, h, right)
            out[row["doc_id"], leaf, subroot, root, sha(*[a + b for a, b in path]), h, h == root] += 1
    return out


def checked(spark, rows, extra=False):
    names = [c.split()[0] for c in DOCUMENTS.split(", ")]
    schema = DOCUMENTS + (", path string, hash string, root string, `rank` int, total int, block string, digit int" if extra else "")
    full = [tuple(r) + ("p", "h", "r", 7, 7, "b", 7) for r in rows] if extra else rows
    got = merkle.audited(spark.createDataFrame(full, schema))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == brute([dict(zip(names, r)) for r in rows])
    return got


def doc(i, source, text="Some Text"):
    return (i, text, "en", source, len(text))


@pytest.mark.parametrize("size", [1, 2, 16, 17, 256, 257, 273, 4097])
def test_one_source_of_any_size(spark, size):
    checked(spark, [doc(i * 7919 % 100_003, "s", f"Text {i}") for i in range(size)])


def test_many_sources(spark):
    """A hot source, small ones, a null and an empty one, more sources than a run holds."""
    rows = [doc(i, f"src{i % 37}" if i % 3 else "hot", f"T{i}") for i in range(1500)]
    rows += [doc(5000 + i, s) for i, s in enumerate([None, "", "é", "Z", "z", "日", "😀", None])]
    got = checked(spark, rows)
    assert got.select("root").distinct().count() == 1
    assert got.where("verified").count() > 1000 and got.where("not verified").count() > 200


def test_odd_rows(spark):
    rows = [(i, t, None if j % 2 else "en", [None, "a", ""][j % 3], None if j % 5 == 0 else j)
            for j, (i, t, *_) in enumerate(ODD)]
    checked(spark, rows + rows[:5], extra=True)


def test_repeated_rows_and_ties(spark):
    checked(spark, [doc(1, "s")] * 300 + [doc(1, "s", "Other")] * 20 + [doc(None, "s")] * 40)


def test_empty_table(spark):
    assert merkle.audited(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_proofs_lead_to_the_root(spark):
    docs = spark.createDataFrame([doc(i, f"s{i % 3}") for i in range(600)], DOCUMENTS)
    rows = merkle.manifest(docs, {"upper": F.upper("text")})
    assert rows.columns == ["doc_id", "source", "leaf", "upper", "path", "subroot", "root"]
    folded = rows.select((merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), F.size("path").alias("n"))
    assert {tuple(r) for r in folded.collect()} == {(True, 3)}  # 200 leaves in two levels, three sources in one
    wrong = rows.select(merkle.folded(F.sha2("upper", 256), F.col("path")) == F.col("root")).distinct().collect()
    assert [r[0] for r in wrong] == [False]


def test_ranks_of_a_hot_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.col("id") * 7919 % 10_007).alias("k"))
    got = merkle.ranked(rows, "g", ["k"], "t").collect()
    for g in {r.g for r in got}:
        own = sorted((r for r in got if r.g == g), key=lambda r: r.k)
        assert [r["rank"] for r in own] == list(range(len(own))) and {r.total for r in own} == {len(own)}
