import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from hostweave.llm.common import staged
from hostweave.llm.queries import QUERIES
from hostweave.llm.sql import SQL
from tests.llm.conftest import ODD
from tests.llm.test_decontaminate import brute as brute_items
from tests.llm.test_jaccard import brute as brute_groups
from tests.llm.test_packing import check
from tests.llm.test_pii import brute as brute_spans
from tools.compare import TABLES, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER).toPandas(), con.execute(SQL[name]).df()) == ""


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, checked on its own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(90_000 + i, t, None, "s", 0) for i, (_, t, *_) in enumerate(ODD)], docs.schema)
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs = staged(docs.unionByName(extra), "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        after = staged(stage(spark, docs, FOLDER), "t")
        assert after.columns == docs.columns
        got = [tuple(r) for r in after.collect()]
        pairs = [r[:2] for r in before]
        if name == "language_id":
            assert Counter(got) == Counter(r for r in before if any(c.isalpha() for c in r[1] or ""))
        elif name == "jaccard_join":
            least = {(d if c is None else c) for d, _, c in brute_groups(pairs)}
            assert sorted(r[0] for r in got) == sorted(least)
        elif name == "decontamination":
            bad = {r[0] for r in brute_items(pairs, items)}
            assert bad and Counter(got) == Counter(r for r in before if r[0] not in bad)
        else:
            assert [r[0] for r in sorted(got)] == [r[0] for r in sorted(before)]
            assert not any(brute_spans(r[1]) for r in got) and any(brute_spans(r[1]) for r in before)
            assert all(r[4] == len(r[1]) for r in got)
        docs = after
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check(rows, [tuple(r)[:2] for r in docs.collect()], tokenizer, 2048)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).collect() == []


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 50


def test_stages_keep_columns_named_like_their_own(spark):
    """Names that the stages give columns of their own, also in upper case, keep the caller's values."""
    own = ["__label", "__score", "__id", "__hash", "__once", "__Text", "__place", "__bad", "__BAD_hash"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40)
    docs = staged(docs.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in own]), "t")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns
        kept = after.select("doc_id", *own).collect()
        assert kept and all(r[c] == f"{c}{r['doc_id']}" for r in kept for c in own)
