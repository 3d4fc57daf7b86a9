"""The training-data pipeline: documents in, placed pieces of training sequences out.

Every stage is a function of (spark, docs, sf_dir), where docs is what the stage
before has kept, and all but the last return the columns of documents. ``run``
writes each stage's result to the shared folder and reads it back.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostweave.llm import decontaminate, jaccard, language_id, packing, pii
from hostweave.llm.common import staged, table
from hostweave.llm.queries import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network recognises; texts without a letter go."""
    return language_id.in_language(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the row with the smallest doc_id.

    Documents without words link with nothing and stay. Of several rows with that
    id one stays if they are copies of each other.
    """
    return jaccard.representatives(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data marked in place; n_chars follows the new text."""
    marked = pii.redact(docs)
    return marked.withColumn("n_chars", F.when(
        F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences of 2048 tokens."""
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_test_items),
    ("pii", without_personal_data),
    ("best_fit_packing", packed_sequences),
]

#: None: a trained network decides in the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
