"""Registered queries of this subpackage: every operator over its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostweave.llm import (
    decontaminate, divergence, html_text, jaccard, language_id, licenses, merkle, packing,
    piece_coding, pii, quality_model, quality_rules, token_counts)
from hostweave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_best_fit_packing(spark, folder):
    return packing.packed(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op2_quality_rules(spark, folder):
    return quality_rules.quality_rules(table(spark, folder, "documents")).drop(
        "class_distance", "word_distance")


@query
def op3_license_scan(spark, folder):
    return licenses.license_scan(table(spark, folder, "documents"))


@query
def op4_jaccard_join(spark, folder):
    return jaccard.jaccard_components(table(spark, folder, "documents"))


@query
def op5_token_counts(spark, folder):
    import public_tokenizers

    return token_counts.section_tokens(
        table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN)


@query
def op6_quality_model(spark, folder):
    return quality_model.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op7_language_id(spark, folder):
    return language_id.identified(table(spark, folder, "documents"))


@query
def op8_pii(spark, folder):
    return pii.found_spans(table(spark, folder, "documents"))


@query
def op9_decontamination(spark, folder):
    return decontaminate.contained_items(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op10_main_text(spark, folder):
    return html_text.extracted(table(spark, folder, "pages"))


@query
def op11_piece_coding(spark, folder):
    return piece_coding.encoded(
        table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"), decode=True
    ).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_source_divergence(spark, folder):
    return divergence.source_divergence(table(spark, folder, "documents"))


@query
def op13_merkle_manifest(spark, folder):
    return merkle.audited(table(spark, folder, "documents"))
