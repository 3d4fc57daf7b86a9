import public_tokenizers
import pytest

from tests.conftest import spark  # noqa: F401

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names the operators use themselves.
EXTRA = ("key bigint, n bigint, token string, bucket int, length bigint, bad int, picked string, place int,"
         " label int, score double, words string, hashes string, section int, lang_pred string")


@pytest.fixture(scope="session")
def words_path():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def documents(spark):  # noqa: F811
    """A documents table from (doc_id, text) or (doc_id, text, lang); ``extra`` adds clashing columns."""
    def build(*rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        schema = DOCUMENTS
        if extra:
            schema = f"{DOCUMENTS}, {EXTRA}"
            full = [r + (7, 7, "t", 7, 7, 7, "p", 7, 7, 0.5, "w", "h", 7, "xx") for r in full]
        return spark.createDataFrame(full, schema)
    return build


#: Null and empty texts and ids, repeated rows, ids with several texts, odd characters, very long texts.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (4, "word"), (5, "word"), (6, "other text here"),
    (6, "one id with a second text"), (None, "no id at all"), (None, None), (7, "!!! ???"), (8, "é😀 日本語 ß"),
    (9, "long " * 60_000), (10, "x" * 200_000), (11, "a\n" * 50_000), (12, "word word word word word word"),
    (13, "\x00\x1c\x85 odd breaks﻿"), (-5, "negative id"), (14, None),
]
