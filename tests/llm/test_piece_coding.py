import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from hostweave.llm import piece_coding
from hostweave.llm.queries import QUERIES
from tests.llm.conftest import ODD

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [" ", "▁", "\n", "\t", "a", "B", "<s>", "</s>", "<0x0A>", "<unk>", "⁇", "é", "日", "😀", "\x00", " ", "ﬁ", "the"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def coder():
    return piece_coding.PieceCoder(MODEL, keep=50, longest=10)  # small bounds: the table starts anew often


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_equal_to_the_library(coder, library):
    for ends in (True, False):
        for start in range(0, 6000, 500):
            texts = random_texts(500, start)
            coded = coder.encode([t.encode() for t in texts], ends)
            wanted = [library.encode(t, add_bos=ends, add_eos=ends) for t in texts]
            assert list(map(ids_of, coded)) == wanted
            assert [coder.decode(c) for c in coded] == [library.decode(w) for w in wanted]


def test_any_ids_decode_as_in_the_library(coder, library):
    r = random.Random(5)
    for _ in range(20_000):
        ids = [r.choice([0, 1, 2, 3, 13, 259, 264, 28705, r.randrange(3, 259), r.randrange(32_000)])
               for _ in range(r.randint(0, 8))]
        assert coder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_each_distinct_chunk_is_segmented_once(monkeypatch):
    coder = piece_coding.PieceCoder(MODEL)
    seen = Counter()
    segmented = coder._segmented
    monkeypatch.setattr(coder, "_segmented", lambda chunks: seen.update(chunks) or segmented(chunks))
    for _ in range(3):
        coder.encode([b"the cat saw the dog", b"the dog\nsaw  the cat"] * 50)
    assert set(seen.values()) == {1} and seen[b" the"] == 1


def test_tables(spark, documents, library):
    rows = [(r[0], r[1]) for r in ODD] + [(30 + i, t) for i, t in enumerate(random_texts(200, 9))]
    coded = piece_coding.with_decoded(piece_coding.encoded(documents(*rows, extra=True), MODEL), MODEL)
    assert coded.columns == ["doc_id", "ids", "decoded"]
    wanted = Counter()
    for doc_id, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        wanted[doc_id, np.array(ids, "<u4").tobytes(), library.decode(ids)] += 1
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in coded.collect()) == wanted
    bare = piece_coding.encoded(documents((1, None), (2, "a b")), MODEL, ends=False).collect()
    assert {r.doc_id: ids_of(r.ids) for r in bare} == {1: [], 2: library.encode("a b")}
    assert piece_coding.encoded(documents(), MODEL).collect() == []


def test_null_ids_and_a_column_of_that_name(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, bytes(4), "y")], "k int, ids binary, decoded string")
    assert sorted(map(tuple, piece_coding.with_decoded(df, MODEL).select("k", F.col("decoded").isNull()).collect())) == [
        (1, True), (2, False)]


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    wanted = set()
    for d in docs:
        ids = library.encode(d.text or "", add_bos=True, add_eos=True)
        wanted.add((d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op11_piece_coding"](spark, folder).collect()} == wanted
