import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from hostweave.llm import packing
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def tokenizer(words_path):
    t = Tokenizer.from_file(words_path)
    t.encode_special_tokens = True
    return t


TEXTS = ["", "It's DON'T they'll ''s 12 ½ a²b", "İstanbul ﬁ café é <|endoftext|> x", "日本語 テスト", "a" * 3000,
         "!!!'s--'t 'S 'LL", "\x1c a\x0bb", "Ünïcode, words. and, more.", "x,. x., .x 's, 't."]


def ids(tokenizer, text):
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("keep, keep_runs", [(900_000, 200_000), (3, 2)])
def test_encoder_equals_the_tokenizer(tokenizer, words_path, keep, keep_runs):
    encoder = packing.WordEncoder(words_path, keep, keep_runs)
    for _ in range(2):
        assert encoder.encode(TEXTS) == [ids(tokenizer, t) for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("abzAZ'sStTlé ß.,!-12½\n\tÀ×"), max_size=40))
def test_encoder_on_any_text(text):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = packing.word_encoder(path).whole
    assert packing.word_encoder(path).encode([text]) == [ids(whole, text)]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([8, 17, 64]).flatmap(lambda limit: st.tuples(
    st.just(limit), st.dictionaries(st.integers(1, limit), st.integers(1, 30), max_size=limit))))
def test_plan_is_best_fit_decreasing(case):
    limit, counts = case
    places, sequences = [], defaultdict(list)
    for length, rank, ranks, first, each, used in packing.plan(counts, limit):
        for i in range(ranks):
            places.append((length, rank + i))
            sequences[first + i // each].append((used + i % each * length, length))
    assert sorted(places) == [(n, r) for n in sorted(counts) for r in range(counts[n])]
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= limit
    free = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [i for i, left in enumerate(free) if left >= length]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= length
            else:
                free.append(limit - length)
    assert len(free) == len(sequences)


def check(rows, texts, tokenizer, limit):
    """Round trip: every piece once, whole documents, gapless sequences."""
    expected = []
    for doc_id, text, *_ in texts:
        data = ids(tokenizer, text or "") + b"\0\0\0\0"
        expected += [(doc_id, i, i * limit, len(part) // 4, zlib.crc32(part)) for i, part in enumerate(
            data[at:at + 4 * limit] for at in range(0, len(data), 4 * limit))]
    key = lambda r: tuple((v is None, v) for v in r)
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=key) == sorted(expected, key=key)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


def test_odd_documents(documents, words_path, tokenizer):
    rows = packing.packed(documents(*ODD, extra=True), words_path, limit=64).collect()
    check(rows, ODD, tokenizer, 64)


def test_many_equal_lengths_share_buckets(documents, words_path, tokenizer):
    texts = [(i, "one two three") for i in range(500)] + [(1000, "four " * 100)]
    cut = packing.staged(packing.pieces(documents(*texts), words_path, 16), "pieces")
    rows = packing.pack(cut, 16, rows_per_bucket=7).collect()
    assert check(rows, texts, tokenizer, 16) == -(-500 // 4) + 7


def test_empty_table(documents, words_path):
    assert packing.packed(documents(), words_path).collect() == []
