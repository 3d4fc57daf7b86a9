from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hostweave.llm import token_counts
from tests.llm.conftest import ODD

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def brute(text, rule, tokenizer):
    """Every token compared with every line."""
    lines, at = [], 0
    for part in (text or "").split("\n"):
        lines.append([at, at + len(part) + 1])
        at += len(part) + 1
    lines[-1][1] -= 1
    if len(lines) > 1 and lines[-1][0] == lines[-1][1]:
        lines.pop()
    tokens, crossing = [0] * len(lines), [0] * len(lines)
    for a, b in tokenizer.encode(text or "", add_special_tokens=False).offsets:
        shared = [max(0, min(b, e) - max(a, s)) for s, e in lines]
        hit = [i for i, n in enumerate(shared) if n]
        own = {"first": hit[0], "last": hit[-1], "largest": shared.index(max(shared))}[rule]
        tokens[own] += 1
        crossing[own] += len(hit) > 1
    return [(i, s, e, t, c) for i, ((s, e), t, c) in enumerate(zip(lines, tokens, crossing))]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections(documents, tokenizer, rule):
    rows = [r for r in ODD if len(r[1] or "") < 100_000 and r[0] != 11] + [
        (20, "one\n\n\n two\n  \nthree\n"), (21, "\n"), (22, "\n\n\n\nx"), (23, "é😀\n日本 語\n\n")]
    got = token_counts.section_tokens(documents(*rows, extra=True), RANKS, public_tokenizers.PATTERN, rule).collect()
    assert Counter(map(tuple, got)) == Counter(
        (r[0], *x) for r in rows for x in brute(r[1], rule, tokenizer))


def test_long_texts_and_sums(documents, tokenizer):
    rows = [r for r in ODD if len(r[1] or "") >= 100_000 or r[0] == 11]
    got = token_counts.section_tokens(documents(*rows), RANKS, public_tokenizers.PATTERN).collect()
    for doc_id, text, *_ in rows:
        total = sum(r.n_tokens for r in got if r.doc_id == doc_id)
        assert total == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_empty_table_and_bad_rule(documents):
    assert token_counts.section_tokens(documents(), RANKS, public_tokenizers.PATTERN).collect() == []
    with pytest.raises(ValueError):
        token_counts.section_tokens(documents(), RANKS, public_tokenizers.PATTERN, "middle")
