import random
from collections import defaultdict

import numpy as np
import pytest

from hostweave.llm import jaccard, shingles
from hostweave.llm.components import components
from tests.llm.conftest import ODD


def brute_sets(rows):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    return sets


def brute(rows, percent=75):
    """(doc_id, set size, component) by comparing all pairs."""
    sets, group = brute_sets(rows), list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            k = len(a & b)
            if a and b and 100 * k >= percent * (len(a) + len(b) - k):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = defaultdict(list)
    for g, (doc_id, *_) in zip(group, rows):
        least[g].append((doc_id is None, doc_id))
    key = lambda p: (p[0], 0 if p[1] is None else p[1])
    return [(r[0], len(s), min(least[g], key=key)[1] if s else r[0]) for r, s, g in zip(rows, sets, group)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def near_copies(seed=1, groups=6, copies=25):
    """Groups of edited copies, texts that share passages, and texts of their own."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage, texts = [word() for _ in range(40)], []
    for g in range(groups):
        base = [word() for _ in range(r.randint(20, 120))]
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 25))):
                own[r.randrange(len(own))] = word()
            if r.random() < 0.3:
                own = own[r.randint(0, len(own) // 5):]
            texts.append(" ".join(own))
    for _ in range(60):
        own = [word() for _ in range(r.randint(5, 60))]
        texts.append(" ".join(own[:len(own) // 2] + passage[:r.randint(0, 40)] + own[len(own) // 2:]))
    texts += r.sample(texts, 20)
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(documents, seed):
    rows = near_copies(seed)
    got = jaccard.jaccard_components(documents(*rows)).collect()
    assert order(map(tuple, got)) == order(brute(rows))


def test_many_fragments_and_hot_ngrams(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "TOKENS_PER_FRAGMENT", 200)
    rows = near_copies(3, groups=2, copies=60)
    got = jaccard.jaccard_components(documents(*rows).repartition(7)).collect()
    assert order(map(tuple, got)) == order(brute(rows))


def test_exact_border(documents):
    """6 of 8 shingles shared is a link, one fewer is not."""
    base = [f"w{i}" for i in range(11)]  # 7 shingles
    one = base + ["x"]  # 8 shingles; 7 of 8 shared with base
    rows = [(5, " ".join(base)), (3, " ".join(one)), (9, " ".join(base[:-1] + ["y", "z"]))]
    got = jaccard.jaccard_components(documents(*rows)).collect()
    assert order(map(tuple, got)) == order(brute(rows))


def test_odd_documents(documents):
    rows = [r for r in ODD]
    got = jaccard.jaccard_components(documents(*rows, extra=True)).collect()
    assert order(map(tuple, got)) == order(brute(rows))


def test_empty_table(documents):
    assert jaccard.jaccard_components(documents()).collect() == []
    assert jaccard.representatives(documents()).collect() == []


def test_representatives(documents):
    rows = near_copies(4) + [(9000, None), (9001, ""), (9002, None)]
    docs = documents(*rows, extra=True)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    expected = {c for _, _, c in brute(rows)}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got) == sorted(expected)


def test_representatives_of_repeated_rows(documents):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "A b c d e f"), (None, "q r s t u"), (2, ""), (2, "")]
    got = sorted((r.doc_id or 0, r.text) for r in jaccard.representatives(documents(*rows)).collect())
    assert [d for d, _ in got] == [0, 1, 2, 2]


def test_shingles_equal_word_tuples():
    texts = [t.encode() for _, t in near_copies(5)] + [b"", b" ", b"a", b"b a", b"a b", b"A  b", b"x" * 3_000_000 + b" y"]
    rows = [(0, t.decode()) for t in texts]
    sets = shingles.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(s) for s in brute_sets(rows)]
    all_words = set().union(*brute_sets(rows))
    assert len(np.unique(np.concatenate(sets))) == len(all_words)


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 101), (None, 3), (102, 100), (102, 100)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
