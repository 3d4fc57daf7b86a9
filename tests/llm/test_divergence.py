import random
import re
from collections import Counter, defaultdict

import pytest

from hostweave.llm import divergence
from tests.llm.conftest import ODD

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(0x41, 0x5B)}


def brute(rows, least, top):
    """Every term of every pair of sources, one by one."""
    counts, docs, members = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(UPPER))
        members[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, sources in members.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        v = len(kept)
        counts[lang, None] = sum((counts[lang, s] for s in sources), Counter())
        p = {}
        for s in [*sources, None]:
            total = sum(counts[lang, s][t] for t in kept)
            p[s] = [1 + 10**9 * (counts[lang, s][t] + 2) // (total + 2 * v) for t in kept]
        for s in sources:
            pairs = [(x, sum((a - b) ** 2 // (a + b) for a, b in zip(p[s], p[x]))) for x in sources if x != s]
            terms = [(t, (a - b) ** 2 // (a + b)) for t, a, b in zip(kept, p[s], p[None]) if counts[lang, s][t] and a > b]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:limit])}
    return out


def made(n, sources, words, seed, langs=("en", "de")):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdéß日Q" for b in range(words)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    letters = ["".join("xyzwvutsrq"[int(c)] if c.isdigit() else c for c in w) for w in vocabulary]
    return [(" ".join(r.choices(letters, weights, k=r.randint(0, 60))), r.choice(langs),
             "hot" if r.random() < 0.4 else f"s{r.randrange(sources)}") for _ in range(n)]


@pytest.fixture
def table(spark):
    def build(rows, extra=""):
        kinds = "doc_id bigint, text string, lang string, source string" + extra
        more = tuple(0 for _ in extra.split(",")[1:])
        return spark.createDataFrame([(i, *r, *more) for i, r in enumerate(rows)], kinds)
    return build


def checked(df, rows, least=10, top=10):
    got = divergence.source_divergence(df, least, top)
    assert [c[1] for c in got.dtypes] == ["string"] * 4 + ["bigint", "int"]
    got = list(map(tuple, got.collect()))
    assert len(got) == len(set(got)) and set(got) == brute(rows, least, top)
    return got


def test_sources(table):
    rows = made(600, 12, 30, 1)
    assert len(checked(table(rows, ", n int, place int, terms int, p int, value int, rank int"), rows)) > 300


def test_more_blocks_tiles_and_columns(table, monkeypatch):
    """Bounds so small that every product is cut: blocks of terms, tiles of sources, slabs of columns."""
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 16)
    monkeypatch.setattr(divergence, "TILE", 4)
    rows = made(500, 11, 12, 2)
    checked(table(rows), rows, 3, 4)


def test_slabs_hold_every_term_once():
    import numpy as np

    r = np.random.default_rng(0)
    n = r.integers(0, 6, (300, 5))
    rows, places = np.nonzero(n)
    cells = Counter()
    order = np.argsort(-n.sum(1), kind="stable")
    divergence.COLUMNS, before = 12, divergence.COLUMNS
    try:
        for a, p, b, q, k in divergence._products(rows, places, n[rows, places] * 10, dict.fromkeys(range(5), 0), order):
            for cell in zip(a.tolist(), p.tolist(), b.tolist(), q.tolist(), k.tolist()):
                cells[cell[:4]] += cell[4]
    finally:
        divergence.COLUMNS = before
    wanted = Counter((a, int(t[a]) * 10, b, int(t[b]) * 10) for t in n for a in range(5) for b in range(a + 1, 5))
    assert cells == wanted


def test_rare_terms_empty_groups_and_nulls(table):
    rows = [("only rare words here", "fr", "a"), ("others", "fr", "b"), (None, "fr", "c"), ("", None, None)]
    rows += [("Same same\x00SAME é日 x1y", None, s) for s in (None, "", "t", "t")] * 4
    rows += [(t, "odd", f"s{i % 3}") for i, (_, t, *_) in enumerate(ODD)] * 4
    got = checked(table(rows), rows)
    assert {r[4] for r in got if r[0] == "fr"} == {0} and not any(r[2] == "term" for r in got if r[0] == "fr")


def test_one_source_and_empty_table(table):
    rows = [("alone here", "en", "s")] * 12
    assert checked(table(rows), rows) == []
    assert divergence.source_divergence(table([])).collect() == []


def test_partial_counts_add_up(table):
    rows = made(300, 3, 20, 3)
    small = divergence.term_counts(table(rows), entries=5).groupBy("lang", "source", "term").agg({"n": "sum", "n_docs": "sum"})
    whole = divergence.term_counts(table(rows)).groupBy("lang", "source", "term").agg({"n": "sum", "n_docs": "sum"})
    assert small.exceptAll(whole).isEmpty() and whole.exceptAll(small).isEmpty() and whole.count() > 100
