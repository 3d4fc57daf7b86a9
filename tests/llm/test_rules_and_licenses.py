import math
import random
import re
from collections import Counter

from hostweave.llm import licenses, quality_rules as rules
from tests.llm.conftest import ODD


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    repeated = {p for i, x in enumerate(windows) if count[x] > 1 for p in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w))


PROSE = ("The quick fox of the hill went to a river and it was the best of all that was in the land. "
         "She said that it is on the table for you and with the others as it was by this or from there. ")


def test_base_counts(documents):
    rows = ODD + [(20, "a b c a b c x y z a b"), (21, "a a a a"), (22, "one\ntwo\none\n\n \none"), (23, PROSE), (24, "#*$ %& <>|")]
    got = rules.quality_rules(documents(*rows, extra=True)).collect()
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert found == Counter((r[0], *base(r[1])) for r in rows)
    assert not any(r.kept for r in got if r.base_failed)


def test_odd_distributions_go(documents):
    words = PROSE.split()
    good = [(i, " ".join(words[i % 7:] + [f"w{i}{j}x" for j in range(90)] + words[:i % 7])) for i in range(20)]
    table = (50, " | ".join(f"cell{'abcdefghij'[i % 10]}{i}" for i in range(150)))
    loud = (51, " ".join(f"WORD{'ABCDEFGHIJ'[i % 10]}{i}!!!***" for i in range(150)))
    short = (52, " ".join(f"A{i}" for i in range(60)))  # too few characters, but not one common word
    brief = [(60 + i, " ".join(words[i:] + words[:i] + [f"w{i}{j}x" for j in range(55 - len(words))])) for i in range(4)]
    verdict = {r.doc_id: r.kept for r in rules.quality_rules(documents(*good, table, loud)).collect()}
    assert all(verdict[i] for i, _ in good) and not verdict[50] and not verdict[51]
    verdict = {r.doc_id: (r.kept, r.base_failed) for r in rules.quality_rules(documents(*good, short, *brief)).collect()}
    assert verdict[52] == (False, False)
    assert all(verdict[i] == (True, False) for i, _ in brief)


def test_limits_follow_the_length(documents):
    """One mixture of words, near its reference when it is short, too far from it when it is long."""
    r = random.Random(3)
    common = rules.COMMON_WORDS["en"]

    def text(n, share):
        return " ".join(r.choice(common) if r.random() < share else
                        "".join(r.choice("bcdfghklmnprst") for _ in range(r.randint(3, 9))) for _ in range(n))

    usual = [(i, text(400, 0.4)) for i in range(60)]
    thin = [(100 + i, text(60, 0.2)) for i in range(5)] + [(200 + i, text(3000, 0.06)) for i in range(5)]
    got = {x.doc_id: x for x in rules.quality_rules(documents(*usual, *thin)).collect()}
    assert all(got[i].kept for i, _ in usual) and all(got[100 + i].kept for i in range(5))
    assert not any(got[200 + i].kept for i in range(5))
    shortest, longest = (math.sqrt(rules.WORD_LIMIT[0] + rules.WORD_LIMIT[1] / n) for n in (60, 3000))
    assert all(longest < got[i].word_distance < shortest for i in [*range(100, 105), *range(200, 205)])


def test_languages_without_fixed_words(documents):
    r = random.Random(4)
    common = "и в не на я что он с как это по но они мы".split()

    def text():
        return " ".join(r.choice(common) if r.random() < 0.4 else
                        "".join(r.choice("абвгдежзклмнопрсту") for _ in range(r.randint(3, 9))) for _ in range(160))

    clean = [(i, text(), "ru") for i in range(30)]
    english = [(100 + i, PROSE * 2 + " ".join(f"w{i}{j}x" for j in range(90)), "en") for i in range(5)]
    table = (50, " | ".join(f"cell{'abcdefghij'[i % 10]}{i}" for i in range(150)), "ru")
    unknown = [(60, clean[0][1], None), (61, "мы " * 90, None)]
    got = {x.doc_id: x for x in rules.quality_rules(documents(*clean, *english, table, *unknown, extra=True)).collect()}
    assert len(got) == 38
    assert all(got[i].kept and 0 < got[i].word_distance < 0.285 for i, *_ in clean)
    assert not got[50].kept and not got[50].base_failed
    assert got[60].kept and got[60].class_distance == got[60].word_distance == 0 and not got[61].kept


def test_without_references(documents):
    row = rules.quality_rules(documents((1, PROSE * 2 + " x", None))).first()
    assert row.class_distance == 0 and row.word_distance == 0
    assert rules.quality_rules(documents()).collect() == []


def test_distance(spark):
    from pyspark.sql import functions as F

    def shares(values):
        return F.array(*[F.lit(float(v)) for v in values])

    def plain(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        k = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
        return math.sqrt(max(0, (k(p) + k(q)) / 2))

    for p, q in [((1, 0), (0, 1)), ((0.5, 0.5), (0.5, 0.5)), ((0.2, 0.3, 0.5), (0.6, 0.4, 0))]:
        got = spark.range(1).select(rules.js_distance(shares(p), shares(q))).first()[0]
        assert abs(got - plain(p, q)) < 1e-12


def brute_licenses(rows, templates):
    def own(text):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    found = []
    for doc_id, text, *_ in rows:
        for name, template in templates:
            t, d = own(template), own(text)
            if t and 100 * len(t & d) >= 75 * len(t):
                found.append((doc_id, name, template, len(t), len(t & d)))
    return Counter(found)


def test_licenses(documents):
    filler = " ".join(f"w{i}" for i in range(300))
    rows = ODD + [(100 + i, f"{filler} {t.upper()}\n{filler}") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    long = licenses.TEMPLATES[1][1].split()
    rows += [(200, " ".join(long[:40])), (201, " ".join(long[:20] + ["changed"] + long[21:])), (202, "Released under the MIT"),
             (203, (filler + " Released under the MIT License. ") * 30)]
    got = Counter(map(tuple, licenses.license_scan(documents(*rows, extra=True)).collect()))
    assert got == brute_licenses(rows, licenses.TEMPLATES)


def test_license_blocks_and_empty_inputs(documents, monkeypatch):
    monkeypatch.setattr(licenses, "TEMPLATES_PER_BLOCK", 3)
    rows = [(1, "Released under the MIT License."), (2, "Licensed under CC BY-NC 4.0.")]
    got = Counter(map(tuple, licenses.license_scan(documents(*rows)).collect()))
    assert got == brute_licenses(rows, licenses.TEMPLATES)
    assert licenses.license_scan(documents()).collect() == []
    assert licenses.license_scan(documents(*rows), [("short", "two words")]).collect() == []


def test_versions_and_variants_of_licenses(documents):
    gnu = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} License as"
           " published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.")
    further = {n: t for n, t, strict in licenses.FURTHER if strict}
    rows = {
        1: ("Licensed under CC BY 4.0.", "CC-BY-4.0"), 2: ("see CC BY-NC-SA 4.0 here", "CC-BY-NC-SA-4.0"),
        3: (gnu.format("General Public", "2"), "GPL-2.0"), 4: (gnu.format("General Public", "3"), "GPL-3.0"),
        5: (gnu.format("Lesser General Public", "2.1"), "LGPL-2.1"), 6: (gnu.format("Affero General Public", "3"), "AGPL-3.0"),
        7: ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        8: (further["BSD-2-Clause"], "BSD-2-Clause"), 9: (further["BSD-3-Clause"], "BSD-3-Clause"),
        10: ("under a Creative Commons Attribution-NonCommercial 3.0 Unported License", "CC-BY-NC-3.0"),
        11: (next(t for n, t, _ in licenses.FURTHER if n == "ISC"), "ISC"), 12: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    }
    got = licenses.license_scan(documents(*[(i, f"before it {t} after it") for i, (t, _) in rows.items()])).collect()
    assert {(r.doc_id, r.license) for r in got} == {(i, n) for i, (_, n) in rows.items()}
