import random
import re
from collections import Counter

from hostweave.llm import decontaminate
from tests.llm.conftest import ODD


def words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def runs(words, k):
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def brute(rows, items, percent=75):
    """An item of fewer than five words is one run of that many words."""
    found = []
    for doc_id, text, *_ in rows:
        words = words_of(text)
        for item_id, item in dict.fromkeys(items):
            wanted = words_of(item)
            k = min(5, len(wanted))
            if k:
                t, d = runs(wanted, k), runs(words, k)
                if 100 * len(t & d) >= percent * len(t):
                    found.append((doc_id, item_id, len(t), len(t & d)))
    return Counter(found)


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(prose(r.choice([3, 5, 6, 9, 17, 33, 70, 200])))) for i in range(40)]
    items += [(77, None), (78, ""), (79, "?!"), (5, items[5][1]), (None, items[6][1]), (80, items[7][1])]
    rows = []
    for i in range(120):
        text = prose(r.choice([0, 10, 500, 4000]))
        for _ in range(r.choice([0, 1, 1, 3])):
            item = (r.choice(items)[1] or "").split()
            kind = r.random()
            if kind < 0.2:
                item = item[:len(item) * 9 // 10]
            elif kind < 0.3 and len(item) > 20:
                item[10] = "edited"
            at = r.randint(0, len(text))
            text = text[:at] + [w.upper() + "," if r.random() < 0.1 else w for w in item] + text[at:]
        rows.append((i, " ".join(text)))
    return rows, items


def check(documents, spark, rows, items, **options):
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contained_items(documents(*rows, extra=True), table, **options).collect()
    assert Counter(map(tuple, got)) == brute(rows, items)


def test_items_in_documents(documents, spark):
    check(documents, spark, *corpus())


def test_blocks_of_items(documents, spark):
    check(documents, spark, *corpus(2), items_per_block=9)


def test_odd_documents(documents, spark):
    check(documents, spark, ODD, [(1, "other text here"), (2, "word"), (3, "word word word word word word"), (4, "long " * 9)])


def test_short_items_inside_texts(documents, spark):
    rows = [(1, "The capital of France, Paris, is old."), (2, "Paris"), (3, "of france PARIS"), (4, "capital of Germany"), (5, None),
            (6, "paris paris paris paris paris paris"), (7, "Was ist das"), (8, "日本 語 の 文 書 です"), (9, "parisian")]
    items = [(1, "Capital of France: Paris"), (2, "paris"), (3, "of France"), (4, "ist das?"), (5, "日本 語 の"), (6, "paris paris"), (7, "!"),
             (8, "capital of France Paris is old")]
    check(documents, spark, rows, items)
    check(documents, spark, rows, items, items_per_block=2)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(r.doc_id for r in decontaminate.without_items(documents(*rows), table).collect()) == [4, 5, 9]


def test_empty_tables(documents, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contained_items(documents(*ODD), none).collect() == []
    assert decontaminate.without_items(documents(), none).collect() == []


def test_without_items(documents, spark):
    rows, items = corpus(3)
    rows = rows + [(None, items[8][1] + " tail " * 30), (500, None)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(*rows, extra=True)
    kept = decontaminate.without_items(docs, table)
    bad = {r[0] for r in brute(rows, items)}
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in bad)


def test_rows_are_judged_by_their_own_text(documents, spark):
    item = "one two three four five six seven eight"
    table = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    clean = [(None, "a clean text without an id"), (None, None), (7, "another clean text of a repeated id"), (8, "clean")]
    rows = [*clean, (None, f"x {item} y"), (7, f"z {item}"), (7, f"z {item}"), (9, item)]
    got = decontaminate.without_items(documents(*rows, extra=True), table)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(clean)
