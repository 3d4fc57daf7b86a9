import os
import random
import zlib

import numpy as np
import pytest

from hostweave.llm import language_id, quality_model
from tests.llm.conftest import ODD

FOLDER = "/root/testdata/sf0.1"
WORDS = {"en": "the of and to in that house water green", "fr": "le la les des que très maison été vert",
         "de": "der die das und nicht für größe häuser grün"}


def corpus(n=240, seed=1):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(5, 120))), lang)
            for i, lang in ((i, r.choice(sorted(WORDS))) for i in range(n))]


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_network_gradients():
    """Against differences of the loss."""
    r = np.random.default_rng(0)
    net = language_id.Network.fresh(["a", "b", "c"])
    for name in ("embedding", "output", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters = {w: f.astype(np.float64) for w, f in net.filters.items()}
    net.biases = {w: f.astype(np.float64) for w, f in net.biases.items()}
    rows, labels = r.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        p = net.probabilities(rows, net.tables())
        return -np.log(p[np.arange(5), labels]).mean()

    for parameter, gradient in zip(net._parameters(), net._gradients(rows, labels)):
        flat, g = parameter.reshape(-1), gradient.reshape(-1)
        for i in np.argsort(-np.abs(g))[:4]:
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-6 - g[i]) < 1e-5


def test_languages(documents):
    rows = corpus() + [(1000 + i, t) for i, (_, t, *_) in enumerate(ODD)] + [(None, "the water of the house", None)]
    got = language_id.identified(documents(*rows, extra=True)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for doc_id, _, lang in corpus():
        assert by_id[doc_id].held_out == (remainder(doc_id, 4) == 2)
        assert by_id[doc_id].lang_pred == lang and 0 <= by_id[doc_id].score <= 1
    for i, (_, text, *_) in enumerate(ODD):
        letters = any(c.isalpha() for c in text or "")
        assert (by_id[1000 + i].lang_pred == "und") == (not letters)
    assert by_id[None].lang_pred == "en" and by_id[None].held_out is False


def test_language_without_labels(documents):
    assert language_id.identified(documents()).collect() == []
    rows = language_id.identified(documents((1, "some text", None), (2, None, None))).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)] * 2


def test_stage_keeps_texts_with_letters(documents):
    docs = documents(*corpus(), (900, None), (901, "12 !!"), (902, "le"), extra=True)
    kept = language_id.in_language(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i, _, _ in corpus()] + [902])


@pytest.mark.parametrize("languages", [1, 4])
def test_stage_rejects_noise_whatever_the_number_of_languages(documents, languages):
    rows = corpus()
    names = sorted({r[2] for r in rows})[:languages]
    rows = [r for r in rows if r[2] in names]
    r = random.Random(6)
    noise = [(900 + i, " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(3, 9)))
                                for _ in range(200)), None) for i in range(5)]
    mixed = " ".join(text for name in names for text in [x[1] for x in rows if x[2] == name][:3])
    got = {x.doc_id for x in language_id.in_language(documents(*rows, *noise, (950, mixed, None), extra=True)).collect()}
    assert got == {x[0] for x in rows} | {950}


def labelled(n=300, seed=2):
    r = random.Random(seed)
    docs, labels = [], []
    for i, text, _ in corpus(n, seed):
        words = text.split()
        good = r.random() < 0.6
        if not good:
            words = r.choice([[w.upper() + "!!" for w in words], [w + " |" for w in words], [words[0]] * len(words)])
        docs.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality(documents, spark):
    docs, labels = labelled()
    odd = [(1000 + i, t) for i, (_, t, *_) in enumerate(ODD)] + [(None, "no id here")]
    known = spark.createDataFrame(
        labels + [(1, None, 0), (None, 1, 0), (2, labels[2][1], 1), (5000, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = quality_model.scored(documents(*docs, *odd, extra=True), known).collect()
    assert len(got) == len(docs) + len(odd)
    by_id = {r.doc_id: r for r in got}
    right = [by_id[i].predicted == q for i, q, _ in labels if by_id[i].held_out]
    assert len(right) > 60 and sum(right) / len(right) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and remainder(r.doc_id, 3) == 1)


def test_quality_without_labels(documents, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.score for r in quality_model.scored(documents((1, "a"), (2, None)), none).collect()] == [0.5, 0.5]
    assert quality_model.scored(documents(), none).collect() == []


def test_batch_scores_equal_document_features():
    """Scoring looks words up once for a batch; features go text by text."""
    model = quality_model.Model.fresh()
    model.bias[:] = (0.1, -0.2)
    texts = [t.encode() for _, t, _ in corpus(20)] + [b"", b"one", b"same same same"]
    rows = list(quality_model.document_features(texts))
    one = np.array([(w @ model.vectors[b] if len(b) else np.zeros(quality_model.DIMENSIONS)) for b, w in rows])
    p = quality_model._softmax(one @ model.output + model.bias)[:, 1]
    assert np.allclose(p, model.scores(texts), atol=1e-5)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    lang = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (lang.lang == lang.lang_pred).mean() > 0.99
    quality = quality_model.scored(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (quality.quality == quality.predicted).mean() > 0.97


def test_every_language_is_learned(documents, monkeypatch):
    """More languages than the sample has documents: one document of each."""
    monkeypatch.setattr(language_id, "TRAIN_DOCS", 5)
    rows = [(i, f"{chr(97 + i % 8) * 3} {chr(105 + i % 8) * 4} " * 30, f"l{i % 8}") for i in range(160)]
    network = language_id.train(documents(*rows))
    assert network.languages == [f"l{i}" for i in range(8)]


def test_quality_gradients(monkeypatch):
    """One step of training against differences of the loss."""
    monkeypatch.setattr(quality_model, "EPOCHS", 1)
    model = quality_model.Model.fresh()
    for name in ("vectors", "output", "bias"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    (touched, weights), = quality_model.document_features([b"the green house the green house house by the water"])
    weights = weights.astype(np.float64)

    def loss():
        p = quality_model._softmax(((weights @ model.vectors[touched]) @ model.output + model.bias)[None])
        return -np.log(p[0, 0])

    def slope(array, place):
        old = array[place]
        array[place] = old + 1e-6
        up = loss()
        array[place] = old - 1e-6
        down = loss()
        array[place] = old
        return (up - down) / 2e-6

    places = [(int(t), d) for t in touched[::7] for d in range(3)] + [(quality_model.AGAIN, 0), (quality_model.EQUAL, 1)]
    rows = {t: np.array([slope(model.vectors, (t, d)) for d in range(quality_model.DIMENSIONS)]) for t, _ in places}
    layer = np.array([[slope(model.output, (d, c)) for c in range(2)] for d in range(quality_model.DIMENSIONS)])
    bias = np.array([slope(model.bias, (c,)) for c in range(2)])
    before = {name: getattr(model, name).copy() for name in ("vectors", "output", "bias")}
    model.train([(touched, weights)], [0])
    rate = quality_model.RATE
    assert np.allclose(before["bias"] - model.bias, rate * bias, atol=1e-7)
    assert np.allclose(before["output"] - model.output, rate * layer, atol=1e-7)
    for t, d in places:  # a row's step is scaled by the gradients it has seen
        step = rate * rows[t] / np.sqrt(1e-8 + (rows[t] ** 2).sum())
        assert np.allclose(before["vectors"][t] - model.vectors[t], step, atol=1e-5)
    untouched = np.setdiff1d(np.arange(len(model.vectors)), touched)
    assert (before["vectors"][untouched] == model.vectors[untouched]).all()


def test_quality_scores_by_hand():
    """Scores of whole texts against loops over words and n-grams."""
    top, base = 2 ** 64, int(quality_model._BASE)

    def spread(x):
        for _ in range(2):
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % top
        return x ^ x >> 32

    def vector(word, table):
        marked = b"<" + word + b">"
        found = [sum(spread(((b + 1) * base + i) % top) for i, b in enumerate(marked)) % top]
        for n in quality_model.GRAMS:
            for i in range(len(marked) - n + 1):
                value = 0
                for b in marked[i:i + n]:
                    value = (value * base + b + 1) % top
                found.append((value * base + n) % top)
        return np.mean([table[spread(h) % quality_model.BUCKETS] for h in found], axis=0)

    model = quality_model.Model.fresh()
    texts = ["", "a", "a a a a", "the green house by the green house", "größe é 日本 größe é", "x" * 300 + " y",
             " ".join(f"w{i % 37}" for i in range(500))]
    got = model.scores([t.encode() for t in texts])
    for text, score in zip(texts, got):
        words = text.encode().split()
        mean = np.mean([vector(w, model.vectors) for w in words], axis=0) if words else np.zeros(quality_model.DIMENSIONS)
        pairs = list(zip(words, words[1:]))
        if pairs:
            mean = mean + (1 - len(set(pairs)) / len(pairs)) * model.vectors[quality_model.AGAIN]
            mean = mean + sum(a == b for a, b in pairs) / len(pairs) * model.vectors[quality_model.EQUAL]
        odds = np.exp(mean @ model.output + model.bias)
        assert abs(odds[1] / odds.sum() - score) < 1e-5
    rows = list(quality_model.document_features([t.encode() for t in texts]))  # what training sees is what scores
    for (touched, weights), score in zip(rows, got):
        mean = weights @ model.vectors[touched] if len(touched) else np.zeros(quality_model.DIMENSIONS)
        assert abs(quality_model._softmax((mean @ model.output + model.bias)[None])[0, 1] - score) < 1e-5
