"""Quality classifier with supervised subword embeddings.

A document is the mean of its words' vectors; a word's vector is the mean of one
learned vector for the word and one for each of its character n-grams, all hashed
into one table. Word pairs that refer back, because the text had them before or
because both words are equal, add a learned vector each, by their share of all
pairs: hashed pairs of rare words would not carry over to other texts. A softmax
layer on the sum gives the classes. Table and layer are trained together by
stochastic gradient descent, in numpy, on a bounded sample whose hashed features
are made in Spark tasks.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostweave.llm import shingles
from hostweave.llm.common import text_chunks
from hostweave.llm.language_id import held_out

BUCKETS, DIMENSIONS, GRAMS = 1 << 15, 8, (3, 4)
#: Bound of the sample the model is fitted on: labelled documents by hash of their id.
TRAIN_DOCS = 3000
EPOCHS, RATE = 6, 0.1
AGAIN, EQUAL = BUCKETS, BUCKETS + 1  # rows of the table for word pairs

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its character n-grams, and how many there are of each word.

    A word is read as <word>; n-grams count bytes.
    """
    marked = [b"<" + w + b">" for w in words]
    data = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(_U)
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(first + sizes, sizes) - np.arange(len(data))  # bytes to the word's end
    place = (np.arange(len(data)) - np.repeat(first, sizes)).astype(_U)
    hashes = [np.add.reduceat(shingles.mix((data + _U(1)) * _BASE + place), first)]
    owners = [np.arange(len(words))]
    for n in GRAMS:
        value = np.zeros(len(data), dtype=_U)
        for i in range(n):
            value[:len(data) - i] = value[:len(data) - i] * _BASE + (data[i:] + _U(1))
        inside = left >= n
        hashes.append(value[inside] * _BASE + _U(n))
        owners.append(owner[inside])
    order = np.argsort(np.concatenate(owners), kind="stable")
    buckets = (shingles.mix(np.concatenate(hashes)) % _U(BUCKETS)).astype(np.int64)[order]
    return buckets, np.bincount(np.concatenate(owners), minlength=len(words))


def _vocabulary(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of all texts, the word numbers in order, and the words of each text."""
    known: dict[bytes, int] = {}
    numbers, counts = [], []
    for t in texts:
        own = t.split()
        counts.append(len(own))
        numbers += [known.setdefault(w, len(known)) for w in own]
    return list(known), np.array(numbers, dtype=np.int64), np.array(counts, dtype=np.int64)


def back_references(numbers: np.ndarray) -> tuple[float, float]:
    """Of a text's word pairs, the share that came before and the share of equal words."""
    if len(numbers) < 2:
        return 0.0, 0.0
    pairs = numbers[:-1] << 32 | numbers[1:]
    equal = numbers[:-1] == numbers[1:]
    return 1 - len(np.unique(pairs)) / len(pairs), float(equal.mean())


def document_features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the rows of the table it touches and their weights."""
    words, numbers, counts = _vocabulary(texts)
    buckets, sizes = word_features(words) if words else (numbers, numbers)
    first = np.cumsum(sizes) - sizes
    at = 0
    for n in counts.tolist():
        own, times = np.unique(numbers[at:at + n], return_counts=True)
        shares = back_references(numbers[at:at + n])
        at += n
        if not n:
            yield np.zeros(0, np.int64), np.zeros(0, np.float32)
            continue
        take = np.concatenate([np.arange(first[w], first[w] + sizes[w]) for w in own])
        weight = np.repeat(times / sizes[own] / n, sizes[own])
        touched, where = np.unique(buckets[take], return_inverse=True)
        yield (np.concatenate([touched, [AGAIN, EQUAL]]),
               np.concatenate([np.bincount(where, weights=weight), shares]).astype(np.float32))


@dataclass
class Model:
    vectors: np.ndarray  # (BUCKETS + 2, DIMENSIONS)
    output: np.ndarray  # (DIMENSIONS, 2)
    bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 5) -> "Model":
        r = np.random.default_rng(seed)
        return cls(r.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS + 2, DIMENSIONS)).astype(np.float32),
                   r.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32))

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 3) -> None:
        """One document at a time; a row's steps shrink with the gradients it has seen. Deterministic."""
        r = np.random.default_rng(seed)
        seen = np.full(len(self.vectors), 1e-8, np.float32)
        left = total = EPOCHS * len(rows)
        for _ in range(EPOCHS):
            for i in r.permutation(len(rows)).tolist():
                touched, weights = rows[i]
                rate = RATE * left / total
                left -= 1
                mean = weights @ self.vectors[touched]
                error = _softmax((mean @ self.output + self.bias)[None])[0]
                error[labels[i]] -= 1
                back = self.output @ error
                self.output -= rate * np.outer(mean, error)
                self.bias -= rate * error
                seen[touched] += weights ** 2 * (back @ back)
                self.vectors[touched] -= (rate * weights / np.sqrt(seen[touched]))[:, None] * back

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of class 1 for each text; words are looked up once for the batch."""
        words, numbers, counts = _vocabulary(texts)
        means = np.zeros((len(texts), DIMENSIONS), np.float32)
        if words:
            buckets, sizes = word_features(words)
            word = np.add.reduceat(self.vectors[buckets], np.cumsum(sizes) - sizes) / sizes[:, None]
            full = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[full]
            means[full] = np.add.reduceat(word[numbers], starts) / counts[full, None]
            shares = [back_references(numbers[a:a + n]) for a, n in zip(starts.tolist(), counts[full].tolist())]
            means[full] += np.array(shares, np.float32) @ self.vectors[[AGAIN, EQUAL]]
        return _softmax(means @ self.output + self.bias)[:, 1]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of ``labels.quality``; None without a labelled document.

    At most ``TRAIN_DOCS`` labelled documents that are not held out are used,
    picked by hash; their whole texts become features in Spark tasks, and only
    those, of bounded size, reach the driver. Null labels are left out; of
    several labels of one document the smallest counts.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(3, 1))
    picked = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")).orderBy(
        F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), "doc_id").limit(TRAIN_DOCS)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, labels_), chunk in text_chunks(batches, ["doc_id", "label"], "text"):
            rows = list(document_features(chunk))
            yield pa.RecordBatch.from_arrays([
                ids, labels_, pa.array([b.astype(np.uint16).tobytes() for b, _ in rows], pa.binary()),
                pa.array([w.tobytes() for _, w in rows], pa.binary())],
                names=["doc_id", "label", "buckets", "weights"])

    sample = texts.mapInArrow(
        make, f"doc_id {dict(docs.dtypes)['doc_id']}, label int, buckets binary, weights binary").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: r["doc_id"])
    model = Model.fresh()
    model.train(
        [(np.frombuffer(r["buckets"], np.uint16).astype(np.int64), np.frombuffer(r["weights"], np.float32))
         for r in sample], [r["label"] for r in sample])
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document doc_id, held_out, score (of label 1) and predicted (score at least 0.5).

    Only text goes into a score. Null and empty texts get the score of a document
    without words; without any label every score is 0.5. Repeated rows and null
    ids give rows of their own; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for (ids, out), texts in text_chunks(batches, ["doc_id", "held_out"], "text", 1 << 21):
            p = model.scores(texts).astype(np.float64) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays(
                [ids, out, pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(3, 1).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
