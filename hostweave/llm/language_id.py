"""Language identification by a small convolutional network over bytes.

The network embeds bytes, runs filters of several widths over a window of fixed
length, keeps the largest response of each filter and ends in a softmax. It is
trained here, in numpy, on windows of labelled texts. A text is cut into windows
that cover it whole, and the mean of their probabilities decides.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from hostweave.llm.common import free_name, text_chunks

WINDOW = 128  # bytes
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 16, 8
#: Bounds of the sample the network is fitted on: labelled documents by hash of their
#: id, evenly over the languages, and windows of each, evenly over its text.
TRAIN_DOCS, TRAIN_WINDOWS = 4000, 4
STEPS, BATCH, RATE = 700, 64, 0.01
#: The class of windows without language, and its share of the steps where it is learned.
NOISE, NOISE_SHARE = "\0", 0.5
#: Largest mean probability of that class in a text with a language. Labelled texts of
#: sf0.01 have 0.27 at most, random letters 0.97 at least, with one language or four.
MAX_NOISE = 0.95

_LETTER = re.compile(r"[^\W\d_]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def windows(data: bytes) -> np.ndarray:
    """All of a text as rows of ``WINDOW`` bytes, A-Z as a-z, the last filled up with zeros."""
    rows = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.translate(_LOWER).ljust(rows * WINDOW, b"\0"), dtype=np.uint8).reshape(rows, WINDOW)


@dataclass
class Network:
    """Weights: bytes to vectors, filters by width, and the output layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width * EMBEDDING, FILTERS)
    biases: dict[int, np.ndarray]
    output: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> "Network":
        r = np.random.default_rng(seed)
        scale = lambda *shape: r.normal(0, (2 / shape[0]) ** 0.5, shape).astype(np.float32)
        return cls(
            languages, r.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
            {w: scale(w * EMBEDDING, FILTERS) for w in WIDTHS},
            {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
            scale(len(WIDTHS) * FILTERS, len(languages)), np.zeros(len(languages), np.float32))

    def _parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters.values(), *self.biases.values(), self.output, self.bias]

    def train(self, rows: np.ndarray, labels: np.ndarray, seed: int = 11) -> None:
        """Adam on mini-batches drawn evenly from the languages; deterministic."""
        r = np.random.default_rng(seed)
        by_label = [np.flatnonzero(labels == c) for c in range(len(self.languages))]
        noise = by_label.pop() if self.languages[-1:] == [NOISE] else None
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self._parameters()]
        for step in range(1, STEPS + 1):
            picked = np.array([r.choice(by_label[c]) for c in r.integers(0, len(by_label), BATCH)])
            if noise is not None:  # the same share, however many languages there are
                n = int(BATCH * NOISE_SHARE)
                picked[:n] = r.choice(noise, n)
            for p, g, (m, v) in zip(self._parameters(), self._gradients(rows[picked], labels[picked]), moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)

    def _gradients(self, rows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        n, vectors = len(rows), self.embedding[rows]
        seen, best, pooled = {}, {}, []
        for w in WIDTHS:
            places = WINDOW - w + 1
            seen[w] = np.concatenate([vectors[:, i:i + places] for i in range(w)], axis=2)
            out = seen[w] @ self.filters[w]
            best[w] = out.argmax(axis=1)
            pooled.append(np.take_along_axis(out, best[w][:, None], axis=1)[:, 0] + self.biases[w])
        raw = np.concatenate(pooled, axis=1)
        hidden = np.maximum(raw, 0)
        p = _softmax(hidden @ self.output + self.bias)
        p[np.arange(n), labels] -= 1
        p /= n
        back = (p @ self.output.T) * (raw > 0)
        embedding, filters, biases = np.zeros_like(self.embedding), [], []
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS:(k + 1) * FILTERS]
            at = np.take_along_axis(seen[w], best[w][:, :, None], axis=1)  # (n, FILTERS, w * EMBEDDING)
            filters.append(np.einsum("nf,nfd->df", g, at))
            biases.append(g.sum(axis=0))
            to = np.einsum("nf,df->nfd", g, self.filters[w]).reshape(n, FILTERS, w, EMBEDDING)
            for i in range(w):
                np.add.at(embedding, np.take_along_axis(rows, best[w] + i, axis=1), to[:, :, i])
        return [embedding, *filters, *biases, hidden.T @ p, p.sum(axis=0)]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Filter responses by byte: of the first pair of all widths, of the third byte, of the last pair.

        A filter's response is a sum over its bytes, so the responses of pairs of
        bytes can be looked up. Same numbers as the products, at less work.
        """
        part = {w: self.embedding @ self.filters[w].reshape(w, EMBEDDING, FILTERS).swapaxes(0, 1).reshape(EMBEDDING, -1)
                for w in WIDTHS}  # (256, w * FILTERS)
        one = lambda w, i: part[w][:, i * FILTERS:(i + 1) * FILTERS]
        pair = lambda w, i: (one(w, i)[:, None] + one(w, i + 1)[None]).reshape(65536, FILTERS)
        return np.concatenate([pair(w, 0) for w in WIDTHS], axis=1), one(3, 2), pair(4, 2)

    def probabilities(self, rows: np.ndarray, tables) -> np.ndarray:
        first, third, last = tables
        pairs = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        out = np.take(first, pairs, axis=0)
        out[:, :-1, FILTERS:2 * FILTERS] += np.take(third, rows[:, 2:], axis=0)
        out[:, :-2, 2 * FILTERS:] += np.take(last, pairs[:, 2:], axis=0)
        raw = np.concatenate([
            out[:, :WINDOW - w + 1, k * FILTERS:(k + 1) * FILTERS].max(axis=1) + self.biases[w]
            for k, w in enumerate(WIDTHS)], axis=1)
        return _softmax(np.maximum(raw, 0) @ self.output + self.bias)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out(modulus: int, rest: int):
    """Whether crc32 of the doc_id as text leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


def shuffled(rows: np.ndarray, seed: int = 13) -> np.ndarray:
    """Windows with the bytes of ``rows`` in random order, the zeros at the end in place."""
    r, out = np.random.default_rng(seed), rows.copy()
    for row in out:
        n = len(bytes(row).rstrip(b"\0"))
        row[:n] = r.permutation(row[:n])
    return out


def train(docs: DataFrame, noise: bool = False) -> Network | None:
    """A network for the languages of ``docs``; None if no text is labelled.

    With ``noise`` it has a last class ``NOISE``, learned from the sample's windows
    with their bytes in random order.

    The sample is bounded: at most ``TRAIN_DOCS`` documents, picked by hash and evenly
    over all languages (one of each where there are more languages than that), and
    ``TRAIN_WINDOWS`` windows of each.
    Documents are ranked within a language; only those with small hashes, about
    four times as many as can be picked, go into a ranking.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("language"))
    labelled = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null and length(text) > 0")
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return None
    bound = max(TRAIN_DOCS, len(counts))
    last = F.create_map(*[F.lit(v) for r in counts for v in (
        r["lang"], -(1 << 63) + min((1 << 64) - 1, (4 * TRAIN_DOCS << 64) // r["count"]))])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    picked = (labelled.select("doc_id", "lang").where(order <= last[F.col("lang")]).withColumn("place", place)
              .where(F.col("place") <= TRAIN_DOCS).orderBy("place", "lang").limit(bound)
              .select("doc_id", F.col("lang").alias("picked")).distinct())
    texts = labelled.join(F.broadcast(picked), "doc_id").where("lang = picked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, ids), chunk in text_chunks(batches, ["lang", "doc_id"], "text"):
            found = []
            for i, data in enumerate(chunk):
                rows = windows(data)
                for at in np.unique(np.linspace(0, len(rows) - 1, TRAIN_WINDOWS).astype(int)):
                    found.append((i, int(at), rows[at].tobytes()))
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [lang.take(at), ids.take(at), pa.array([f[1] for f in found], pa.int64()),
                 pa.array([f[2] for f in found], pa.binary())],
                names=["lang", "doc_id", "at", "window"])

    sample = texts.select("lang", "doc_id", "text").mapInArrow(
        cut, f"lang string, doc_id {dict(docs.dtypes)['doc_id']}, at bigint, window binary").orderBy(
        "doc_id", "at", "lang", "window").limit(bound * TRAIN_WINDOWS).collect()
    if not sample:
        return None
    languages = sorted({r["lang"] for r in sample})
    rows = np.frombuffer(b"".join(bytes(r["window"]) for r in sample), dtype=np.uint8).reshape(-1, WINDOW)
    labels = np.array([languages.index(r["lang"]) for r in sample])
    if noise:
        rows, labels = np.concatenate([rows, shuffled(rows)]), np.append(labels, np.full(len(rows), len(languages)))
        languages = [*languages, NOISE]
    network = Network.fresh(languages)
    network.train(rows, labels)
    return network


def predict(
    docs: DataFrame, network: Network | None, label: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """``docs`` with the predicted language and its score.

    Null texts and texts without a letter are ``und`` with score 0, and so is
    every text if nothing was learned. Rows and columns stay; columns of the same
    names are replaced.
    """
    kept = docs.drop(label, score)
    shipped = docs.sparkSession.sparkContext.broadcast(network)
    schema = T.StructType([
        *kept.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])
    names = schema.names
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        tables = model.tables() if model else None
        for batch in batches:
            labels, scores = [], []
            for _, texts in text_chunks([batch], [], batch.schema.names[at], 1 << 17):
                wanted = [bool(model and _LETTER.search(t.decode())) for t in texts]
                rows = [windows(t) for t, w in zip(texts, wanted) if w]
                means = iter(())
                if rows:
                    flat = np.concatenate(rows)
                    p = np.concatenate([
                        model.probabilities(flat[i:i + 512], tables) for i in range(0, len(flat), 512)])
                    sizes = np.array([len(r) for r in rows])
                    means = iter(np.add.reduceat(p, np.cumsum(sizes) - sizes) / sizes[:, None])
                for w in wanted:
                    mean = next(means) if w else None
                    labels.append(model.languages[int(mean.argmax())] if w else "und")
                    scores.append(min(1.0, float(mean.max())) if w else 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=names)

    return kept.mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score, learned from documents that are not held out.

    Repeated rows and null ids give rows of their own; other columns are ignored.
    """
    known = docs.select("doc_id", "text", "lang", held_out(4, 2).alias("held_out"))
    network = train(known.where("not held_out"))
    return predict(known.select("doc_id", "text", "held_out"), network).drop("text")


def in_language(docs: DataFrame, most: float = MAX_NOISE) -> DataFrame:
    """The documents with a language: text with a letter that does not read like bytes in random order.

    The class ``NOISE`` decides, by its mean probability over the windows and
    whatever the number of languages, so a text in several languages stays. A text
    shorter than a window is too short to tell and stays, and so does one labelled
    with a language that was not learned. All columns stay, also ``__label`` and ``__score``.
    """
    network = train(docs.where(~held_out(4, 2)), noise=True)
    learned = F.coalesce(F.col("lang").isin(network.languages), F.lit(True)) if network else F.lit(True)
    label, score = free_name(docs.columns, "__label"), free_name(docs.columns, "__score")
    noise = (F.col(label) == NOISE) & (F.col(score) > most) & (F.octet_length("text") >= WINDOW) & learned
    return predict(docs, network, label, score).where((F.col(label) != "und") & ~noise).select(*docs.columns)
