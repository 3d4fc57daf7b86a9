"""Best-fit packing of documents into training sequences of a fixed length.

Planning works on the histogram of piece lengths, never on documents: its size
depends on the sequence length only. Every planned slot is a range of ranks
within one length; a document's piece finds its slot by its own rank.
"""

import functools
import gc
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hostweave.llm.common import staged, text_chunks

#: Texts of these characters only need no Unicode normalisation beyond lower case.
_OTHER = re.compile("[^\t\n\r -~¡-ÿ]")
_LETTER, _DIGIT = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_RUN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\t\n\r {_LETTER}{_DIGIT}]+")

PIECES = "doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint"


class WordEncoder:
    """Ids of a lower-casing word BPE with word ends, word by word.

    No token crosses white space or the border of a run of letters, and words
    repeat. So the ids of words and of runs are kept as little-endian bytes: words
    for the length of a task, at most ``keep`` of them before the table starts
    anew; the first ``keep_runs`` runs for as long as the Python worker lives.
    Texts with characters outside Latin-1 go through the tokenizer as a whole.
    ``encode`` equals the tokenizer's own ids.
    """

    def __init__(self, path: str, keep: int = 900_000, keep_runs: int = 60_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings are ordinary text
        size = self.whole.get_vocab_size()
        self.ends = np.array([
            (self.whole.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.plain = Tokenizer.from_file(path)  # for runs that are lower case already
        self.plain.encode_special_tokens = True
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "removed"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.keep, self.keep_runs, self.words, self.runs = keep, keep_runs, {}, {}

    def _ids(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _coded(self, runs: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        parts = [runs[i:i + 500] for i in range(0, len(runs), 500)]
        coded = self.plain.encode_batch_fast(
            [" ".join(p) for p in parts], add_special_tokens=False)
        for part, code in zip(parts, coded):
            ids = np.array(code.ids, dtype="<u4")
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)  # every run has one end
            if len(ends) != len(part):
                found.update((r, self._ids(r)) for r in part)
                continue
            data, at = ids.tobytes(), 0
            for run, cut in zip(part, ends.tolist()):
                found[run] = data[at:cut]
                at = cut
        return found

    def _learn(self, words: set[str]) -> None:
        get, known, rest = self.runs.get, self.words, []
        for word in words:
            text = word.lower()
            ids = get(text)
            if ids is None and text[-1] in ",." and text[-2:-1].isalpha():
                head, tail = get(text[:-1]), get(text[-1])
                ids = head + tail if head is not None and tail is not None else None
            if ids is None:
                rest.append((word, _RUN.findall(text)))
            else:
                known[word] = ids
        new = self._coded([r for r in {r for _, own in rest for r in own} if r not in self.runs])
        if len(self.runs) < self.keep_runs:
            self.runs.update(new)
        for word, own in rest:
            known[word] = b"".join([new[r] if r in new else self.runs[r] for r in own])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > self.keep:
            self.words = {}
        words = [[] if _OTHER.search(t) else t.split() for t in texts]
        coded = [list(map(self.words.get, w)) for w in words]
        new = [[i for i, ids in enumerate(c) if ids is None] for c in coded]
        self._learn({w[i] for w, places in zip(words, new) for i in places})
        for w, c, places in zip(words, coded, new):
            for i in places:
                c[i] = self.words[w[i]]
        return [b"".join(c) if w or not _OTHER.search(t) else self._ids(t)
                for t, w, c in zip(texts, words, coded)]


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(path)


def pieces(
    docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0,
    encoder: Callable[[str], WordEncoder] = word_encoder,
) -> DataFrame:
    """One row per piece of a document: its ids followed by ``end_id``.

    Only documents of more than ``limit`` ids are cut, into pieces of ``limit``;
    the last may be shorter. A null or empty text is the end id alone. Rows with
    equal ids or texts, or a null id, are packed like any other row; further
    columns are ignored.
    """
    key = dict(docs.dtypes)["doc_id"]
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        gc.disable()  # the tables hold many strings and no cycles
        for (ids,), texts in text_chunks(batches, ["doc_id"], "text", 1 << 21):
            out: list[list] = [[], [], [], [], []]
            for doc_id, data in zip(ids.to_pylist(), known.encode([t.decode() for t in texts])):
                data += end
                for piece, at in enumerate(range(0, len(data), 4 * limit)):
                    part = data[at:at + 4 * limit]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], type=kind), pa.array(out[1], pa.int32())]
                + [pa.array(c, pa.int64()) for c in out[2:]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
        known.words = {}
        gc.enable()

    kind = pa.string() if key == "string" else pa.int32() if key == "int" else pa.int64()
    return docs.select("doc_id", "text").mapInArrow(cut, PIECES.format(key=key))


def plan(counts: dict[int, int], limit: int = 2048) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a length histogram.

    Returns slots (length, first rank, ranks, first sequence, pieces of this
    length per sequence, offset of the first of them). Sequences with the same
    free space are handled together: best fit puts as many pieces of a length as
    fit into the fullest sequence that takes one, so a group of n such sequences
    takes n * (free // length) at once. A visit leaves a group less than half
    its space, so there are at most limit * log2(limit) slots or so, whatever
    the counts.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space left: (first, number)
    slots, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(first: int, number: int, space: int) -> None:
            """Fill sequences from ``first`` on, at most ``number`` of them."""
            nonlocal left, rank
            each = space // length
            full = min(number, left // each)
            rest = left - full * each if full < number else 0
            taken = full * each + rest
            slots.append((length, rank, taken, first, each, limit - space))
            if full:
                free[space - full_use(each)].append((first, full))
            if rest:
                free[space - rest * length].append((first + full, 1))
            unused = number - full - bool(rest)
            if unused:
                free[space].append((first + full + bool(rest), unused))
            left, rank = left - taken, rank + taken

        def full_use(each: int) -> int:
            return each * length

        for space in range(length, limit + 1):
            for first, number in free.pop(space, ()):
                if left:
                    place(first, number, space)
                else:
                    free[space].append((first, number))
            if not left:
                break
        if left:
            number = math.ceil(left / (limit // length))
            place(sequences, number, limit)
            sequences += number
    return slots


def pack(cut: DataFrame, limit: int = 2048, rows_per_bucket: int = 2_000) -> DataFrame:
    """Give every piece of ``cut`` a sequence and a place in it.

    ``cut`` is read several times and should be staged. Ranks within a length are
    counted in hashed buckets of about ``rows_per_bucket`` rows, so a length that
    most pieces share does not meet in one task.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    slots = spark.createDataFrame(
        plan(counts, limit) or [(0, 0, 0, 0, 1, 0)],
        "length bigint, rank_from bigint, ranks bigint, first_sequence bigint, each bigint,"
        " used bigint")
    # both tables depend on the sequence length only in their size, so they may be broadcast
    buckets = spark.createDataFrame(
        [(n, math.ceil(k / rows_per_bucket)) for n, k in counts.items()] or [(0, 1)],
        "length bigint, buckets bigint")
    keyed = cut.join(F.broadcast(buckets), "length").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))).drop("buckets")
    before = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "bucket",
        (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("place", F.row_number().over(inside)).join(
        before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place") - 1)
    at = F.col("rank") - F.col("rank_from")
    return ranked.join(
        F.broadcast(slots),
        (ranked["length"] == slots["length"]) & (at >= 0) & (at < F.col("ranks"))
    ).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("first_sequence") + F.floor(at / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("used") + at % F.col("each") * ranked["length"]).cast("bigint").alias("offset"))


def packed(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """Documents to placed pieces; texts are encoded once."""
    return pack(staged(pieces(docs, tokenizer, limit, end_id), "pieces"), limit)
