"""Finding short test items inside long documents: size-partitioned MinHash containment.

MinHash estimates Jaccard similarity, which a short item has with no long
document. So items are put into classes by size, and for each class a document is
read in overlapping windows of about that size: an item of q shingles, with
2**(c-1) < q <= 2**c, lies wholly in one of the windows of 2**(c+1) shingles that
start every 2**c. Its Jaccard similarity with that window is bounded from below,
whatever the document's length, and so is the probability that a band collides.
Every candidate is verified by exact containment in the document's shingles.

A band is one hash function: it collides where item and window have the same
smallest shingle. That shingle must lie in the window, so only windows around the
items' smallest shingles need a signature; no other window can collide. Items of
fewer words than a shingle are looked up as they are.
"""

import functools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostweave.llm import shingles
from hostweave.llm.common import free_name, text_chunks

#: Hash functions. At a containment of 0.75 the similarity with the best window is
#: at least 0.176, so a pair is missed with a probability of (1 - 0.176)**48 < 1e-4.
BANDS = 48
#: Items searched for in one pass over the documents.
ITEMS_PER_BLOCK = 20_000

_U = np.uint64
_SEEDS = np.random.default_rng(9).integers(1, 1 << 63, BANDS, dtype=_U)


def signature(tokens: np.ndarray) -> np.ndarray:
    """For each hash function the shingle with the smallest hash."""
    return tokens[shingles.mix(tokens[None, :] ^ _SEEDS[:, None]).argmin(axis=1)]


class ItemIndex:
    """Bands of a block of items: (class, function, smallest shingle) to items."""

    def __init__(self, texts: list[bytes], percent: int, k: int):
        self.percent, self.k = percent, k
        self.sets = shingles.shingle_sets(texts, shingles.SPACE_AND_PUNCTUATION, k) if texts else []
        self.bands: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        #: Items of fewer than k words, by their number and the hash of them all.
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        words, counts = shingles.word_hashes(texts, shingles.SPACE_AND_PUNCTUATION) if texts else ((), np.zeros(0, int))
        ends = np.cumsum(counts)
        keys = []
        for i, own in enumerate(self.sets):
            n = int(counts[i])
            if 0 < n < k:
                whole = shingles.shingle_hashes(words[ends[i] - n:ends[i]], counts[i:i + 1], n)[0]
                self.short[n][int(whole[0])].append(i)
            elif len(own):
                least = signature(own)
                keys.append(least)
                size = max(0, math.ceil(math.log2(len(own))))
                for j, value in enumerate(least.tolist()):
                    self.bands[size][j, value].append(i)
        self.keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=_U)
        self.bands = {size: dict(found) for size, found in self.bands.items()}

    def candidates(self, tokens: np.ndarray, hits: np.ndarray) -> set[int]:
        """Items with a band that collides with a window around one of the ``hits``."""
        found: set[int] = set()
        for size, bands in self.bands.items():
            stride = 1 << size
            # the windows that start at the stride before a hit, and one before that
            starts = np.unique(np.concatenate([hits // stride, hits // stride - 1])) * stride
            for start in starts[(starts >= 0) | (starts == starts.max())].tolist():
                window = tokens[max(0, start):max(0, start) + 2 * stride]
                for j, value in enumerate(signature(window).tolist()):
                    found.update(bands.get((j, value), ()))
        return found

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, shingles of the item, of these in the text)."""
        words, counts = shingles.word_hashes(texts, shingles.SPACE_AND_PUNCTUATION)
        yield from self._search_short(words, counts)
        if not len(self.keys):
            return
        hashes, numbers = shingles.shingle_hashes(words, counts, self.k)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hits = np.flatnonzero(self.keys[at] == hashes)
        first = np.cumsum(numbers) - numbers
        owner = np.repeat(np.arange(len(texts)), numbers)[hits]
        for text in np.unique(owner).tolist():
            own = hashes[first[text]:first[text] + numbers[text]]
            for item in sorted(self.candidates(own, hits[owner == text] - first[text])):
                wanted = self.sets[item]
                shared = int(np.isin(wanted, own).sum())
                if 100 * shared >= self.percent * len(wanted):
                    yield text, item, len(wanted), shared


    def _search_short(self, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Items of n < k words are looked up among the runs of n words of every text."""
        for n, items in self.short.items():
            hashes, numbers = shingles.shingle_hashes(words, counts, n)
            owner = np.repeat(np.arange(len(counts)), numbers)
            wanted = np.array(sorted(items), dtype=_U)
            at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
            hits = np.flatnonzero(wanted[at] == hashes)
            for text, value in sorted(set(zip(owner[hits].tolist(), hashes[hits].tolist()))):
                if counts[text] >= n:
                    yield from ((text, item, 1, 1) for item in items[value])


def contained_items(
    docs: DataFrame, items: DataFrame, percent: int = 75, k: int = 5,
    items_per_block: int = ITEMS_PER_BLOCK,
) -> DataFrame:
    """Rows (doc_id, item_id, n_item, n_shared): items of which a document has enough.

    Words are runs of letters, digits and non-ASCII characters, A-Z as a-z; an
    item is in a document when at least ``percent`` of its distinct ``k``-word
    shingles are. An item with fewer words is its only shingle, and in every document
    that has all of its words one after the other; null, empty and wordless texts
    match nothing. Equal items are searched for once each, repeated documents
    give repeated rows, null ids are kept. The items are read in blocks of about
    ``items_per_block``, each against all documents; other columns are ignored.
    """
    return _found(docs, ["doc_id"], items, percent, k, items_per_block)


def _found(
    docs: DataFrame, carried: list[str], items: DataFrame, percent: int, k: int,
    items_per_block: int = ITEMS_PER_BLOCK,
) -> DataFrame:
    """``contained_items`` with the columns ``carried`` of the documents."""
    fields = dict(docs.dtypes)
    schema = "".join(f"{c} {fields[c]}, " for c in carried) + f"item_id {dict(items.dtypes)['item_id']}"
    spark = docs.sparkSession
    wanted = items.where("text is not null").select("item_id", "text").distinct()
    blocks = max(1, math.ceil(wanted.count() / items_per_block))
    found = []
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        shipped = spark.sparkContext.broadcast(
            ([r["item_id"] for r in rows], [r["text"].encode() for r in rows]))
        found.append(docs.select(*carried, "text").mapInArrow(
            functools.partial(_search, shipped, carried, percent, k),
            f"{schema}, n_item bigint, n_shared bigint"))
    return functools.reduce(DataFrame.union, found)


def _search(shipped, carried, percent, k, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts = shipped.value
    index = ItemIndex(texts, percent, k)
    item_type = pa.string() if any(isinstance(i, str) for i in ids) else pa.int64()
    names = pa.array(ids, item_type)
    for docs, chunk in text_chunks(batches, carried, "text"):
        rows = list(index.search(chunk))
        text, item, size, shared = (pa.array([r[i] for r in rows], pa.int64()) for i in range(4))
        yield pa.RecordBatch.from_arrays(
            [*(c.take(text) for c in docs), names.take(item), size, shared],
            names=[*carried, "item_id", "n_item", "n_shared"])


def without_items(docs: DataFrame, items: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """The documents in which no item was found, each row by its own text.

    Rows are told apart by doc_id and a 64-bit hash of the text, so a null or
    repeated doc_id takes no row without an item along. All columns stay, whatever their names.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("__hash"))
    own, own_hash = free_name(docs.columns, "__bad"), free_name(docs.columns, "__bad_hash")
    bad = _found(keyed, ["doc_id", "__hash"], items, percent, k).select(
        F.col("doc_id").alias(own), F.col("__hash").alias(own_hash)).distinct()
    return docs.join(
        bad, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64(docs["text"]) == F.col(own_hash)), "left_anti")
