"""Exact n-gram Jaccard join by vertical partitioning of the n-gram order.

N-grams are ordered by the number of documents that have them, rarest first, and
that order is cut into fragments. A document becomes one segment per fragment;
overlaps are counted fragment by fragment and summed per pair.

The first fragment, n-grams that only one set has, never overlaps with anything.
It is what makes the join cheap: a set that may link must share three quarters of
its n-grams, so sets with more n-grams of their own than that allows go before
any pair is looked at, and the numbers of own n-grams bound the overlap of a pair.

Candidates come from the rarest quarter of each set. A group of k near copies has
k * k / 2 links; only its components are asked for, so every member is first
compared with one leader per n-gram, and other pairs only where they would join
two components and where the overlaps with that leader leave room for a link.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hostweave.llm import shingles
from hostweave.llm.common import free_name, staged, text_chunks
from hostweave.llm.components import components

#: Share of the hash range, in sixteenths, that the first count looks at.
FIRST_PART = 6
TOKENS_PER_FRAGMENT = 1_000_000
FRAGMENTS = 4  # of the order among shared n-grams: df 2-4, 5-16, 17-64, over 64

_PARTS = ["fragment", "tokens", "keys", "counts", "known", "times"]
_CUT = np.uint64(FIRST_PART << 60)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def set_key(tokens: np.ndarray) -> int:
    """One number for a whole set."""
    both = np.array([np.bitwise_xor.reduce(tokens), np.add.reduce(tokens)], dtype=np.uint64)
    both = shingles.mix(both + np.uint64(len(tokens)))
    return int(_signed(both[:1] * np.uint64(0x9E3779B97F4A7C15) + both[1:])[0])


def facts(docs: DataFrame, k: int = 5) -> DataFrame:
    """Per document: its id, a hash of its text, the size of its set and the set's key."""
    fields = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, hashes), texts in text_chunks(batches, ["doc_id", "text_hash"], "text"):
            sets = shingles.shingle_sets(texts, k=k)
            yield pa.RecordBatch.from_arrays([
                ids, hashes,
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([int((s < _CUT).sum()) for s in sets], pa.int64()),
                pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())],
                names=["doc_id", "text_hash", "n", "low", "key"])

    return _with_hash(docs).mapInArrow(
        run, f"doc_id {fields['doc_id']}, text_hash bigint, n bigint, low bigint, key bigint")


def _with_hash(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def _shared_in_part(docs: DataFrame, fragments: int, k: int) -> DataFrame:
    """Per set key, at least the number of n-grams in the low hash range that other sets have.

    A map task sends, for each n-gram, two of its own sets at most: the others
    are known to share it and are counted on the spot. So an n-gram that most
    documents have makes two entries for each chunk, not one for each document.
    """
    width = int(_CUT) // fragments + 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches, [], "text", 1 << 22):
            sets = {set_key(s): s for s in (
                s for i in range(0, len(texts), 256)
                for s in shingles.shingle_sets(texts[i:i + 256], k=k)) if len(s)}
            if not sets:
                continue
            low = [s[:np.searchsorted(s, _CUT)] for s in sets.values()]
            keys = np.repeat(np.array(list(sets), dtype=np.int64), [len(s) for s in low])
            tokens = np.concatenate(low)
            order = np.argsort(tokens, kind="stable")
            tokens, keys = tokens[order], keys[order]
            third = np.zeros(len(tokens), dtype=bool)
            third[2:] = tokens[2:] == tokens[:-2]
            cuts = np.searchsorted(tokens // np.uint64(width), np.arange(fragments + 1, dtype=np.uint64))
            rows: list[list] = [[] for _ in _PARTS]
            for f in np.flatnonzero(np.diff(cuts)).tolist():
                here = slice(cuts[f], cuts[f + 1])
                known, times = np.unique(keys[here][third[here]], return_counts=True)
                t, own = tokens[here][~third[here]], keys[here][~third[here]]
                by_key = np.argsort(own, kind="stable")
                names, counts = np.unique(own, return_counts=True)
                for column, value in zip(rows, (
                        f, t[by_key].tobytes(), names.tobytes(), counts.tobytes(),
                        known.tobytes(), times.tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int32())] + [pa.array(c, pa.binary()) for c in rows[1:]],
                names=_PARTS)

    def count(group: pa.Table) -> pa.Table:
        blobs = {c: b"".join(group.column(c).to_pylist()) for c in _PARTS[1:]}
        number = {c: np.frombuffer(b, dtype=np.int64) for c, b in blobs.items()}
        tokens = number["tokens"]
        keys = np.repeat(number["keys"], number["counts"])
        order = np.lexsort((keys, tokens))
        tokens, keys = tokens[order], keys[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
        tokens, keys = tokens[new], keys[new]
        same = tokens[1:] == tokens[:-1]
        shared = np.zeros(len(tokens), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        keys, counts = np.unique(keys[shared], return_counts=True)
        return pa.table({
            "key": pa.array(np.concatenate([keys, number["known"]]), pa.int64()),
            "shared": pa.array(np.concatenate([counts, number["times"]]), pa.int64())})

    parts = docs.select("text").mapInArrow(split, "fragment int, " + ", ".join(
        f"{c} binary" for c in _PARTS[1:]))
    counted = parts.groupBy("fragment").applyInArrow(count, "key bigint, shared bigint")
    return counted.groupBy("key").agg(F.sum("shared").alias("shared"))


def _own_allowed(n: Column, percent: int) -> Column:
    """How many n-grams a set that links may have that its partner lacks."""
    return F.floor(n * (100 - percent) / 100)


def _may_link(n_a: Column, n_b: Column, overlap: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The sets of ``wanted`` (doc_id, text_hash, key), each once: key, n, tokens."""
    # texts go through a shuffle however few sets are wanted, so cost grows evenly
    texts = _with_hash(docs).join(
        wanted.withColumnsRenamed({"doc_id": "id", "text_hash": "hash"}).hint("merge"),
        F.col("doc_id").eqNullSafe(F.col("id")) & F.col("text_hash").eqNullSafe(F.col("hash"))
    ).dropDuplicates(["id", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (keys,), chunk in text_chunks(batches, ["key"], "text"):
            sets = shingles.shingle_sets(chunk, k=k)
            flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            ends = np.cumsum([0] + [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([
                keys, pa.array(np.diff(ends), pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(flat)))],
                names=["key", "n", "tokens"])

    return texts.select("key", "text").mapInArrow(run, "key bigint, n bigint, tokens array<bigint>")


def _nodes(sets: DataFrame, percent: int) -> DataFrame:
    """Sets that may still link, with their shared n-grams in the global order.

    ``shared`` holds (df, token) rarest first; ``c`` is their number, the other
    n - c n-grams are in no other set here.
    """
    tokens = sets.select("key", "n", F.explode("tokens").alias("token"))
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = tokens.join(df, "token").groupBy("key", "n").agg(
        F.array_sort(F.collect_list(F.struct(F.col("df").cast("int").alias("df"), "token"))).alias("shared"))
    return shared.withColumn("c", F.size("shared").cast("bigint")).where(
        F.col("n") - F.col("c") <= _own_allowed(F.col("n"), percent))


def _entries(nodes: DataFrame, percent: int) -> DataFrame:
    """The n-grams of each set of which a partner must have one: (token, key, n, c)."""
    length = _own_allowed(F.col("n"), percent) + 1 - (F.col("n") - F.col("c"))
    return nodes.select(
        F.explode(F.slice("shared", F.lit(1), length.cast("int"))["token"]).alias("token"),
        "key", "n", "c")


def _segments(nodes: DataFrame) -> DataFrame:
    """Each set cut along the global order: (key, fragment, tokens)."""
    part = lambda x: F.least(
        F.ceil(F.log2(x["df"]) / 2).cast("int"), F.lit(FRAGMENTS)) - 1
    cut = F.transform(
        F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)),
        lambda f: F.struct(f.alias("fragment"), F.transform(
            F.filter("shared", lambda x: part(x) == f), lambda x: x["token"]).alias("tokens")))
    return nodes.select("key", F.explode(F.filter(cut, lambda s: F.size(s["tokens"]) > 0)).alias("s")).select(
        "key", "s.fragment", "s.tokens")


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b) with their overlap: partial counts by fragment, summed."""
    first = segments.withColumnsRenamed({"key": "a", "tokens": "tokens_a"})
    second = segments.withColumnsRenamed({"key": "b", "tokens": "tokens_b"})
    return (
        pairs.join(first, "a").join(second, ["b", "fragment"])
        .groupBy("a", "b", "n_a", "n_b")
        .agg(F.sum(F.size(F.array_intersect("tokens_a", "tokens_b"))).alias("overlap")))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def spanning_links(sets: DataFrame, percent: int = 75) -> DataFrame:
    """Links (a, b) between set keys that have the same components as all links."""
    nodes = staged(_nodes(sets, percent), "jaccard-nodes")
    segments = _segments(nodes)
    entries = staged(_entries(nodes, percent), "jaccard-entries")

    # every set with one leader for each of its n-grams: the set with fewest n-grams of its own
    leaders = entries.groupBy("token").agg(
        F.min(F.struct((F.col("n") - F.col("c")) / F.col("n"), F.col("key"), F.col("n"), F.col("c"))).alias("l"),
        F.count(F.lit(1)).alias("k")).where("k > 1").select(
        "token", F.col("l.key").alias("a"), F.col("l.n").alias("n_a"), F.col("l.c").alias("c_a"))
    bound = F.least("c_a", "c_b")
    members = entries.withColumnsRenamed({"key": "b", "n": "n_b", "c": "c_b"})
    led = members.join(leaders, "token").where(F.col("a") != F.col("b"))
    tested = staged(_overlaps(_pairs(led.where(
        _may_link(F.col("n_a"), F.col("n_b"), bound, percent))), segments), "jaccard-led")
    found = tested.where(_may_link(F.col("n_a"), F.col("n_b"), F.col("overlap"), percent)).select("a", "b")

    # other pairs with the same leader, unless they are in one component or have no room for a
    # link: what both share with the leader, and what both may share besides, bounds the overlap
    label = components(found, "jaccard-led")
    known = (
        led.groupBy("a", "b").agg(F.first("n_b").alias("n"), F.first("c_b").alias("c"))
        .join(tested.select("a", "b", F.col("overlap").alias("x")), ["a", "b"], "left")
        .join(label.withColumnsRenamed({"node": "b", "component": "comp"}), "b", "left")
        .join(label.withColumnsRenamed({"node": "a", "component": "lead"}), "a", "left")
        .select(F.col("a").alias("leader"), F.col("b").alias("key"), "n", "c", "x",
                F.coalesce("comp", "b").alias("comp"),
                (F.coalesce("comp", "b") == F.coalesce("lead", "a")).alias("main")))
    known = staged(known, "jaccard-known")
    one = known.where(~F.col("main")).select(
        "leader", *[F.col(c).alias(f"{c}_a") for c in ("key", "n", "c", "x", "comp")])
    other = known.select(
        "leader", *[F.col(c).alias(f"{c}_b") for c in ("key", "n", "c", "x", "comp", "main")])
    room = F.when(
        F.col("x_a").isNull() | F.col("x_b").isNull(), F.least("c_a", "c_b")).otherwise(
        F.least("x_a", "x_b") + F.least(F.col("c_a") - F.col("x_a"), F.col("c_b") - F.col("x_b")))
    crossing = one.join(other, "leader").where(
        (F.col("comp_a") != F.col("comp_b")) & (F.col("main_b") | (F.col("key_a") < F.col("key_b")))
        & _may_link(F.col("n_a"), F.col("n_b"), room, percent))
    rest = _overlaps(_pairs(crossing.select(
        F.col("key_a").alias("a"), F.col("key_b").alias("b"), "n_a", "n_b")), segments).where(
        _may_link(F.col("n_a"), F.col("n_b"), F.col("overlap"), percent)).select("a", "b")
    return staged(found.union(rest), "jaccard-links")


def jaccard_components(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    Words are runs of anything but ASCII white space, A-Z as a-z; a document's
    set holds its distinct ``k``-word shingles, or its whole sequence if it has
    fewer words. Two documents link when 100 * intersection >= percent * union;
    ``component_id`` is the smallest doc_id reached by links. Documents without
    words link with nothing and keep their own id. Rows with equal sets are one
    set throughout. A null doc_id gets a row, but is never a component's smallest
    unless all are null. Several rows with one doc_id are several documents.
    Columns beyond doc_id and text are ignored.
    """
    own, sets = _components(docs, percent, k)
    ids = sets.select("key", F.col("least.doc_id").alias("component_id"))
    return own.join(ids, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with all columns.

    It is the row with the smallest doc_id (null last, then by the text's hash);
    exact copies of that row count as one. Rows without words all stay.
    """
    own, sets = _components(docs, percent, k)
    empty = own.where("key is null").select("doc_id", "text_hash").distinct()
    chosen = staged(sets.select("least.doc_id", "least.text_hash").distinct().withColumn("once", F.lit(True))
                    .union(empty.withColumn("once", F.lit(False))), "jaccard-chosen")
    own, own_hash, once, text, place = (
        free_name(docs.columns, stem) for stem in ("__id", "__hash", "__once", "__text", "__place"))
    picked = chosen.withColumnsRenamed({"doc_id": own, "text_hash": own_hash, "once": once})
    rows = docs.withColumn(text, F.xxhash64("text")).join(
        picked.hint("merge"), F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(text) == F.col(own_hash)))
    # one row of each chosen (id, text); rows without words are all kept
    number = F.row_number().over(Window.partitionBy(own, own_hash).orderBy(F.lit(0)))
    return rows.withColumn(place, number).where((F.col(place) == 1) | ~F.col(once)).select(*docs.columns)


def _components(docs: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Facts of each document, and for each set key the least document of its component."""
    own = staged(facts(docs, k), "jaccard-facts")
    letters = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(1, math.ceil(letters / 6 * FIRST_PART / 16 / TOKENS_PER_FRAGMENT))
    shared = _shared_in_part(docs, fragments, k)
    by_key = own.where("key is not null").groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one"),
        F.first("n").alias("n"), F.first("low").alias("low"))
    wanted = staged(by_key.join(shared, "key", "left").where(
        F.col("low") - F.coalesce("shared", F.lit(0)) <= _own_allowed(F.col("n"), percent)
    ).select("one.doc_id", "one.text_hash", "key"), "jaccard-wanted")
    # a key comes twice only where one id has several texts with the same set
    links = spanning_links(staged(
        _sets(docs, wanted, k).dropDuplicates(["key"]), "jaccard-sets"), percent)
    label = components(links, "jaccard")
    marked = by_key.select("key", "one").join(
        label.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key"))
    least = marked.groupBy("component").agg(F.min("one").alias("least"))
    return own, marked.join(least, "component").select("key", "least")
