"""How far the sources of a language lie apart, by term frequencies, in exact integers.

Each kept term has a count level in every source. Indicator columns for (source,
level) over a block of terms, multiplied by their transpose, give the joint table
of levels of every pair of sources at once: how many terms have level a here and
level b there. A pair's value is the sum over its table of terms times the price
of two levels, so prices are taken per pair of levels, not per term.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from hostweave.llm.common import staged, text_chunks

SCALE = 1_000_000_000
LEAST_DOCS = 10
TOP = 10
#: Terms of a block, sources of a tile, and indicator columns of one product.
BLOCK_TERMS, TILE, COLUMNS = 4096, 64, 512

#: Bytes that are no part of a term become spaces, A-Z lower case, all other bytes stay.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def term_counts(docs: DataFrame, entries: int = 300_000) -> DataFrame:
    """Partial counts (lang, source, term, n, n_docs), to be summed by those keys.

    Terms are runs of letters of ASCII and all other characters, A-Z in lower
    case. Null text, lang and source are read as ''. A task sums up to ``entries``
    keys before it hands them on, so a hot source is small before any shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple, Counter] = {}
        within: dict[tuple, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), counted in times.items():
                terms = list(counted)
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(pa.scalar(lang, pa.string()), len(terms)),
                    pa.repeat(pa.scalar(source, pa.string()), len(terms)),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(np.fromiter(counted.values(), np.int64, len(terms))),
                    pa.array(np.fromiter(map(within[lang, source].__getitem__, terms), np.int64, len(terms)))],
                    names=["lang", "source", "term", "n", "n_docs"])
            times.clear()
            within.clear()

        held = 0
        for (langs, sources), texts in text_chunks(batches, ["lang", "source"], "text"):
            for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts):
                words = text.translate(_FOLD).split()
                if not words:
                    continue
                key = (lang or "", source or "")
                counted = times.setdefault(key, Counter())
                seen = within.setdefault(key, Counter())
                held -= len(counted)
                counted.update(words)
                seen.update(set(words))
                held += len(counted)
                if held > entries:
                    yield from out()
                    held = 0
        yield from out()

    return docs.select(
        F.col("lang").cast("string"), F.col("source").cast("string"), "text"
    ).mapInArrow(run, "lang string, source string, term string, n bigint, n_docs bigint")


def kept_terms(partial: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Rows (lang, source, term, n, n_lang, first) of the terms in at least ``least`` documents of a language.

    ``n_lang`` is the term's count over all sources of the language; ``first`` marks
    one row of each term. One shuffle by term serves both sums.
    """
    term = Window.partitionBy("lang", "term")
    summed = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    return summed.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("n_lang"),
        F.sum("n_docs").over(term).alias("docs"), (F.min("source").over(term) == F.col("source")).alias("first")
    ).where(F.col("docs") >= least).drop("docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)); null without terms."""
    whole = F.nullif(total + 2 * terms, F.lit(0).cast("bigint"))
    return F.lit(1).cast("bigint") + F.call_function("div", (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast(
        "decimal(10,0)"), whole.cast("decimal(20,0)"))


def price(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1, so nothing overflows."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Every (lang, source) with its size, its place among the language's sources and the price basis of level 0."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = entries.groupBy("lang").agg(
        F.sum(F.col("first").cast("bigint")).alias("terms"), F.sum("n").alias("lang_total"))
    zero = F.lit(0).cast("bigint")
    return read.distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")],
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place"),
        F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("sources")
    ).withColumn("p0", share(zero, F.col("total"), F.col("terms")))


def _products(rows: np.ndarray, places: np.ndarray, prices: np.ndarray, zeros: dict[int, int], order: np.ndarray
              ) -> Iterator[tuple[np.ndarray, ...]]:
    """Joint tables of slabs of terms, as cells (place_a, p_a, place_b, p_b, terms) with place_a < place_b.

    A slab is a run of terms in ``order`` whose indicator columns number COLUMNS at
    most (one term always fits). Terms of like counts share levels, so they are
    handled together. Every source has a column for level 0.
    """
    sources = np.array(sorted(zeros), dtype=np.int64)
    at = np.searchsorted(sources, places)
    base = np.array([zeros[s] for s in sources.tolist()], dtype=np.int64)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    own = rank[rows]
    sort = np.argsort(own, kind="stable")
    own, at, prices = own[sort], at[sort], prices[sort]
    starts = np.searchsorted(own, np.arange(len(order) + 1))
    term = 0
    while term < len(order):
        columns: set[tuple[int, int]] = set()
        end = term
        while end < len(order):
            more = set(zip(at[starts[end]:starts[end + 1]].tolist(), prices[starts[end]:starts[end + 1]].tolist()))
            if end > term and len(columns | more) + len(sources) > COLUMNS:
                break
            columns |= more
            end += 1
        cut = slice(starts[term], starts[end])
        found = sorted(columns)
        code = {c: len(sources) + i for i, c in enumerate(found)}
        one_hot = np.zeros((end - term, len(sources) + len(found)), dtype=np.float32)
        one_hot[:, :len(sources)] = 1
        line = own[cut] - term
        one_hot[line, at[cut]] = 0
        one_hot[line, [code[c] for c in zip(at[cut].tolist(), prices[cut].tolist())]] = 1
        product = one_hot.T @ one_hot  # whole numbers up to BLOCK_TERMS: exact
        of = np.concatenate([np.arange(len(sources)), np.array([c[0] for c in found], dtype=np.int64)])
        cost = np.concatenate([base, np.array([c[1] for c in found], dtype=np.int64)])
        product[of[:, None] >= of[None, :]] = 0
        a, b = np.nonzero(product)
        yield sources[of[a]], cost[a], sources[of[b]], cost[b], product[a, b].astype(np.int64)
        term = end


def joint_tables(entries: DataFrame, members: DataFrame) -> DataFrame:
    """Cells (lang, place_a, p_a, place_b, p_b, n_terms) of the joint level tables, place_a < place_b.

    ``entries`` has (lang, source, term, n), ``members`` the result of ``groups``. A
    level is given by its price basis p. Terms are dealt to blocks by hash and
    sources to tiles; each pair of tiles of a block is one product of bounded size.
    The cells of a pair are to be summed over blocks; terms that neither tile of a
    pair holds are not counted, they have level 0 on both sides.
    """
    blocks = F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1))
    tiles = F.ceil(F.col("sources") / TILE).cast("int")
    about = members.select("lang", "source", "place", "total", "terms", "p0", tiles.alias("tiles"), blocks.alias("blocks"))
    counted = entries.select("lang", "source", "term", "n").join(about, ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "term", "n", "place",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "tiles")
    empty = about.where(F.col("terms") > 0).select(
        "lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"),
        F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n"), "place",
        F.col("p0").alias("p"), "tiles")
    tile = F.floor(F.col("place") / TILE).cast("int")
    tiled = counted.unionByName(empty).select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).select(
        "lang", "block", F.least(tile, "other").alias("tile_a"), F.greatest(tile, "other").alias("tile_b"),
        "term", "n", "place", "p")

    def multiply(key: tuple, table: pa.Table) -> pa.Table:
        zero = pc.is_null(table["term"])
        marks = table.filter(zero)
        zeros = dict(zip(marks["place"].to_pylist(), marks["p"].to_pylist()))
        held = table.filter(pc.invert(zero))
        cells: list[tuple[np.ndarray, ...]] = []
        if held.num_rows:
            terms = held["term"].combine_chunks().dictionary_encode()
            rows = terms.indices.to_numpy()
            size = np.bincount(rows, weights=held["n"].to_numpy())
            cells = list(_products(
                rows, held["place"].to_numpy(), held["p"].to_numpy(), zeros, np.argsort(-size, kind="stable")))
        a, p, b, q, n = (np.concatenate(c) for c in zip(*cells)) if cells else (np.zeros(0, np.int64),) * 5
        # a pair of two tiles has the pairs within each tile too; those belong to (tile, tile)
        if key[2].as_py() != key[3].as_py():
            across = a // TILE != b // TILE
            a, p, b, q, n = a[across], p[across], b[across], q[across], n[across]
        return pa.table({
            "lang": pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(a)), "place_a": pa.array(a), "p_a": pa.array(p),
            "place_b": pa.array(b), "p_b": pa.array(q), "n_terms": pa.array(n)})

    return tiled.groupBy("lang", "block", "tile_a", "tile_b").applyInArrow(
        multiply, "lang string, place_a bigint, p_a bigint, place_b bigint, p_b bigint, n_terms bigint")


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every group (lang, source).

    Part ``pair``: each other source of the language, by falling value; sources of a
    language without kept terms have value 0. Part ``term``: the ``top`` terms that
    the group uses more than its language does. Ties go by the UTF-8 order of the
    item. Null text, lang and source are read as ''; repeated rows are documents of
    their own; other columns are ignored; an empty table has no rows. All sums and
    quotients are whole numbers.
    """
    entries = staged(kept_terms(term_counts(docs), least), "entries")
    members = staged(groups(docs, entries), "groups")
    priced = joint_tables(entries, members).groupBy("lang", "place_a", "place_b").agg(
        F.sum(F.col("n_terms") * price(F.col("p_a"), F.col("p_b"))).alias("value"),
        F.sum("n_terms").alias("covered"))
    one = members.select("lang", "source", F.col("place").cast("bigint").alias("place_a"), F.col("p0").alias("zero_a"), "terms")
    two = members.select("lang", F.col("source").alias("item"), F.col("place").cast("bigint").alias("place_b"), F.col("p0").alias("zero_b"))
    zero = F.lit(0).cast("bigint")
    rest = (F.col("terms") - F.coalesce("covered", zero)) * F.coalesce(price(F.col("zero_a"), F.col("zero_b")), zero)
    half = staged(
        one.join(two, "lang").where(F.col("place_a") < F.col("place_b"))
        .join(priced, ["lang", "place_a", "place_b"], "left")
        .select("lang", "source", "item", (F.coalesce("value", zero) + rest).alias("value")), "pairs")
    pairs = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(own).alias("rank"))
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("n_lang"), F.col("lang_total"), F.col("terms"))
    terms = entries.join(members, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")).where(
        F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
    return pairs.unionByName(
        terms.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top))
