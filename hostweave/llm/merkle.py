"""Merkle manifest of a table: a hash tree by source, with a proof for every row.

Ranks are written in digits of base 16. Within a bounded block of 256 consecutive
nodes the two lowest digits are grouped away one after the other, and every parent
keeps its children as nested structs. A block's own hash is a node of the next
round, until one node is left. On the way back the proofs come out of the nested
rows by transform and explode; only rows that stand for whole blocks are joined.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostweave.llm.common import staged

FAN = 16
BLOCK = FAN * FAN
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(columns: Mapping[str, Column | str]) -> Column:
    """Lowercase hex sha256 of the fields of a row, in the order of LEAF_COLUMNS."""
    values = [columns[c] if isinstance(columns[c], Column) else F.col(columns[c]) for c in LEAF_COLUMNS]
    return F.sha2(F.concat(*map(field, values)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def ranked(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Add ``rank`` from 0 within ``group`` and ``total``, the rows of the group.

    Rows are sorted over all tasks by range; a row's rank is its place in its task
    plus the rows of its group in earlier tasks. No group has to fit one task.
    Nulls come first, strings in the order of their UTF-8 bytes.
    """
    serial, part, first, size, before = "__serial", "__part", "__first", "__size", "__before"
    spread = staged(
        rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
        .withColumn(serial, F.monotonically_increasing_id()), name)
    runs = spread.groupBy(F.col(group).alias("__group"), F.shiftright(serial, 33).alias(part)).agg(
        F.min(serial).alias(first), F.count(F.lit(1)).alias(size))
    all_of = Window.partitionBy("__group")
    runs = runs.select(
        "__group", F.col(part).alias("__of"), first,
        F.coalesce(F.sum(size).over(
            all_of.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before),
        F.sum(size).over(all_of).alias("total"))
    return spread.join(
        runs, (F.shiftright(serial, 33) == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group"))
    ).withColumn("rank", F.col(serial) - F.col(first) + F.col(before)).drop(
        serial, "__of", "__group", first, before)


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda n: n["hash"]), "")


def rolled(nodes: DataFrame, group: str, carried: Sequence[str] = ()) -> DataFrame:
    """One row per block of 256 nodes: (group, block, total, hash, runs, next_total).

    ``nodes`` has (group, rank, total, hash) and the carried columns, which stay
    with the innermost structs. A level whose group has one node only is skipped,
    as the definition of the tree asks.
    """
    kid = F.struct(F.col("rank").bitwiseAND(FAN - 1).alias("digit"), "hash", *carried)
    block = F.shiftright("rank", 8)
    runs = nodes.select(
        group, "total", block.alias("block"), F.shiftright("rank", 4).bitwiseAND(FAN - 1).alias("digit"),
        kid.alias("kid")
    ).repartition(group, "block").groupBy(group, "block", "digit").agg(
        F.first("total").alias("total"), F.sort_array(F.collect_list("kid")).alias("kids")
    ).withColumn("hash", F.when(F.col("total") > 1, F.sha2(_joined(F.col("kids")), 256)).otherwise(
        F.col("kids")[0]["hash"]))
    return runs.groupBy(group, "block").agg(
        F.first("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("digit", "hash", "kids"))).alias("runs")
    ).withColumn("hash", F.when(F.col("total") > FAN, F.sha2(_joined(F.col("runs")), 256)).otherwise(
        F.col("runs")[0]["hash"])
    ).withColumn("next_total", F.when(F.col("total") > FAN, F.ceil(F.col("total") / BLOCK)).otherwise(F.lit(1)))


def _step(nodes: Column, at: Column) -> Column:
    """What stands left and right of a node among its siblings."""
    hashes = F.transform(nodes, lambda n: n["hash"])
    return F.struct(
        F.array_join(F.slice(hashes, F.lit(1), at), "").alias("left"),
        F.array_join(F.slice(hashes, at + 2, F.lit(FAN)), "").alias("right"))


def unrolled(blocks: DataFrame, group: str, upper: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """The nodes of ``rolled`` with their ``path``: (left, right) of each level up to the root.

    ``blocks`` also has the block's own path and the columns ``upper`` of its group.
    """
    none = F.array().cast(_PATH)

    def path(above: bool, nodes: Column, at: Column, rest: Column, total: Column) -> Column:
        own = F.when(total > (FAN if above else 1), F.array(_step(nodes, at))).otherwise(none)
        return F.concat(own, rest)

    runs = blocks.select(
        group, "block", "total", *upper, F.explode(F.transform(F.col("runs"), lambda r, i: F.struct(
            r["digit"].alias("digit"), r["kids"].alias("kids"),
            path(True, F.col("runs"), i, F.col("path"), F.col("total")).alias("path")))).alias("run"))
    kids = runs.select(
        group, "block", *upper, F.col("run.digit").alias("digit"), F.explode(F.transform(
            F.col("run.kids"), lambda k, i: F.struct(
                k["digit"].alias("low"), k["hash"].alias("hash"), *[k[c].alias(c) for c in carried],
                path(False, F.col("run.kids"), i, F.col("run.path"), F.col("total")).alias("path")))).alias("kid"))
    return kids.select(
        group, *upper, (F.col("block") * BLOCK + F.col("digit") * FAN + F.col("kid.low")).alias("rank"),
        "kid.hash", *[F.col(f"kid.{c}").alias(c) for c in carried], "kid.path")


def _levels(nodes: DataFrame, group: str, carried: Sequence[str], name: str) -> list[DataFrame]:
    """Staged rounds of ``rolled``, the last with one row per group; one number a round goes to the driver."""
    levels = [staged(rolled(nodes, group, carried), name)]
    while (levels[-1].agg(F.max("next_total")).first()[0] or 1) > 1:
        levels.append(staged(rolled(levels[-1].select(
            group, F.col("block").alias("rank"), F.col("next_total").alias("total"), "hash"), group), name))
    return levels


def _paths(levels: list[DataFrame], top: DataFrame, group: str, upper: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Down again: ``top`` has (group, path, upper columns), one row per group."""
    above = top.withColumn("rank", F.lit(0).cast("bigint"))
    for i, blocks in reversed(list(enumerate(levels))):
        key = above.select(F.col(group).alias("__group"), F.col("rank").alias("__rank"), "path", *upper)
        met = blocks.join(key, F.col(group).eqNullSafe(F.col("__group")) & (F.col("block") == F.col("__rank")))
        above = unrolled(met, group, upper, carried if i == 0 else ())
    return above


def manifest(docs: DataFrame, carried: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows (doc_id, source, leaf, path, subroot, root) and the carried columns, one per row of ``docs``.

    Leaves of a source are ordered by doc_id (null first), then leaf; runs of 16
    become the hash of their joined hex digests until one node, the subroot, is
    left. Subroots ordered by source (null first) give the root the same way.
    ``path`` holds for every level from leaf to root the digests left and right of
    the node, so H(left + node + right) leads to the root. Equal rows are leaves of
    their own, interchangeable; an empty table has no rows. ``carried`` are further
    expressions over ``docs`` to keep with each leaf; other columns are ignored.
    """
    carried = dict(carried or {})
    names = ["doc_id", *carried]
    leaves = staged(docs.select(
        "doc_id", "source", leaf_hash({c: c for c in LEAF_COLUMNS}).alias("hash"),
        *[c.alias(n) for n, c in carried.items()], F.monotonically_increasing_id().alias("__tie")), "leaves")
    sources = _levels(
        ranked(leaves, "source", ["doc_id", "hash", "__tie"], "ranked"), "source", names, "runs")
    subroots = sources[-1].select("source", "hash", F.lit(0).alias("whole"))
    tree = _levels(ranked(subroots, "whole", ["source"], "subroots"), "whole", ["source"], "roots")
    whole = tree[-1].select("whole", F.array().cast(_PATH).alias("path"), F.col("hash").alias("root"))
    top = staged(
        _paths(tree, whole, "whole", ["root"], ["source"])
        .select("source", "path", F.col("hash").alias("subroot"), "root"), "tops")
    return _paths(sources, top, "source", ["subroot", "root"], names).select(
        "doc_id", "source", F.col("hash").alias("leaf"), *carried, "path", "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All sibling digests of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def audited(docs: DataFrame, every: int = 5) -> DataFrame:
    """Proofs of all rows, checked against a copy with some texts altered.

    Where ``every`` divides the crc32 of the decimal doc_id (null: never) the copy
    has its A-Z in lower case; nulls stay. ``folded_root`` follows the original
    siblings from the copy's leaf and ``verified`` tells whether it is the root.
    """
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    copy = F.when(altered, leaf_hash({c: c for c in LEAF_COLUMNS} | {"text": lower_ascii(F.col("text"))}))
    rows = manifest(docs, {"copied": copy})
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        folded(F.coalesce("copied", "leaf"), F.col("path")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
