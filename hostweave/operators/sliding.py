"""Sliding windows over panes without copying a pane to every window that covers it.

The time line is cut into blocks as long as a window, N panes each. A window that
starts in one block and ends in the next is the suffix of the first block from its
start on, merged with the prefix of the second up to its end. So every pane leaves
one suffix and one prefix aggregate of its key, whatever N is, and the value of a
key is constant between the few starts where one of the two changes. Only the rows
of the result are written out once for each window, after the last shuffle.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostweave.functions.timefn import floor_div, from_micros, to_micros

_PANE, _BLOCK, _FROM, _SUFFIX, _PREFIX = "__pane", "__block", "__from", "__suffix", "__prefix"

#: How values of panes merge: over a frame, and two of them.
MERGES = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def numbered_panes(panes: DataFrame, window: str, step_seconds: int, n: int) -> DataFrame:
    """Add the pane's number since 1970 and its block of ``n`` panes."""
    numbered = panes.withColumn(_PANE, floor_div(to_micros(window), step_seconds * 1_000_000))
    return numbered.withColumn(_BLOCK, floor_div(F.col(_PANE), n))


def changes(numbered: DataFrame, keys: Sequence[str], values: Mapping[str, str], n: int) -> DataFrame:
    """Where the suffix or the prefix part of a key's windows changes: three rows a pane at most.

    ``__block`` is the block that the windows start in, ``__from`` the first start
    that the row holds for. A suffix that is null in its field ``known`` has ended.
    """
    group = Window.partitionBy(*keys, _BLOCK)
    up = group.orderBy(_PANE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = group.orderBy(F.desc(_PANE)).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def part(frame) -> Column:
        return F.struct(F.lit(True).alias("known"), *[
            MERGES[kind][0](name).over(frame).alias(name) for name, kind in values.items()])

    own = numbered.select(
        *keys, _PANE, _BLOCK, part(down).alias(_SUFFIX), part(up).alias(_PREFIX),
        F.lag(_PANE).over(group.orderBy(_PANE)).alias("__before"),
        F.lead(_PANE).over(group.orderBy(_PANE)).alias("__after"))
    pane, block = F.col(_PANE), F.col(_BLOCK)
    none = F.lit(None).cast(own.schema[_SUFFIX].dataType)
    ended = F.struct(F.lit(None).cast("boolean").alias("known"), *[
        F.lit(None).cast(own.schema[_SUFFIX].dataType[name].dataType).alias(name) for name in values])

    def row(block: Column, start: Column, suffix: Column, prefix: Column) -> Column:
        return F.struct(block.alias(_BLOCK), start.alias(_FROM), suffix.alias(_SUFFIX), prefix.alias(_PREFIX))

    last = block * n + (n - 1)
    rows = F.array(
        row(block, F.coalesce(F.col("__before") + 1, block * n), F.col(_SUFFIX), none),
        F.when(F.col("__after").isNull() & (pane < last), row(block, pane + 1, ended, none)),
        F.when(pane < last, row(block - 1, pane - (n - 1), none, F.col(_PREFIX))))
    return own.select(*keys, F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("__r")).select(*keys, "__r.*")


def _constant_stretches(rows: DataFrame, keys: Sequence[str], values: Mapping[str, str], n: int) -> DataFrame:
    """(keys, __block, __from, __to, values): stretches of window starts with one value each."""
    order = Window.partitionBy(*keys, _BLOCK).orderBy(_FROM)
    so_far = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    s, p = F.last(_SUFFIX, True).over(so_far), F.last(_PREFIX, True).over(so_far)
    end = F.coalesce(F.lead(_FROM).over(order) - 1, F.col(_BLOCK) * n + (n - 1))
    known = rows.select(*keys, _BLOCK, _FROM, end.alias("__to"), s.alias(_SUFFIX), p.alias(_PREFIX))
    return known.where((F.col("__to") >= F.col(_FROM)) & (
        F.col(f"{_SUFFIX}.known").isNotNull() | F.col(f"{_PREFIX}.known").isNotNull())).select(
        *keys, _BLOCK, _FROM, "__to", *[
            MERGES[kind][1](F.col(f"{_SUFFIX}.{name}"), F.col(f"{_PREFIX}.{name}")).alias(name)
            for name, kind in values.items()])


def _open_starts(numbered: DataFrame, n: int) -> DataFrame:
    """(__block, __open): for each block with panes, which of its n panes are not empty."""
    panes = numbered.select(_BLOCK, _PANE).distinct()
    every = panes.select(_BLOCK).distinct().select(_BLOCK, F.explode(
        F.sequence(F.col(_BLOCK) * n, F.col(_BLOCK) * n + (n - 1))).alias(_PANE))
    marked = every.join(panes.select(_BLOCK, _PANE, F.lit(True).alias("__is")), [_BLOCK, _PANE], "left")
    return marked.groupBy(_BLOCK).agg(F.transform(
        F.sort_array(F.collect_list(F.struct(_PANE, F.coalesce("__is", F.lit(False)).alias("is")))),
        lambda x: x["is"]).alias("__open"))


def sliding(
    panes: DataFrame, keys: Sequence[str], values: Mapping[str, str], seconds: int, step_seconds: int = 1,
    window: str = "window_start",
) -> DataFrame:
    """Windows of ``seconds`` that start at every non-empty pane of ``step_seconds``: (window, keys, values).

    ``panes`` has one row per key and pane, the pane's start in ``window``; ``values``
    tells how each column merges (see MERGES; a struct's ``max`` keeps what came with
    the largest first field). A window has a row for every key with a pane inside.
    Keys may be null. ``seconds`` must be a multiple of ``step_seconds``.
    """
    if seconds % step_seconds:
        raise ValueError("the window length must be a multiple of the step")
    n = seconds // step_seconds
    numbered = numbered_panes(panes, window, step_seconds, n)
    stretches = _constant_stretches(changes(numbered, keys, values, n), keys, values, n)
    start = F.col(_BLOCK) * n
    starts = F.filter(
        F.sequence(_FROM, "__to"), lambda x: F.get("__open", (x - start).cast("int")))
    spread = stretches.join(_open_starts(numbered, n), _BLOCK).select(
        F.explode(starts).alias(_PANE), *keys, *values)
    return spread.select(
        from_micros(F.col(_PANE) * (step_seconds * 1_000_000)).alias(window), *keys, *values)
