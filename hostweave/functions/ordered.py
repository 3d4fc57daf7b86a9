"""Order-dependent columns that never put a whole group into one task.

A plain window partitioned by a hot key sorts that whole key in one task. The
helpers here cut each key into slots of its LONG order column, work inside a
slot, and carry the slot summaries forward. A summary row stands for a whole
slot, so the data shrinks by the slot width on every level; results are exact.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostweave.functions.timefn import floor_div

_SLOT, _CARRY = "__slot", "__carry"
_FAN = 65_536


def _fold_before(
    slots: DataFrame, keys: Sequence[str], value: str, fold, merge, levels: int
) -> DataFrame:
    """Per slot, ``fold`` of ``value`` over all earlier slots of the key."""
    before = Window.partitionBy(*keys).orderBy(_SLOT).rowsBetween(
        Window.unboundedPreceding, -1)
    if levels == 0:
        return slots.select(*keys, _SLOT, fold(F.col(value)).over(before).alias(_CARRY))
    parents = slots.withColumn("__parent", floor_div(F.col(_SLOT), _FAN))
    inside = Window.partitionBy(*keys, "__parent").orderBy(_SLOT).rowsBetween(
        Window.unboundedPreceding, -1)
    near = parents.withColumn("__near", fold(F.col(value)).over(inside))
    totals = parents.groupBy(*keys, F.col("__parent").alias(_SLOT)).agg(
        fold(F.col(value)).alias(value))
    far = _fold_before(totals, keys, value, fold, merge, levels - 1).withColumnsRenamed(
        {_SLOT: "__parent", _CARRY: "__far"})
    return near.join(far, [*keys, "__parent"], "left").select(
        *keys, _SLOT, merge(F.col("__near"), F.col("__far")).alias(_CARRY))


def _add(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def position_in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str,
    width: int,
    ties: Sequence[str] = (),
    levels: int = 1,
) -> DataFrame:
    """0-based position of each row within ``keys``, by ``order`` then ``ties``.

    ``width`` is the range of ``order`` values one task sorts at a time.
    """
    slotted = df.withColumn(_SLOT, floor_div(F.col(order), width))
    counts = slotted.groupBy(*keys, _SLOT).agg(F.count(F.lit(1)).alias("__n"))
    before = _fold_before(counts, keys, "__n", F.sum, _add, levels)
    inside = Window.partitionBy(*keys, _SLOT).orderBy(order, *ties)
    return (
        slotted.withColumn("__place", F.row_number().over(inside))
        .join(before, [*keys, _SLOT], "left")
        .withColumn(out, (F.col("__place") - 1 + F.coalesce(_CARRY, F.lit(0))).cast("bigint"))
        .drop(_SLOT, _CARRY, "__place"))


def latest_before(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    out: str,
    width: int,
    ties: Sequence[str] = (),
    levels: int = 1,
) -> DataFrame:
    """Largest non-null ``value`` among the earlier rows of the key.

    With a ``value`` that never falls along ``order`` this is the value of the
    nearest earlier row that has one.
    """
    slotted = df.withColumn(_SLOT, floor_div(F.col(order), width)).withColumn("__value", value)
    tops = slotted.groupBy(*keys, _SLOT).agg(F.max("__value").alias("__value"))
    before = _fold_before(tops, keys, "__value", F.max, F.greatest, levels)
    inside = Window.partitionBy(*keys, _SLOT).orderBy(order, *ties).rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        slotted.withColumn("__near", F.max("__value").over(inside))
        .join(before, [*keys, _SLOT], "left")
        .withColumn(out, F.coalesce("__near", _CARRY))
        .drop(_SLOT, _CARRY, "__near", "__value"))
