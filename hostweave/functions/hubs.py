"""Joins on keys of which a few hold much of a table.

Hubs are found by counting. Their rows are dealt over parts, and what they meet is
repeated once per part; all other keys stay in one part, so nothing else grows.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: At most so many keys can be hubs, whatever the size of the table.
MOST_HUBS = 10_000


def hub_parts(rows: DataFrame, keys: Sequence[str], least: int = 100_000, most: int = MOST_HUBS) -> DataFrame:
    """(keys, parts) of the keys with more rows than a part should have.

    A part has ``least`` rows, or the share ``1 / most`` of the table if that is more:
    fewer than ``most`` keys can exceed it, so the result may be broadcast.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    limit = F.greatest(F.lit(least), F.ceil(counts.select(F.sum("__n")).scalar() / most))
    return counts.filter(F.col("__n") > limit).select(*keys, F.ceil(F.col("__n") / limit).cast("int").alias("__parts"))


def dealt(rows: DataFrame, hubs: DataFrame, keys: Sequence[str], spread: Column) -> DataFrame:
    """Add ``__part``: rows of a hub are dealt over its parts by a hash of ``spread``."""
    return rows.join(F.broadcast(hubs), list(keys), "left").withColumn(
        "__part", F.pmod(F.xxhash64(spread), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")


def repeated(rows: DataFrame, hubs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``__part``: a hub's rows are there once for each of its parts."""
    return rows.join(F.broadcast(hubs), list(keys), "left").withColumn(
        "__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
