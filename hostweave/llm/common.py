"""Reading tables and staging intermediate results on shared storage."""

import ctypes
import gc
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from hostweave.functions.durable import new_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(columns: Sequence[str], stem: str) -> str:
    """A column name that begins with ``stem`` and that no column has, upper or lower case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Later jobs read the files, so a lost executor costs nothing that was staged.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_chunks(
    batches: Iterator[pa.RecordBatch], columns: Sequence[str], text: str, max_bytes: int = 1 << 20
) -> Iterator[tuple[list[pa.Array], list[bytes]]]:
    """Rows of Arrow batches in chunks of about ``max_bytes`` of text.

    Yields the named columns and the texts as UTF-8 (null: empty). A chunk holds
    at least one row, however long its text; rows are never cut or left out.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(text).cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            limit = (ends[start - 1] if start else 0) + max_bytes
            end = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
            part = [b"" if t is None else t for t in texts.slice(start, end - start).to_pylist()]
            yield [batch.column(c).slice(start, end - start) for c in columns], part
            start = end


def give_back() -> None:
    """Hand memory that a Python worker no longer uses back to the system; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)
