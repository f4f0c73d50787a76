"""Small helpers of the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.sources.workspace import broadcast_if_small, shared_dir, shuffled, written

__all__ = ["broadcast_if_small", "each_part", "keyed_rows", "numbered", "one_by_one", "shared_dir", "shuffled", "written"]


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; after each, what Arrow and the C library hold
    unused goes back, since workers live on beside the next stages' memory."""
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not this C library
        trim = lambda _: None
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        trim(0)


def keyed_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the two named columns, so that extra ones can't clash."""
    return df.select(df[key].alias("doc_id"), df[text].alias("text"))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with row_id, a number of the row; ``df`` must be read from files,
    so that reading it again gives the same numbers."""
    return df.withColumn("row_id", F.monotonically_increasing_id())


def each_part(parts: list[Broadcast]) -> Iterator:
    """The values of a model's parts, in a task. Of several, each is read
    again when its turn comes, so that a worker holds one at a time (all of
    them only where Spark's encryption leaves no file to read)."""
    for part in parts:
        path = getattr(part, "_path", None)
        yield part.value if len(parts) == 1 or path is None else part.load_from_path(path)


def bitmap(hashes: DataFrame, column: str, bits: int) -> Broadcast:
    """Broadcast bits (``bits`` of them, a power of two, whatever the table
    holds) of which those that the low bits of ``column`` name are set."""
    import numpy as np

    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = hashes.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b")).toArrow()
    found = np.zeros(bits // 64, dtype=np.uint64)
    found[np.asarray(words.column("w").combine_chunks())] = np.asarray(words.column("b").combine_chunks()).view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(found)


def in_bitmap(bits, hashes):
    """Which of the 64-bit hashes name a set bit."""
    import numpy as np

    slot = hashes.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return ((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)
