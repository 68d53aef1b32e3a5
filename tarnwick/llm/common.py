"""What the operators share: the shared folder, written intermediates, Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.sources.shared import discard, shared_folder, written  # noqa: F401

#: Bits of a row key that number the row within its partition.
ROW_BITS = 36


def row_keys(first: int, n: int) -> np.ndarray:
    """Keys of n rows, unique over the partitions of one scan and the same whenever a task is run again."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    return (np.int64(part) << ROW_BITS) + np.arange(first, first + n, dtype=np.int64)


def as_bytes(column: pa.Array) -> list:
    """Texts as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def release() -> None:
    """Gives freed memory back to the system: workers are used again and would hold it through the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of MurmurHash3)."""
    x = np.array(x, dtype=np.uint64, ndmin=1)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_blocks(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of at most size rows, without holding more than one."""
    block: list = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list:
    """All columns of df by their own names, whatever is in these."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
