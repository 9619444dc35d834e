"""What the operators of this subpackage share."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.plans.lineage import by_merge, cut, drop, few, scratch, shared_folder  # noqa: F401  for the operators of this subpackage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets go of what finished steps hold.

    Spark removes shuffle files and broadcasts once the driver's garbage collector has found their tables dead, which a
    driver that only plans does rarely; long loops ask for it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, most: str = "4MB", rows: int = 512) -> None:
    """Bounds the bytes of an Arrow batch and the rows of a Parquet vector.

    So a Python worker holds a few long texts or many short ones, and a reader's vector of texts stays small. A bound that
    the session has changed stays.
    """
    for name, usual, new in (("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", most), ("spark.sql.parquet.columnarReaderBatchSize", "4096", str(rows))):
        if spark.conf.get(name, usual) == usual:  # Spark's own default
            spark.conf.set(name, new)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and int64 offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Ranges [i, j) of rows whose bytes add up to about ``most``, at least a row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def pmod(key: Column, n: int) -> Column:
    return F.pmod(key, F.lit(n))
