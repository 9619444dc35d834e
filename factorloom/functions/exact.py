"""Sums of doubles whose bits don't depend on the order or the partitions of the rows.

A double is a whole number of 53 bits times a power of two. Its bits are added to
counters of 32 bits each over the whole range of exponents, in 64-bit whole numbers;
the counters of all tasks are added by Spark and put together on the driver, so a
sum is the exact one, rounded once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = "name int, at int, v long"
_BITS, _LOWEST, _PLACES = 32, 1152, 72
_MASK = np.uint64((1 << _BITS) - 1)
_BROKEN = -1  # the place that counts values that aren't finite


def counters(values: np.ndarray) -> pa.RecordBatch:
    """Counters of the sums of each column of ``values``, as rows of ``COUNTERS``."""
    names = values.shape[1]
    total = np.zeros((names, _PLACES), np.int64)
    broken = (~np.isfinite(values)).sum(axis=0)
    for begin in range(0, len(values), 1 << 18):
        part = values[begin : begin + (1 << 18)]
        part = np.where(np.isfinite(part), part, 0.0)
        mantissa, exponent = np.frexp(part)
        whole = np.abs(mantissa * (1 << 53)).astype(np.uint64)
        sign = np.where(part < 0, -1, 1)
        place, bit = np.divmod(exponent.astype(np.int64) - 53 + _LOWEST, _BITS)
        bit = bit.astype(np.uint64)
        low, high = (whole & _MASK) << bit, (whole >> np.uint64(_BITS)) << bit
        name = np.broadcast_to(np.arange(names), part.shape)
        for step, bits in enumerate((low & _MASK, (low >> np.uint64(_BITS)) + (high & _MASK), high >> np.uint64(_BITS))):
            np.add.at(total, (name, place + step), sign * bits.astype(np.int64))
        for at in range(_PLACES - 1):  # carried on, so that counters of very many tasks can be added
            carry = total[:, at] >> _BITS
            total[:, at] -= carry << _BITS
            total[:, at + 1] += carry
    name, at = np.nonzero(total)
    bad = np.flatnonzero(broken)
    return pa.record_batch(
        [pa.array(np.concatenate([name, bad]), pa.int32()), pa.array(np.concatenate([at, np.full(len(bad), _BROKEN)]), pa.int32()), pa.array(np.concatenate([total[name, at], broken[bad]]), pa.int64())],
        names=["name", "at", "v"],
    )


def counted(df: DataFrame, columns: list[Column]) -> DataFrame:
    """Rows of ``COUNTERS`` of the sums of columns, numbered from 0; null counts as 0."""
    rows = df.select(F.array(*(F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns)).alias("v"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield counters(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))

    return rows.mapInArrow(run, COUNTERS)


def totals(counts: DataFrame, names: int) -> list[float]:
    """The sums that counters stand for: a few rows for each name come to the driver."""
    whole, broken = [0] * names, [False] * names
    for name, at, v in counts.groupBy("name", "at").agg(F.sum("v")).collect():
        if at == _BROKEN:
            broken[name] = True
        else:
            whole[name] += v << (at * _BITS)
    return [float("nan") if b else w / (1 << _LOWEST) for w, b in zip(whole, broken, strict=True)]


def exact_sums(df: DataFrame, *columns: Column) -> list[float]:
    """The exact sums of the columns, each rounded once."""
    return totals(counted(df, list(columns)), len(columns))
