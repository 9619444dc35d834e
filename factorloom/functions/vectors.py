"""Vector arithmetic as unrolled column expressions, which stay inside generated code."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column, k: int) -> Column:
    return reduce(add, (a[i] * b[i] for i in range(k)))


def scale(alpha: float | Column, a: Column, k: int) -> Column:
    return F.array(*(a[i] * alpha for i in range(k)))


def axpby(alpha: float | Column, a: Column, beta: float | Column, b: Column, k: int) -> Column:
    """alpha a + beta b"""
    return F.array(*(a[i] * alpha + b[i] * beta for i in range(k)))


def axpy(alpha: float | Column, a: Column, b: Column, k: int) -> Column:
    """alpha a + b"""
    return F.array(*(a[i] * alpha + b[i] for i in range(k)))


def mixed(alpha: float, a: Column, beta: float, b: Column) -> Column:
    """alpha a + beta b by higher-order functions: new numbers make no new generated code, which suits a loop's steps."""
    return F.zip_with(a, b, lambda x, y: x * alpha + y * beta)


def scaled(alpha: float, a: Column) -> Column:
    return F.transform(a, lambda x: x * alpha)


def total_dot(df: DataFrame, a: str, b: str, k: int) -> float:
    """The sum over all rows of the inner products of two vector columns."""
    return df.agg(F.sum(dot(F.col(a), F.col(b), k))).first()[0] or 0.0


def norm(df: DataFrame, a: str, k: int) -> float:
    """The Euclidean norm of all rows' vectors taken as one."""
    return math.sqrt(total_dot(df, a, a, k))


def lattice(column: Column, k: int, salt: int = 0) -> Column:
    """Vectors in (0, 1] by whole-number arithmetic alone: equal in any SQL engine."""
    return F.array(*((F.pmod(column * (7919 + 31 * j) + salt, F.lit(997)) + 1).cast("double") / 998 for j in range(k)))


def lattice_sql(column: str, j: int, salt: int = 0) -> str:
    """Component j of ``lattice`` in SQL."""
    return f"(CAST(({column} * {7919 + 31 * j} + {salt}) % 997 + 1 AS DOUBLE) / 998)"


def random_unit(column: Column, k: int, seed: int, side: int) -> Column:
    """A vector of norm 1 without negative components: absolute values of normal deviates, made from a hash.

    It depends on the id, the seed and the side only, so neither partitions nor their order change it.
    """

    def uniform(j: int, which: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(column, F.lit(j), F.lit(which), F.lit(seed), F.lit(side)), 11)
        return (bits.cast("double") + 0.5) / float(1 << 53)

    normal = F.array(*(F.abs(F.sqrt(F.log(uniform(j, 0)) * -2.0) * F.cos(uniform(j, 1) * (2 * math.pi))) for j in range(k)))
    size = F.sqrt(F.aggregate(normal, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(normal, lambda v: v / size)
