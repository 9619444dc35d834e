"""Normal equations of all entities of one side, given the factors of the other.

Ratings meet the other side's factors in a join, and every Arrow batch of the result
is summed per entity at once; so an entity with very many ratings is summed where its
rows lie and only sums travel. The partial sums are dealt by entity and added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.exact import COUNTERS, counters, totals
from factorloom.operators.solvers import cholesky, nnls, pack, unpack

SUMS = "id long, n double, s double, g array<double>, b array<double>"


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), k)


def _listed(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64())) if len(x) else pa.array([], pa.list_(pa.float64()))


def _by_id(ids: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adds up rows of one id."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return ids[begin], *(np.add.reduceat(x[order], begin, axis=0) if len(ids) else x for x in sums)


def _batch(ids: np.ndarray, n: np.ndarray, s: np.ndarray, g: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(ids), pa.array(n), pa.array(s), _listed(g), _listed(b)], names=["id", "n", "s", "g", "b"])


def partial_sums(rank: int, implicit: bool, alpha: float):
    """Rows (id, factor, rating) to sums of each batch's entities."""
    i, j = pack(rank)

    def run(batches):
        for batch in batches:
            step = max(256, (1 << 21) // len(i))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, r = part.column("id").to_numpy(), part.column("rating").to_numpy()
                y = _matrix(part.column("factor"), rank)
                outer = y[:, i] * y[:, j]
                if implicit:  # confidence 1 + alpha |r| on a preference of 1 if r > 0; the 1 is in the Gram matrix of all
                    seen = r > 0
                    more = np.where(seen, alpha * np.abs(r), 0)
                    yield _batch(*_by_id(ids, seen.astype(float), np.where(seen, 1 + more, 0), outer * more[:, None], y * np.where(seen, 1 + more, 0)[:, None]))
                else:
                    yield _batch(*_by_id(ids, np.ones(len(ids)), r * r, outer, y * r[:, None]))

    return run


def _whole(batches):
    """Adds the partial sums of rows sorted by id; the last id of a batch waits for the next."""
    held = None
    for batch in batches:
        k2, k = (len(batch.column(c)[0]) if batch.num_rows else 0 for c in ("g", "b"))
        if not batch.num_rows:
            continue
        new = batch.column("id").to_numpy(), batch.column("n").to_numpy(), batch.column("s").to_numpy(), _matrix(batch.column("g"), k2), _matrix(batch.column("b"), k)
        if held is not None:
            new = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
        sums = _by_id(*new)
        held = tuple(x[-1:] for x in sums)
        if len(sums[0]) > 1:
            yield _batch(*(x[:-1] for x in sums))
    if held is not None:
        yield _batch(*held)


def normal_equations(ratings: DataFrame, key: str, factors: DataFrame, rank: int, implicit: bool = False, alpha: float = 1.0) -> DataFrame:
    """(id, n, s, g, b) of each entity of side ``key``: its ratings, the sums of r r, of y y' (packed) and of r y.

    factors: (id, factor) of the other side.
    """
    other = "item" if key == "user" else "user"
    met = ratings.join(factors.select(F.col("id").alias(other), "factor"), other).select(F.col(key).alias("id"), "factor", "rating")
    parts = met.mapInArrow(partial_sums(rank, implicit, alpha), SUMS)
    return parts.repartition("id").sortWithinPartitions("id").mapInArrow(_whole, SUMS)


def normal_sums(ratings: DataFrame, key: str, factors: DataFrame, rank: int) -> DataFrame:
    """The same sums by built-in aggregates, best at small ranks: (id, n, g_0.., b_0..)."""
    other = "item" if key == "user" else "user"
    i, j = pack(rank)
    y = F.col("factor")
    met = ratings.join(factors.select(F.col("id").alias(other), "factor"), other)
    sums = [F.sum(y[int(a)] * y[int(b)]).alias(f"g_{n}") for n, (a, b) in enumerate(zip(i, j, strict=True))] + [F.sum(y[a] * F.col("rating")).alias(f"b_{a}") for a in range(rank)]
    return met.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"), *sums)


def gram(factors: DataFrame, rank: int, left: str = "factor", right: str = "factor") -> np.ndarray:
    """The sum over all rows of left right', each entry an exact sum of the products, whatever the partitions are."""
    return grams(factors, rank, (left, right))[0]


def grams(factors: DataFrame, rank: int, *pairs: tuple[str, str]) -> list[np.ndarray]:
    """The sums over all rows of left right' for several pairs of vector columns, from one job."""
    columns = [F.col(c).cast("array<double>").alias(f"v{n}") for n, c in enumerate(c for pair in pairs for c in pair)]

    def run(batches):
        for batch in batches:
            step = max(1, (1 << 20) // (rank * rank))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                v = [_matrix(c, rank) for c in part.columns]
                yield counters(np.concatenate([(v[2 * n][:, :, None] * v[2 * n + 1][:, None, :]).reshape(part.num_rows, -1) for n in range(len(pairs))], axis=1))

    sums = totals(factors.select(*columns).mapInArrow(run, COUNTERS), len(pairs) * rank * rank)
    return list(np.array(sums).reshape(len(pairs), rank, rank))


def gram_ray(factors: DataFrame, rank: int, x: str = "x", p: str = "p") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram matrices along x + t p: of x, the mixed terms, of p."""
    xx, mixed, pp = grams(factors, rank, (x, x), (x, p), (p, p))
    return xx, mixed + mixed.T, pp


def solve(sums: DataFrame, rank: int, ridge: float, nonnegative: bool = False, everywhere: np.ndarray | None = None, state: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n, solved, loss) of the sums; with ``state``, a vector column of them, also the gradient ``grad`` and ``was`` there.

    keep: vector columns of the sums that stay.

    The system of an entity is (g + everywhere + ridge n I) x = b. loss and was: its squared errors and its own ridge at the
    solution and at the state (for explicit ratings).
    """
    graded = state is not None
    wide = "id long, n double, solved array<double>, loss double" + ", grad array<double>, was double" * graded + "".join(f", {c} array<double>" for c in keep)
    rows = sums.select("id", "n", "s", "g", "b", *([state.alias("__x")] if graded else []), *keep)
    solver = nnls if nonnegative else cholesky

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, s, b = batch.column("n").to_numpy(), batch.column("s").to_numpy(), _matrix(batch.column("b"), rank)
            g = unpack(_matrix(batch.column("g"), rank * (rank + 1) // 2), rank)
            g = g + everywhere if everywhere is not None else g

            def at(x, g=g, b=b, n=n, s=s):
                """The gradient's half and the value at x."""
                pull = np.einsum("nij,nj->ni", g, x) + ridge * n[:, None] * x - b
                return pull, s + ((pull - b) * x).sum(axis=1)

            solved = solver(g, b, ridge * n)
            out = [batch.column("id"), batch.column("n"), _listed(solved), pa.array(at(solved)[1])]
            if graded:
                pull, was = at(_matrix(batch.column("__x"), rank))
                out += [_listed(2 * pull), pa.array(was)]
            yield pa.record_batch([*out, *(batch.column(c) for c in keep)], names=["id", "n", "solved", "loss", *(["grad", "was"] if graded else []), *keep])

    return rows.mapInArrow(run, wide)


def half_step(ratings: DataFrame, key: str, factors: DataFrame, rank: int, ridge: float, nonnegative: bool = False, implicit: bool = False, alpha: float = 1.0) -> DataFrame:
    """(id, n, factor): the best factors of one side while the other's stay."""
    everywhere = gram(factors, rank) if implicit else None
    sums = normal_equations(ratings, key, factors, rank, implicit, alpha)
    return solve(sums, rank, ridge, nonnegative, everywhere).select("id", "n", F.col("solved").alias("factor"))
