"""Exact top-k search by inner product with pivot-table elimination.

For every vector the distances to a set of pivots are computed once. By the
triangle inequality no vector x is nearer to a query q than the largest of
``|d(q, p) - d(x, p)|``, and with both norms known that bounds their inner
product from above: ``(|q|^2 + |x|^2 - d^2) / 2``. Candidates are evaluated in
the order of that bound until the k-th best exact score is above the next bound.

Candidates and queries are dealt into blocks by hash; each pair of blocks is one
task's work and gives k rows per query, of which the k best overall are kept.
Pivots come from a bounded sample, spread out by farthest-first choice, and the
tables of distances are made where the blocks lie. The k-th best score among the
sample's rows is where every block starts to eliminate from. Both change the work,
never the result; ``elimination`` tells how many candidates were left to evaluate.

Defined cases: null vectors and vectors with a null or non-finite component take
no part, nor do rows without an id; vectors are compared with those of their own
length; a repeated row is another candidate, a repeated query is answered once;
equal scores go to the smaller id. Components saturate at 64 bits and so do
scores. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import pmod

MOST = 2**63 - 1


def usable(vector: Column) -> Column:
    """Not null and only finite components (an empty vector has none that isn't)."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def integers(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the row farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    gap = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table: a row for each pivot with its Euclidean distances to all rows (double), in single precision."""
    squares = (rows**2).sum(axis=1)[None, :] - 2 * pivots @ rows.T + (pivots**2).sum(axis=1)[:, None]
    return np.sqrt(np.maximum(squares, 0)).astype(np.float32)


def bounds(query: np.ndarray, q_far: np.ndarray, far: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """No candidate's score is above its bound. far, q_far: distances to the pivots; norms: squared lengths."""
    norm = float((query.astype(np.float64) ** 2).sum())
    apart, gap = np.zeros(len(norms), np.float32), np.empty(len(norms), np.float32)
    for to_all, to_query in zip(far, q_far, strict=True):
        np.subtract(to_all, to_query, out=gap)
        np.abs(gap, out=gap)
        np.maximum(apart, gap, out=apart)
    # rounding to single precision, and the root of what cancellation leaves of squares in double precision
    slack = 1e-6 * (far.max(initial=0) + q_far.max(initial=0)) + 1e-7 * np.sqrt(norm + norms)
    apart = np.maximum(apart.astype(np.float64) - slack, 0)
    return (norm + norms - apart**2) / 2 + 1e-9 * (norm + norms) + 1


def _scores(rows: np.ndarray, query: np.ndarray, exact) -> np.ndarray:
    if exact is object:
        return np.array([max(-MOST - 1, min(MOST, int(s))) for s in rows.astype(object) @ query.astype(object)], object)
    return (rows @ query).astype(np.int64)


def _best(query: np.ndarray, query_id: int, bound: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, exact, least, step: int = 64):
    """The k best (score, id) of one block for one query, but for scores under ``least``; and how many were evaluated.

    The first ``step`` candidates are evaluated together, then twice as many, and so on.
    """
    order = np.argsort(-bound, kind="stable")
    order = order[ids[order] != query_id]
    scores, found, seen = np.zeros(0, object if exact is object else np.int64), np.zeros(0, np.int64), 0
    while len(order):
        top = bound[order[0]]
        if least is not None and top < least or len(scores) >= k and scores[-1] > top:
            break
        at, order, step = order[:step], order[step:], 2 * step
        seen += len(at)
        scores, found = np.concatenate([scores, _scores(rows[at], query, exact)]), np.concatenate([found, ids[at]])
        keep = np.lexsort((found, np.array([-s for s in scores], dtype=scores.dtype)))[:k] if exact is not object else np.array(sorted(range(len(found)), key=lambda j: (-scores[j], found[j]))[:k])
        scores, found = scores[keep], found[keep]
    return scores, found, seen


def _search(rows: DataFrame, queries: DataFrame, k: int, n_pivots: int, sample: int, block: int, query_block: int) -> DataFrame:
    """query_id, query, vec_id and score of each block's best, and a row with a null vec_id that holds what was evaluated."""
    spark = rows.sparkSession
    picked: dict[int, list] = {}
    for r in rows.select("id", "v").orderBy(F.xxhash64("v"), "id").limit(sample).collect():
        picked.setdefault(len(r["v"]), []).append((r["id"], r["v"]))
    known = {}
    for n, found in picked.items():
        ids, x = np.array([i for i, _ in found], np.int64), np.asarray([v for _, v in found], np.int64).reshape(len(found), n)
        known[n] = choose_pivots(np.asarray(sorted(map(tuple, x.tolist())), np.float64).reshape(len(x), n)[: 8 * n_pivots], n_pivots), ids, x
    sent = spark.sparkContext.broadcast(known)  # bounded by the sample

    n_rows, n_queries = rows.count(), queries.count()
    blocks, q_blocks = max(1, -(-n_rows // block)), max(1, -(-n_queries // query_block))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("v").alias("dim")
    # the sides' columns are named apart, for queries may come from the same table
    left = rows.select(F.col("id").alias("x_id"), F.col("v").alias("x"), size, pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), each(q_blocks).alias("q_block"))
    right = queries.select("id", "v").distinct().select(F.col("id").alias("q_id"), F.col("v").alias("q"), size, pmod(F.xxhash64("id"), q_blocks).cast("int").alias("q_block"), each(blocks).alias("block"))

    def compare(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "query": [], "vec_id": [], "score": []}
        if candidates.num_rows and asked.num_rows:
            ids, x = candidates.column("x_id").to_numpy(), _matrix(candidates.column("x"), np.int64)
            q_ids, q = asked.column("q_id").to_numpy(), _matrix(asked.column("q"), np.int64)
            dim = x.shape[1] if x.size else 0
            pivots, s_ids, s = sent.value.get(dim, (np.zeros((0, dim)), np.zeros(0, np.int64), np.zeros((0, dim), np.int64)))
            x, q = x.reshape(len(ids), dim), q.reshape(len(q_ids), dim)
            far, q_far = _distances(x.astype(np.float64), pivots), _distances(q.astype(np.float64), pivots)
            norms = (x.astype(np.float64) ** 2).sum(axis=1)
            longest = max(norms.max(), (s.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
            largest = np.sqrt(longest * (q.astype(np.float64) ** 2).sum(axis=1).max())
            exact = np.float64 if largest < 2.0**52 else np.int64 if largest < 2.0**62 else object
            x, q, s = (a.astype(np.float64) for a in (x, q, s)) if exact is np.float64 else (x, q, s)
            for i in range(len(q)):
                start = None
                if exact is not object:
                    others = _scores(s, q[i], exact)[s_ids != q_ids[i]]
                    start = int(np.partition(others, -k)[-k]) if len(others) >= k else None
                scores, found, seen = _best(q[i], q_ids[i], bounds(q[i], q_far[:, i], far, norms), ids, x, k, exact, start)
                key = np.asarray(q[i], np.int64).tobytes()
                out["query_id"] += [int(q_ids[i])] * (len(found) + 1)
                out["query"] += [key] * (len(found) + 1)
                out["vec_id"] += [*found.tolist(), None]
                out["score"] += [*(int(v) for v in scores), seen]
        return pa.table([pa.array(out["query_id"], pa.int64()), pa.array(out["query"], pa.binary()), pa.array(out["vec_id"], pa.int64()), pa.array(out["score"], pa.int64())], names=list(out))

    keys = ["dim", "block", "q_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, query binary, vec_id long, score long")


def search(rows: DataFrame, queries: DataFrame, k: int = 10, n_pivots: int = 128, sample: int = 4096, block: int = 4096, query_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best among all rows (id, v array<long>) but its own id.

    queries: (id, v) too. sample: rows the pivots are chosen from and the elimination starts from; block, query_block: rows
    of a block, about.
    """
    best = _search(rows, queries, k, n_pivots, sample, block, query_block).filter("vec_id is not null")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def elimination(rows: DataFrame, queries: DataFrame, k: int = 10, n_pivots: int = 128, sample: int = 4096, block: int = 4096, query_block: int = 2048) -> DataFrame:
    """One row: how many candidates the queries had in all (n_candidates) and how many were evaluated (n_evaluated)."""
    done = _search(rows, queries, k, n_pivots, sample, block, query_block).filter("vec_id is null").agg(F.sum("score").alias("n_evaluated"))
    pairs = queries.distinct().groupBy(F.size("v").alias("d")).agg(F.count("*").alias("q")).join(rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("r")), "d")
    return pairs.agg(F.sum(F.col("q") * F.col("r")).alias("n_candidates")).crossJoin(done)


def nearest(embeddings: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100) -> DataFrame:
    """The search with the rows whose id is divisible by ``every`` as queries."""
    rows = embeddings.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col)).alias("v"))
    return search(rows, rows.filter(F.col("id") % every == 0), k)


#: DuckDB SQL for ``nearest``: every query against every row.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
