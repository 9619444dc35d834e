"""The best items of every user by inner product, exactly, without all pairs.

Items of equal vectors score alike, so of these only the n + m with the smallest ids can
be anyone's, where m is the most of them that one user has seen; the rest are left out.

Items are dealt into the leaves of a k-d tree over their factors and their norm. The tree
is fitted to a bounded sample; what a leaf can give is told by all of its items: the
least and greatest value of each component and the greatest norm. No item of a leaf
scores above ``sum(max(u low, u high))``, nor above the product of the norms.

Every user visits leaves in the order of that bound, 1 in the first wave, 2 in the second,
then 4, .., until the next bound is below their n-th best score. Only users who
still ask are sent, and only to the leaves they ask for. A task compares one part of a
leaf with one part of its askers by a matrix product; at most n rows of a user leave
it. Scores are added in the order of the components, so they are those of ``predict`` to
the last bit, and equal scores go to the smaller item.

Defined cases: ids are unique on each side; vectors that are null, of another length, or
hold null or non-finite components take no part, nor do null ids; a user who has seen
all items gets no row; repeated or unknown pairs in ``seen`` change nothing; empty tables
give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.plans.lineage import Tables, cut, drop

MOST_LEAVES = 4096  # bounds what is broadcast: 2 rank + 1 doubles a leaf
ASK = "user long, v array<double>, leaf int"
SMALL = 1 << 18  # items that are sent to the pairs seen, of 16 bytes each, instead of being joined by an exchange


def _usable(v: Column, rank: int) -> Column:
    return F.coalesce((F.size(v) == rank) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def _factors(side: DataFrame, name: str, rank: int) -> DataFrame:
    return side.select(F.col("id").cast("long").alias(name), F.col("features").cast("array<double>").alias("v")).filter(F.col(name).isNotNull() & _usable(F.col("v"), rank))


def _matrix(column: pa.ChunkedArray | pa.Array, rank: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), rank)


def _widened(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.linalg.norm(x, axis=1)])


@dataclass
class Tree:
    """Inner nodes in heap order: the dimension that each splits and where; 2**depth leaves."""

    depth: int
    dims: np.ndarray
    at: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int) -> "Tree":
        """Each node is split at the median of its widest dimension."""
        tree = cls(depth, np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1))
        lying = {0: _widened(sample)}
        for node in range(2**depth - 1):
            x = lying.pop(node)
            if len(x):
                tree.dims[node] = x.var(axis=0).argmax()
                tree.at[node] = np.median(x[:, tree.dims[node]])
            right = x[:, tree.dims[node]] > tree.at[node]
            lying[2 * node + 1], lying[2 * node + 2] = x[~right], x[right]
        return tree

    def leaf(self, x: np.ndarray) -> np.ndarray:
        x, node, each = _widened(x), np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[each, self.dims[node]] > self.at[node])
        return node - (2**self.depth - 1)


@dataclass
class Leaves:
    """What the items of each leaf that holds any can give at most."""

    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray

    def bounds(self, users: np.ndarray) -> np.ndarray:
        """No item of a leaf scores above (a row for each user, a column for each leaf)."""
        by_norm = np.linalg.norm(users, axis=1)[:, None] * self.norm[None, :]
        by_box = np.maximum(users, 0) @ self.high.T + np.minimum(users, 0) @ self.low.T
        return np.minimum(by_box, by_norm) + 1e-9 * by_norm + 1e-300  # more than rounding takes

    def wave(self, users: np.ndarray, least: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(user, leaf) for the first-th to last-th leaves of each user's order that may reach ``least``."""
        bound = self.bounds(users)
        if first == 0 and last == 1:
            i, j = np.arange(len(users)), bound.argmax(axis=1)
            some = bound[i, j] >= least
            return i[some], self.ids[j[some]]
        # leaves that may reach ``least`` are the first of the order, mostly few of very many: only these are sorted
        i, j = np.nonzero(bound >= least[:, None])
        order = np.lexsort((j, -bound[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        some = (place >= first) & (place < last)
        return i[some], self.ids[j[some]]


def _tree(items: DataFrame, rank: int, block: int) -> Tree:
    wanted = min(MOST_LEAVES, max(1, -(-items.count() // block)))
    depth = int(wanted - 1).bit_length()
    sample = items.select("v").orderBy(F.xxhash64("v", "item")).limit(16 * 2**depth).toArrow()
    return Tree.fit(_matrix(sample.column("v"), rank), depth)


def _leaves(dealt: DataFrame, rank: int) -> Leaves:
    ends = [f(F.col("v")[j]).alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(rank)]
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    found = dealt.groupBy("leaf").agg(F.max(F.sqrt(square)).alias("norm"), *ends).toArrow().to_pandas()  # a row for each leaf
    box = [found[[f"{name}{j}" for j in range(rank)]].to_numpy(np.float64).reshape(-1, rank) for name in ("low", "high")]
    return Leaves(found["leaf"].to_numpy(np.int64), *box, found["norm"].to_numpy(np.float64))


def _kinds(goods: DataFrame, most: int) -> DataFrame:
    """(item, v, kind, place): the first ``most`` items of each vector in the order of their ids; kind: the first's id."""
    kind = Window.partitionBy("v")
    some = goods.withColumn("place", F.row_number().over(kind.orderBy("item"))).filter(F.col("place") <= most)
    return some.withColumn("kind", F.min("item").over(kind))


def _possible(goods: DataFrame, pairs: DataFrame | None, n: int) -> tuple[DataFrame, DataFrame | None]:
    """Written tables: the items (item, v) that anyone can be recommended, and the pairs seen of them, each once. ``goods`` is used up.

    A user who has seen s items of a kind gets none beyond its first n + s. At first s is bounded by all of a user's pairs,
    which leaves few pairs to count for each user and kind.
    """
    if pairs is None:
        return cut(_kinds(goods, n).select("item", "v"), goods), None
    most = pairs.filter(F.col("user").isNotNull()).groupBy("user").count().agg(F.max("count")).first()[0] or 0
    front = cut(_kinds(goods, min(n + most, (1 << 31) - 1)), goods)
    of = front.select("item", "kind")
    gone = cut(pairs.join(F.broadcast(of) if front.count() <= SMALL else of, "item").distinct())
    met = gone.groupBy("user", "kind").count().groupBy("kind").agg(F.max("count").alias("met"))
    able = F.col("place") <= n + F.coalesce("met", F.lit(0))
    return cut(front.join(met, "kind", "left").filter(able).select("item", "v"), front), gone


def _best_of_block(items: pa.Table, askers: pa.Table, rank: int, n: int) -> pa.Table:
    """The n best unseen items of one part of a leaf for each asker. Askers' rows without a vector are pairs that were seen."""
    # a user whose seen pairs are here asks here too
    is_user = askers.column("seen").is_null()
    asked, seen = askers.filter(is_user), askers.filter(askers.column("seen").is_valid())
    out = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if items.num_rows and asked.num_rows:
        items = items.sort_by("item")
        i_id, y = items.column("item").to_numpy(), _matrix(items.column("v"), rank)
        asked = asked.sort_by("user")
        u_id, x = asked.column("user").to_numpy(), _matrix(asked.column("v"), rank)
        score = x @ y.T
        row, col = np.searchsorted(u_id, seen.column("user").to_numpy()), np.searchsorted(i_id, seen.column("seen").to_numpy())
        score[row, col] = -np.inf
        # the product's last bits depend on the block's shape: it nominates, the sums below decide
        least = np.partition(score, -n, axis=1)[:, -n] if n < len(i_id) else np.full(len(u_id), -np.inf)
        slack = 1e-12 * rank * np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1).max() + 1e-300
        i, j = np.nonzero((score >= (least - slack)[:, None]) & (score > -np.inf))
        exact = x[i, 0] * y[j, 0]
        for c in range(1, rank):
            exact = exact + x[i, c] * y[j, c]
        order = np.lexsort((j, -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        out = u_id[i[place < n]], i_id[j[place < n]], exact[place < n]
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["user", "item", "score"])


def _top(rows: DataFrame, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "item"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= n)


def search(users: DataFrame, items: DataFrame, rank: int, n: int, seen: DataFrame | None = None, block: int = 4096, user_block: int = 1024) -> tuple[DataFrame, dict[str, int]]:
    """(user, item, score, rank) of each user's n best items, and how many leaves there were and how many visits were made.

    users, items: (id, features). seen: (user, item) pairs that aren't recommended. block, user_block: rows of a task, about.
    """
    if n < 1 or rank < 1:
        raise ValueError("n and rank are at least 1")
    spark = users.sparkSession
    with Tables() as tables:
        asking = cut(_factors(users, "user", rank))
        goods = cut(_factors(items, "item", rank))
        pairs = None if seen is None else seen.select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item"))
        goods, pairs = _possible(goods, pairs, n)
        tree = spark.sparkContext.broadcast(_tree(goods, rank, block))

        def deal(batches):
            for batch in batches:
                yield batch.append_column("leaf", pa.array(tree.value.leaf(_matrix(batch.column("v"), rank)), pa.int32()))

        # a leaf that the sample made too large is compared in parts
        goods = cut(goods.mapInArrow(deal, "item long, v array<double>, leaf int"), goods)
        parts = cut(goods.groupBy("leaf").agg(F.ceil(F.count("*") / block).alias("parts")))
        goods = cut(goods.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts"))), goods)
        leaves = _leaves(goods, rank)
        sent = spark.sparkContext.broadcast(leaves)
        gone = None
        if pairs is not None:
            gone = cut(pairs.join(goods.select("item", "leaf", "part"), "item").select("user", F.col("item").alias("seen"), "leaf", "part"), pairs)

        best = cut(spark.createDataFrame([], "user long, item long, score double, rank int"))
        visits, first, wave = 0, 0, 1
        while first < len(leaves.ids):

            def ask(batches, first=first, last=first + wave):
                for batch in batches:
                    for k in range(0, batch.num_rows, 1024):
                        some = batch.slice(k, 1024)
                        least = some.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                        i, leaf = sent.value.wave(_matrix(some.column("v"), rank), least, first, last)
                        for m in range(0, len(i), 65536):
                            at = pa.array(i[m : m + 65536])
                            yield pa.record_batch([some.column("user").take(at), some.column("v").take(at), pa.array(leaf[m : m + 65536], pa.int32())], names=["user", "v", "leaf"])

            least = best.groupBy("user").agg(F.when(F.count("*") >= n, F.min("score")).alias("least"))
            known = asking.join(least, "user", "left").select("user", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
            asks = cut(known.mapInArrow(ask, ASK))
            # a row for each leaf asked for, so at most MOST_LEAVES; written, that a hot leaf's askers can be split
            load = cut(asks.groupBy("leaf").agg(F.count("*").alias("asked")).join(parts, "leaf").withColumn("u_parts", F.ceil(F.col("asked") / user_block)))
            now = load.agg(F.sum("asked")).first()[0] or 0
            if not now:
                break  # later bounds are no greater, and a user's n-th best never falls
            visits += now
            if first:  # who doesn't ask now never asks again
                still = cut(asks.select("user").distinct())
                asking = cut(asking.join(still, "user", "left_semi"), asking)
                gone = gone if gone is None else cut(gone.join(still, "user", "left_semi"), gone)
                drop(still)
            u_part = F.pmod(F.xxhash64("user"), F.col("u_parts")).alias("u_part")
            each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
            left = goods.join(F.broadcast(load.select("leaf", "u_parts")), "leaf").select("leaf", "part", each("u_parts").alias("u_part"), "item", "v")
            right = asks.join(F.broadcast(load), "leaf").select("leaf", each("parts").alias("part"), u_part, "user", "v", F.lit(None).cast("long").alias("seen"))
            if gone is not None:
                met = gone.join(asks.select("user", "leaf"), ["user", "leaf"], "left_semi").join(F.broadcast(load.select("leaf", "u_parts")), "leaf")
                right = right.union(met.select("leaf", "part", u_part, "user", F.lit(None).cast("array<double>").alias("v"), "seen"))
            key = ["leaf", "part", "u_part"]
            compare = lambda y, x: _best_of_block(y, x, rank, n)
            found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "user long, item long, score double")
            best = cut(_top(best.select("user", "item", "score").union(found), n), best, asks, load)
            first, wave = first + wave, 2 * wave
        tables.keep(best)
    best.tables = tables
    return best, {"leaves": len(leaves.ids), "visits": visits}


def recommend(users: DataFrame, items: DataFrame, rank: int, n: int, seen: DataFrame | None = None, block: int = 4096, user_block: int = 1024) -> DataFrame:
    """(user, item, rank, prediction): each user's n best items that they haven't seen. See ``search``."""
    best, _ = search(users, items, rank, n, seen, block, user_block)
    return best.select("user", "item", "rank", F.col("score").alias("prediction"))
