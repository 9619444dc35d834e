"""Ratings that stay in their blocks, and factors that travel to the blocks that need them.

The ratings of one side are dealt into blocks once and cached, each entity's together.
For a pass over them, the other side's factors are joined to their out-links, which
say what blocks need them, and sent there, once to each; a block's own entities get
their state in the same exchange. So no rating moves again, an entity with few
ratings is summed up and finished where its ratings lie, and sums of ``k * k`` values
travel only for entities with so many ratings that they lie in several blocks.

Blocks are ranges of ids with about as many ratings each. Where ids that lie together
rate the same entities (customers of one region, numbers given out over time), a block
needs few of the other side's factors; where ids say nothing, no more than any dealing does.

An entity's ratings are added in their order, and scalars by exact sums, so results
don't depend on blocks or partitions, to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions import exact
from factorloom.operators.solvers import cholesky, nnls, pack, unpack
from factorloom.plans.lineage import cut, drop, forget

PART = 1 << 18  # ratings of an entity in one block
_NAMED = 4096  # blocks up to which each gets a partition of its own


PACKED = "block int, ids binary, whole binary, ends binary, known binary, at binary, rating binary"


@dataclass
class Blocks:
    """Packed ratings (a row for each block), and where factors go.

    A packed block holds its entities' ids, whether all of their ratings are here, where the ratings of each end, the ids of
    the other side that are rated here and, for each rating, which of them it is of and its value.
    mine: (id, block) for entities in several blocks, else None; theirs: (id, block), the blocks that need a factor of the
    other side; placed: adds the column ``block`` to rows with an id, if each is in one; written: the table that ratings are
    cached from, so that the exchange that dealt them isn't kept.
    """

    key: str
    ratings: DataFrame
    theirs: DataFrame
    mine: DataFrame | None
    placed: Callable[[DataFrame], DataFrame]
    partitions: int
    written: DataFrame

    def unpersist(self) -> None:
        for df in (self.ratings, self.theirs, self.mine):
            if df is not None:
                df.unpersist()
        drop(self.written)


@lru_cache(maxsize=64)
def _names(spark: SparkSession, n: int) -> list[int]:
    """Numbers of which ``repartition(n, ..)`` sends each to another partition."""
    number = F.col("id").cast("int")
    rows = spark.range(40 * n).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("p")).agg(F.min(number).alias("x")).collect()
    return sorted(r["x"] for r in rows)


def _block(n: int, names: list[int] | None, *columns) -> Column:
    slot = F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    return slot if names is None else F.array(*map(F.lit, names))[slot]


def _ranges(ratings: DataFrame, key: str, n: int) -> list[float]:
    """The ends of up to n ranges of ids, each with about as many ratings: at most n numbers come to the driver."""
    if n < 2:
        return []
    found = ratings.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0]
    return sorted({float(x) for x in found or ()})


def _placed(ends: list[float], names: list[int] | None) -> Callable[[DataFrame], DataFrame]:
    """Adds the block of each id's range; an end is the last id of its range."""
    # a range holds its first number and not its last; very large ids are rounded, each always alike
    splits = [-float("inf"), *sorted({np.nextafter(x, np.inf) for x in ends}), float("inf")]
    bucket = Bucketizer(splits=splits, inputCol="__id", outputCol="__slot") if ends else None

    def run(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("__id", F.col("id").cast("double"))
        rows = (bucket.transform(rows) if bucket else rows.withColumn("__slot", F.lit(0))).withColumn("__slot", F.col("__slot").cast("int"))
        return rows.withColumn("block", F.col("__slot") if names is None else F.array(*map(F.lit, names))[F.col("__slot")]).drop("__id", "__slot")

    return run


def deal(ratings: DataFrame, key: str, sizes: DataFrame, partitions: int, level: StorageLevel = StorageLevel.MEMORY_AND_DISK, part: int = PART, many: int | None = None) -> Blocks:
    """Blocks of one side's ratings; sizes: (id, n), the rows of each entity; part: of an entity in one block, about.

    many: the number of entities with more rows than that, if it is known.
    """
    spark = ratings.sparkSession
    names = _names(spark, partitions) if partitions <= _NAMED else None
    blocks = len(names) if names is not None else 4 * partitions
    other = "item" if key == "user" else "user"
    rows = ratings.select(F.col(key).alias("id"), F.col(other).alias("other"), "rating")
    zero = F.lit(0).cast("long")
    placed = _placed(_ranges(ratings, key, blocks), names)
    hot = sizes.filter(F.col("n") > part).select("id", F.ceil(F.col("n") / part).alias("__parts"))
    many = hot.count() if many is None else many
    if many:
        hot = F.broadcast(hot) if many <= 1 << 20 else hot  # of 16 bytes each
        rows = rows.join(hot, "id", "left")
        salt = F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64("other"), F.col("__parts"))).otherwise(zero)
        block = F.when(F.col("__parts").isNotNull(), _block(blocks, names, F.col("id"), salt)).otherwise(F.col("block"))
        rows = placed(rows).select(block.alias("block"), F.col("__parts").isNull().alias("whole"), "id", "other", "rating")
    else:
        rows = placed(rows).select("block", F.lit(True).alias("whole"), "id", "other", "rating")
    written = cut(rows.repartition(partitions, "block").groupBy("block").applyInArrow(_pack, PACKED))
    forget(spark)
    packed = written.repartition(partitions, "block").persist(level)
    links = lambda column: packed.select("block", column).mapInArrow(_links, "id long, block int").repartition(partitions, "id").persist(level)
    return Blocks(key, packed, links("known"), links("ids") if many else None, placed, partitions, written)


def _pack(rows: pa.Table) -> pa.Table:
    ids, other, r, whole = (rows.column(c).to_numpy() for c in ("id", "other", "rating", "whole"))
    order = np.lexsort([r, other, ids])
    ids, other, r, whole = ids[order], other[order], r[order], whole[order]
    ends = np.append(np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids))
    known, at = np.unique(other, return_inverse=True)
    columns = [ids[ends - 1], whole[ends - 1], ends.astype(np.int64), known, at.astype(np.int32), r]
    return pa.table([rows.column("block").slice(0, 1), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names=[c.split()[0] for c in PACKED.split(", ")])


def _links(batches):
    """(id, block) for each id in a packed column."""
    for batch in batches:
        for block, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.frombuffer(ids.as_buffer(), np.int64)
            yield pa.record_batch([pa.array(ids), pa.array(np.full(len(ids), block, np.int32))], names=["id", "block"])


class Slice:
    """Ratings of some whole entities, or of a part of one: r, y (name -> a row for each rating), x (name -> a row for each entity)."""

    def __init__(self, r: np.ndarray, y: dict[str, np.ndarray], x: dict[str, np.ndarray], begin: np.ndarray):
        self.r, self.y, self.x, self.begin = r, y, x, begin
        self.of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(r))))

    def add(self, values: np.ndarray) -> np.ndarray:
        """Sums of the rows of each entity, in their order."""
        return np.add.reduceat(values, self.begin, axis=0)

    def outer(self, y: np.ndarray, weight: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Packed sums of weight y y'."""
        left = y if weight is None else y * weight[:, None]
        if y.shape[1] <= 12:
            return self.add(left[:, i] * y[:, j])
        ends = np.append(self.begin, len(y))
        return np.stack([(left[a:b].T @ y[a:b])[i, j] for a, b in zip(ends[:-1], ends[1:], strict=True)])


@dataclass
class Pass:
    """What is summed over an entity's ratings, and what is made of the sums.

    own, other: vectors of the entity and of the rated ones that it needs; sums: (slice) -> a row of numbers for each entity;
    finish: (sums, own vectors) -> columns of ``made``.
    """

    rank: int
    other: tuple[str, ...]
    own: tuple[str, ...]
    made: str
    sums: Callable[[Slice], np.ndarray]
    finish: Callable[[np.ndarray, dict[str, np.ndarray]], list[np.ndarray]]


def _matrix(column: pa.ChunkedArray, k: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), k)


def _listed(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.reshape(-1)))


def _column(x: np.ndarray) -> pa.Array:
    return _listed(x) if x.ndim == 2 else pa.array(x)


def _held(table: pa.Table, ids: np.ndarray, columns: tuple[str, ...], k: int, what: str) -> dict[str, np.ndarray]:
    """The vectors of these ids, in their order."""
    found = table.column("id").to_numpy()
    order = np.argsort(found)
    at = np.minimum(np.searchsorted(found, ids, sorter=order), max(len(found) - 1, 0))
    at = order[at] if len(found) else at
    if len(ids) and (not len(found) or (found[at] != ids).any()):
        raise ValueError(what)
    return {c: _matrix(table.column(c), k)[at] for c in columns}


def _entities(ratings: pa.Table, routed: pa.Table, p: Pass):
    """A block's (ids, whole, own vectors, sums of all entities)."""
    field = lambda c, kind: np.frombuffer(ratings.column(c)[0].as_buffer(), kind)
    ids, whole, ends, known, at, r = (field(c, t) for c, t in (("ids", np.int64), ("whole", bool), ("ends", np.int64), ("known", np.int64), ("at", np.int32), ("rating", float)))
    begin = np.append(0, ends[:-1])
    y = _held(routed.filter(pc.invert(routed.column("own"))), known, p.other, p.rank, "a rating's other end has no factor")
    x = _held(routed.filter(routed.column("own")), ids, p.own, p.rank, "an entity has no state") if p.own else {}
    ends = np.append(0, ends)
    step = max(256, (1 << 20) // (p.rank * max(1, min(p.rank, 12))))
    parts, e = [], 0
    while e < len(begin):
        last = max(e + 1, int(np.searchsorted(ends, ends[e] + step, side="right")) - 1)
        slices = [p.sums(Slice(r[i:j], {c: v[at[i:j]] for c, v in y.items()}, {c: v[e:last] for c, v in x.items()}, begin[e:last] - ends[e])) for i, j in _runs(ends[e], ends[last], last - e, step)]
        parts.append(sum(slices[1:], slices[0]))
        e = last
    return ids, whole, x, np.concatenate(parts)


def _runs(begin: int, end: int, entities: int, step: int) -> list[tuple[int, int]]:
    """One run for several entities; an entity alone is cut, from its first rating on."""
    return [(begin, end)] if entities > 1 else [(i, min(i + step, end)) for i in range(begin, end, step)]


def _routed(b: Blocks, other: DataFrame, own: DataFrame | None, p: Pass) -> DataFrame:
    """(to, own, id, vectors): what each block needs for a pass."""
    vectors = dict.fromkeys((*p.other, *p.own))
    empty = F.array().cast("array<double>")  # not null: runs of null lists make the way to Python quadratic
    their = other.select("id", *p.other).join(b.theirs, "id").select(F.col("block").alias("to"), F.lit(False).alias("own"), "id", *(F.col(c) if c in p.other else empty.alias(c) for c in vectors))
    if not p.own:
        return their
    held = own.select("id", *p.own)
    held = b.placed(held) if b.mine is None else held.join(b.mine, "id")
    return their.union(held.select(F.col("block").alias("to"), F.lit(True).alias("own"), "id", *(F.col(c) if c in p.own else empty.alias(c) for c in vectors)))


def run(b: Blocks, p: Pass, other: DataFrame, own: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the own vectors, what the pass makes) for each entity; other, own: (id, vectors); keep: own vectors that stay."""
    p = replace(p, own=tuple(dict.fromkeys((*p.own, *keep))))
    schema = "id long, " + "".join(f"{c} array<double>, " for c in p.own) + p.made
    split = b.mine is not None
    names = [c.split()[0] for c in schema.split(", ")]

    def finished(ids: np.ndarray, x: dict[str, np.ndarray], sums: np.ndarray) -> list[pa.Array]:
        return [pa.array(ids), *(_column(x[c]) for c in p.own), *map(_column, p.finish(sums, x))]

    def block(ratings: pa.Table, routed: pa.Table) -> pa.Table:
        if not ratings.num_rows:
            return _none(schema + (", block int, sums array<double>" if split else ""))
        ids, whole, x, sums = _entities(ratings, routed, p)
        if not split:
            return pa.table(finished(ids, x, sums), names=names)
        done = pa.table(finished(ids[whole], {c: v[whole] for c, v in x.items()}, sums[whole]), names=names)
        ids, x, sums = ids[~whole], {c: v[~whole] for c, v in x.items()}, sums[~whole]
        parts = pa.table([pa.array(ids), *(_column(x[c]) for c in p.own), pa.array([ratings.column("block")[0].as_py()] * len(ids), pa.int32()), _listed(sums)], names=["id", *p.own, "block", "sums"])
        return pa.concat_tables([done, parts], promote_options="default").select([*names, "block", "sums"])

    made = b.ratings.groupBy("block").cogroup(_routed(b, other, own, p).groupBy("to")).applyInArrow(block, schema + (", block int, sums array<double>" if split else ""))
    if not split:
        return made
    made = cut(made)

    def joined(batches):
        """Adds the parts of an entity, which come in the order of their blocks."""
        now, x, total = None, None, None

        def out():
            return pa.record_batch(finished(np.array([now]), {c: np.array([v]) for c, v in x.items()}, total[None, :]), names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if row["id"] != now:
                    if now is not None:
                        yield out()
                    now, x, total = row["id"], {c: row[c] for c in p.own}, np.array(row["sums"])
                else:
                    total = total + np.array(row["sums"])
        if now is not None:
            yield out()

    parts = made.filter(F.col("sums").isNotNull()).select("id", *p.own, "block", "sums").repartition("id").sortWithinPartitions("id", "block")
    return made.filter(F.col("sums").isNull()).select(*names).union(parts.mapInArrow(joined, schema))


def _none(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.table({c.split()[0]: pa.array([], kinds[c.split()[1]]) for c in schema.split(", ")})


def scalars(b: Blocks, p: Pass, other: DataFrame, own: DataFrame) -> DataFrame:
    """Counters (``exact.COUNTERS``) of the sums over all entities of a pass's numbers."""

    def block(ratings: pa.Table, routed: pa.Table) -> pa.Table:
        if not ratings.num_rows:
            return _none(exact.COUNTERS).cast(pa.schema([("name", pa.int32()), ("at", pa.int32()), ("v", pa.int64())]))
        return pa.Table.from_batches([exact.counters(_entities(ratings, routed, p)[3])])

    return b.ratings.groupBy("block").cogroup(_routed(b, other, own, p).groupBy("to")).applyInArrow(block, exact.COUNTERS)


# --- passes


def _times(g: np.ndarray, x: np.ndarray) -> np.ndarray:
    """g x for each row, added up in the order of columns."""
    out = np.zeros_like(x)
    for j in range(x.shape[1]):
        out += g[..., j] * x[:, j : j + 1]
    return out


def weights(r: np.ndarray, implicit: bool, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counted, weight, pull) of ratings: what counts as one, the weight of y y' and the factor of y on the right side.

    Implicit: a rating over 0 is a preference of 1 seen with confidence c = 1 + alpha r; all else is a preference of 0 with
    confidence 1 and in the other side's whole Gram matrix, so the weight is c - 1.
    """
    if not implicit:
        return np.ones(len(r)), np.ones(len(r)), r
    seen = (r > 0).astype(float)
    return seen, seen * alpha * np.abs(r), seen * (1 + alpha * np.abs(r))


def solving(rank: int, ridge: float, nonnegative: bool = False, implicit: bool = False, alpha: float = 1.0, whole: np.ndarray | None = None, state: str | None = None, by: str = "factor", graded: str | None = None, other_whole: np.ndarray | None = None) -> Pass:
    """n, solved and loss of each entity against the vectors ``by`` of the other side; with ``state`` also grad and was.

    whole: the Gram matrix of all vectors ``by`` (implicit). state: the entity's vector at which the gradient and the value are
    wanted, against ``by`` or, if given, against the vectors ``graded`` (``was`` is NaN then), whose Gram matrix is other_whole.
    """
    i, j = pack(rank)
    k2 = len(i)
    everywhere = np.zeros((rank, rank)) if whole is None else whole

    def sums(s: Slice) -> np.ndarray:
        y = s.y[by]
        n, weight, right = weights(s.r, implicit, alpha)
        parts = [s.add(np.stack([n, right if implicit else s.r * s.r], axis=1)), s.outer(y, weight if implicit else None, i, j), s.add(y * right[:, None])]
        if graded:
            y, z = s.y[graded], (s.x[state][s.of] * s.y[graded]).sum(axis=1)
            off = weight * z - right if implicit else z - right
            parts.append(s.add(y * off[:, None]))
        return np.concatenate(parts, axis=1)

    def finish(sums: np.ndarray, x: dict[str, np.ndarray]) -> list[np.ndarray]:
        n, square, right = sums[:, 0], sums[:, 1], sums[:, 2 + k2 : 2 + k2 + rank]
        g = unpack(sums[:, 2 : 2 + k2], rank) + everywhere

        def at(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Half the gradient and the value at x."""
            pull = _times(g, x) + ridge * n[:, None] * x - right
            return pull, square + ((pull - right) * x).sum(axis=1)

        solved = (nnls if nonnegative else cholesky)(g, right, ridge * n)
        out = [n, solved, at(solved)[1]]
        if state and graded:
            more = _times(np.broadcast_to(other_whole, (len(n), rank, rank)), x[state]) if implicit else 0.0
            out += [2 * (sums[:, 2 + k2 + rank :] + ridge * n[:, None] * x[state] + more), np.full(len(n), np.nan)]
        elif state:
            pull, was = at(x[state])
            out += [2 * pull, was]
        return out

    made = "n double, solved array<double>, loss double" + (", grad array<double>, was double" if state else "")
    return Pass(rank, tuple(dict.fromkeys((by, *([graded] if graded else [])))), (state,) if state else (), made, sums, finish)


def grading(rank: int, ridge: float, implicit: bool = False, alpha: float = 1.0, whole: np.ndarray | None = None) -> Pass:
    """n, grad and error (the ratings' part of the objective) of each entity at ``factor``."""

    def sums(s: Slice) -> np.ndarray:
        y, (n, weight, right) = s.y["factor"], weights(s.r, implicit, alpha)
        z = (s.x["factor"][s.of] * y).sum(axis=1)
        off, value = (weight * z - right, weight * z * z - 2 * right * z + right) if implicit else (z - right, (z - right) ** 2)
        return np.concatenate([s.add(np.stack([n, value], axis=1)), s.add(y * off[:, None])], axis=1)

    def finish(sums: np.ndarray, x: dict[str, np.ndarray]) -> list[np.ndarray]:
        n, own = sums[:, 0], x["factor"]
        more = _times(np.broadcast_to(whole, (len(n), rank, rank)), own) if implicit else 0.0
        return [n, 2 * (sums[:, 2:] + ridge * n[:, None] * own + more), sums[:, 1]]

    return Pass(rank, ("factor",), ("factor",), "n double, grad array<double>, error double", sums, finish)


def along(rank: int, implicit: bool = False, alpha: float = 1.0) -> Pass:
    """c0 .. c4 of the ratings' part of the objective at factor + t p on both sides."""

    def sums(s: Slice) -> np.ndarray:
        x, p, y, q = s.x["factor"][s.of], s.x["p"][s.of], s.y["factor"], s.y["p"]
        z = (x * y).sum(axis=1), (x * q).sum(axis=1) + (p * y).sum(axis=1), (p * q).sum(axis=1)
        if implicit:
            _, weight, right = weights(s.r, implicit, alpha)
            line = right, right, right
            more = right
        else:
            z = z[0] - s.r, z[1], z[2]
            weight, line, more = 1.0, (0.0, 0.0, 0.0), 0.0
        c = [
            weight * z[0] * z[0] - 2 * line[0] * z[0] + more, 2 * weight * z[0] * z[1] - 2 * line[1] * z[1], weight * (z[1] * z[1] + 2 * z[0] * z[2]) - 2 * line[2] * z[2],
            2 * weight * z[1] * z[2], weight * z[2] * z[2],
        ]
        return s.add(np.stack(c, axis=1))

    return Pass(rank, ("factor", "p"), ("factor", "p"), "c double", sums, lambda sums, x: [sums[:, 0]])


def trying(rank: int, steps: list[tuple[float, str]], implicit: bool = False, alpha: float = 1.0) -> Pass:
    """The ratings' part of the objective at each of some points of the orthant: max(0, factor + t d) on both sides.

    steps: (t, the vector d).
    """
    vectors = ("factor", *dict.fromkeys(d for _, d in steps))

    def sums(s: Slice) -> np.ndarray:
        n, weight, right = weights(s.r, implicit, alpha)
        out = []
        for t, d in steps:
            x, y = (np.maximum(v["factor"] + t * v[d], 0.0) for v in (s.x, s.y))
            z = (x[s.of] * y).sum(axis=1)
            out.append(weight * z * z - 2 * right * z + right if implicit else (z - right) ** 2)
        return s.add(np.stack(out, axis=1))

    return Pass(rank, vectors, vectors, "value double", sums, lambda sums, x: [sums[:, 0]])
