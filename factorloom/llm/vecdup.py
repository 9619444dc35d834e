"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of a vector, are trained on a bounded sample;
their product is a grid of cells. A vector lies in the cell of its two nearest
codewords. To look for its neighbours it visits cells by the multi-sequence
order, the sum of the two squared distances to a cell's codewords, and compares
itself with every vector of its label in them. How many cells are visited is
found by the sample: enough that ``recall`` of partners at cosines from the
threshold upwards lie in them.

Equal vectors of a label are one node with a weight. Cells are split into blocks
of bounded size on both sides, so no cell has a cap and no task gets a whole hot
one; blocks are compared by matrix products in double precision. Of the links of
a block only sums for each node and a spanning forest leave the task. A pair that
only one of its ends visits counts for both.

Defined cases: a row whose label or vector is null, or whose vector is zero, empty
or holds a null or non-finite component, links with nothing and is its own
component; vectors are compared with those of their own length; repeated rows are
separate vectors; a null id names no component; an empty table gives no rows, and a
vector has no greatest length. Vectors are told apart by 64 bits of a hash. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import cut, drop
from factorloom.llm.components import components
from factorloom.llm.topk import usable


def kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Codewords of a sample; starts from rows spread evenly over it."""
    k = max(1, min(k, len(points)))
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = squared(points, centres).argmin(axis=1)
        for i in np.unique(near):
            centres[i] = points[near == i].mean(axis=0)
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :], 0)


class Grid:
    """Codebooks of both halves and the number of cells a vector visits."""

    def __init__(self, sample: np.ndarray, codewords: int, threshold: float, recall: float, seed: int = 10):
        self.half = sample.shape[1] // 2
        self.books = kmeans(sample[:, : self.half], codewords), kmeans(sample[:, self.half :], codewords)
        sample = sample[:4096]  # for the number of visits
        random = np.random.Generator(np.random.PCG64(seed))
        noise = random.standard_normal(sample.shape)
        noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
        cosine = random.uniform(threshold, 1, (len(sample), 1))
        home = self.homes(cosine * sample + np.sqrt(1 - cosine**2) * noise)
        self.visits = int(np.quantile(self.ranks(sample, home), recall, method="higher")) + 1

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.half], self.books[0]), squared(x[:, self.half :], self.books[1])

    def homes(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)

    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells a vector visits before the given one."""
        a, b = self.distances(x)
        each = np.arange(len(x))
        upto = a[each, cells // b.shape[1]] + b[each, cells % b.shape[1]]
        near_b = np.sort(b, axis=1)
        return np.array([np.searchsorted(near_b[i], upto[i] - a[i]).sum() for i in each])

    def order(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The first cells of each vector's multi-sequence, the nearest first.

        A cell whose codewords are i-th and j-th nearest comes after the i * j cells that are nearer in both halves,
        so only pairs of ranks with (i + 1) * (j + 1) <= visits can be among the first.
        """
        a, b = self.distances(x)
        near_a, near_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        ranks = np.array([(i, j) for i in range(min(a.shape[1], visits)) for j in range(min(b.shape[1], visits // (i + 1)))])
        i, j = near_a[:, ranks[:, 0]], near_b[:, ranks[:, 1]]
        total = np.take_along_axis(a, i, 1) + np.take_along_axis(b, j, 1)
        best = np.argsort(total, axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(i * b.shape[1] + j, best, 1)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each linked row and column the smallest node of its part of the bipartite graph."""
    far = np.iinfo(np.int64).max
    row, col = np.where(linked.any(axis=1), left, far), np.where(linked.any(axis=0), right, far)
    while True:
        new = np.minimum(row, np.where(linked, col[None, :], far).min(axis=1, initial=far))
        new_col = np.minimum(col, np.where(linked, new[:, None], far).min(axis=0, initial=far))
        if (new == row).all() and (new_col == col).all():
            return row, col
        row, col = new, new_col


def links(nodes: DataFrame, grid_of: dict[int, Grid], threshold: float, block: int = 1024, groups: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, links) sums and (a, b) spanning links of nodes (node, label, v, weight); ``grid_of``: by vector length.

    groups: how many groups the pairs of blocks are dealt into; if not given, as many as hold about 65,536 rows each, those
    that a hot cell's blocks repeat included.
    """
    spark = nodes.sparkSession
    sent = spark.sparkContext.broadcast(grid_of)

    def place(batches):
        for batch in batches:
            v = batch.column("v")
            size = np.diff(v.offsets.to_numpy())
            home, cells = np.zeros(len(size), np.int64), [None] * len(size)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                grid, x = sent.value[int(n)], _unit(_matrix(v.take(pa.array(at))))
                home[at] = grid.homes(x)
                for i, row in zip(at, grid.order(x, grid.visits), strict=True):
                    cells[i] = row
            yield pa.record_batch([*batch.columns, pa.array(home), pa.array(cells, pa.list_(pa.int64()))], names=[*batch.schema.names, "home", "cells"])

    schema = f"node long, label {nodes.schema['label'].dataType.simpleString()}, v array<{nodes.schema['v'].dataType.elementType.simpleString()}>, weight long, home long, cells array<long>"
    placed = cut(nodes.select("node", "label", "v", "weight").mapInArrow(place, schema).withColumn("dim", F.size("v")))
    cell = ["label", "dim", "cell"]
    lying = placed.groupBy("label", "dim", F.col("home").alias("cell")).agg(F.count("*").alias("n"), F.ceil(F.count("*") / block).alias("blocks"))
    asking = placed.select("label", "dim", F.explode("cells").alias("cell")).groupBy(*cell).agg(F.count("*").alias("q"), F.ceil(F.count("*") / block).alias("q_blocks"))
    # a cell nobody visits or nobody lies in gives nothing; cut, so that the joins below can split a hot cell
    cells = cut(lying.join(asking, cell))
    if groups is None:
        groups = max(64, (cells.agg(F.sum(F.col("n") * F.col("q_blocks") + F.col("q") * F.col("blocks"))).first()[0] or 0) // 65536)
    each = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)) + 1
    both = ["node", "v", "weight", "home", "cells", "cell", "label", "dim"]
    members = placed.withColumn("cell", F.col("home")).join(cells, cell).select(*both, mine("blocks").alias("block"), each("q_blocks").alias("q_block"))
    askers = placed.withColumn("cell", F.explode("cells")).join(cells, cell).select(*both, mine("q_blocks").alias("q_block"), each("blocks").alias("block"))
    task = F.xxhash64("label", "dim", "cell", "block", "q_block")
    sent_on = ("node", "v", "weight", "home", "cells")
    members, askers = (x.select(*(F.col(c).alias(c) for c in sent_on), task.alias("task"), F.pmod(task, F.lit(groups)).cast("int").alias("g")) for x in (members, askers))

    def compare(lying: pa.Table, asking: pa.Table) -> pa.Table:
        node, count, root = [], [], []
        l_task, a_task = lying.column("task").to_numpy(), asking.column("task").to_numpy()
        l_order, a_order = np.argsort(l_task, kind="stable"), np.argsort(a_task, kind="stable")
        for t in np.intersect1d(l_task, a_task):
            y = lying.take(l_order[slice(*np.searchsorted(l_task[l_order], [t, t + 1]))]) if t < 2**63 - 1 else lying.filter(pa.array(l_task == t))
            x = asking.take(a_order[slice(*np.searchsorted(a_task[a_order], [t, t + 1]))]) if t < 2**63 - 1 else asking.filter(pa.array(a_task == t))
            x_id, y_id = x.column("node").to_numpy(), y.column("node").to_numpy()
            linked = (_unit(_matrix(x.column("v"))) @ _unit(_matrix(y.column("v"))).T >= threshold) & (x_id[:, None] != y_id[None, :])
            if not linked.any():
                continue
            # does y visit x's cell as well? then the pair is met there for y
            x_home, y_cells = x.column("home").to_numpy(), _matrix(y.column("cells")).astype(np.int64)
            i, j = np.nonzero(linked)
            one_way = ~(y_cells[j] == x_home[i][:, None]).any(axis=1)
            x_weight, y_weight = x.column("weight").to_numpy(), y.column("weight").to_numpy()
            x_root, y_root = _roots(linked, x_id, y_id)
            for ids, sums, roots, some in ((x_id, linked @ y_weight, x_root, linked.any(axis=1)), (y_id, np.bincount(j[one_way], x_weight[i[one_way]], len(y_id)).astype(np.int64), y_root, linked.any(axis=0))):
                node.append(ids[some])
                count.append(sums[some])
                root.append(roots[some])
        node, count, root = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (node, count, root))
        return pa.table([pa.array(node), pa.array(count), pa.array(root)], names=["node", "links", "root"])

    found = cut(members.groupBy("g").cogroup(askers.groupBy("g")).applyInArrow(compare, "node long, links long, root long"), placed, cells)
    return found.groupBy("node").agg(F.sum("links").alias("links")), found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()


def near_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = 0.98, sample: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row."""
    vector = F.col("v")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    good = usable(vector) & F.col("label").isNotNull() & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", good).withColumn("k1", F.xxhash64("label", "v")).withColumn("k2", F.xxhash64("v", "label"))
    nodes = rows.filter("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = cut(nodes.withColumn("node", F.col("k1")))  # not the id: rows of one id may hold different vectors
    total = nodes.count()
    # cells of about 256 vectors: codewords grow with the root of the table, and with them the sample (131,072 rows at most)
    codewords = int(min(4096, max(4, np.ceil(np.sqrt(total / 256)))))
    picked: dict[int, list] = {}
    for r in nodes.select("v").orderBy("k2").limit(max(sample, 32 * codewords)).collect():
        picked.setdefault(len(r["v"]), []).append(r["v"])
    for r in nodes.groupBy(F.size("v").alias("n")).agg(F.first("v").alias("v")).collect():
        picked.setdefault(r["n"], [r["v"]])  # a rare length has a grid too
    grids = {n: Grid(_unit(np.asarray(v, np.float64)), codewords, threshold, recall) for n, v in picked.items()}
    if not grids:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sums, spanning = links(nodes, grids, threshold)
    joined = nodes.join(sums, "node", "left").join(components(spanning), "node", "left")
    joined = joined.select("k1", "k2", F.lit(True).alias("good"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "node").alias("component"), "least")
    joined = cut(joined, nodes)
    names = cut(joined.groupBy("component").agg(F.min("least").alias("component_id")))
    joined = joined.join(names, "component").select("k1", "k2", "good", "n", "component_id")
    out = rows.join(joined, ["k1", "k2", "good"], "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: DuckDB SQL for ``near_duplicates`` if it finds every link: all pairs of a label, and what can be reached by links.
ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS a, b.r AS b, b.vec_id FROM v AS a JOIN v AS b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT r, r AS at FROM v UNION SELECT reach.r, link.b FROM reach JOIN link ON link.a = reach.at),
named AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.at GROUP BY reach.r),
sums AS (SELECT a AS r, count(*) AS n_links FROM link GROUP BY a),
found AS (SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id FROM v JOIN named USING (r) LEFT JOIN sums USING (r)),
other AS (SELECT vec_id, 0 AS n_links, vec_id AS component_id FROM embeddings
          WHERE label IS NULL OR embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0)
SELECT vec_id, CAST(n_links AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM (SELECT * FROM found UNION ALL SELECT * FROM other)
"""
