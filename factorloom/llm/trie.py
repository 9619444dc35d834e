"""The trie of all conversations' beginnings, read off their sorted order.

Conversations are sorted by the digests of their turns and dealt into blocks of that
order. The lengths of the common beginnings of neighbours (LCP) form an array whose
Cartesian tree is the trie without its chains: a node is a largest run of neighbours
that share ``d`` turns, bounded by the nearest smaller values to either side. Each
block finds those of its own rows with one stack, merges nodes of equal LCP, and
expands the depths that a chain leaves out. What a node says of its members and its
subtree are counts, minima and differences of running sums over its run.

A run that goes on beyond its block is a piece. Where it begins is the nearest block
to the left with a smaller least LCP: a row for each block, with its least and its
first LCP, is all that the driver sees. Pieces of a run are added up by where it begins, so a
conversation that a third of all rows repeat costs every block a piece for each depth.

Turns count as equal by 128 bits of SHA-256 of role and text. Defined cases: null
role and text are empty; turns are ordered by turn (null first), equal turns by
their digest, and repeated rows are turns of their own; a conversation without turns
belongs to the root alone; rows without conv_id belong to no conversation; an empty
table has no nodes; texts of any length are read once, for digest and words; other
columns are ignored. A conversation's digests (20 bytes a turn) are one row, and a
block's lie in one task together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import cut, drop, small_batches
from factorloom.llm.mixing import word_count
from factorloom.llm.sharding import crc32_sql

NONE = hashlib.sha256(b"").hexdigest()
MARKED = "part int, at int, conv_id long, lcp int, words array<int>, edge binary"
FOUND = "part int, depth int, conv_id long, parent long, n_convs long, n_children long, n_leaves long, saved long, ends string, before long, begins int, parent_side int, parent_begins int, side int"


def gathered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the digest (32 hex digits) and words of each turn, in order."""
    small_batches(turns.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("t"), digest.alias("d"), word_count(text).cast("int").alias("w")).alias("x"))
    ordered = F.array_sort(F.collect_list("x"))
    return rows.groupBy("conv_id").agg(ordered.alias("x")).select("conv_id", F.transform("x", lambda x: F.struct(x["d"].alias("d"), x["w"].alias("w"))).alias("turns"))


def rebuilt(convs: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first turns are those of their group's first conversation: crc32(conv_id) modulo ``most`` of them."""
    first = convs.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    met = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(first, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return met.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def shared(digests: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many leading digests each sequence has in common with the one before; the first has none before it."""
    out = np.zeros(len(size), np.int64)
    live = np.arange(1, len(size))
    while len(live):
        depth = out[live]
        live = live[(size[live] > depth) & (size[live - 1] > depth)]
        depth = out[live]
        live = live[(digests[first[live] + depth] == digests[first[live - 1] + depth]).all(axis=1)]
        out[live] += 1
    return out


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column of runs of 16 bytes: all of them as pairs of numbers, and where each row's begin and how many they are."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    at = (offsets - offsets[0]) // 16
    return flat.view(np.uint64).reshape(-1, 2), at[:-1], np.diff(at)


def _mark(batches):
    """Sorted rows (part, conv_id, key, words) of a block with their LCPs; its first and its last row keep their key."""
    before, at, held = None, 0, None

    def out(batch: pa.RecordBatch, lcp: np.ndarray, edges: list) -> pa.RecordBatch:
        places = np.arange(at, at + batch.num_rows, dtype=np.int32)
        return pa.record_batch([batch.column("part"), pa.array(places), batch.column("conv_id"), pa.array(lcp.astype(np.int32)), batch.column("words"), pa.array(edges, pa.binary())], names=["part", "at", "conv_id", "lcp", "words", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key")
        known = keys if before is None else pa.concat_arrays([pa.array([before], pa.binary()), keys.cast(pa.binary())])
        lcp = shared(*_binary(known))[len(known) - len(keys) :]
        edges = [None] * len(keys)
        if before is None:
            edges[0] = keys[0].as_py()
        marked = out(batch, lcp, edges)
        before, at = keys[len(keys) - 1].as_py(), at + batch.num_rows
        if held is not None:
            yield held
        if len(marked) > 1:
            yield marked.slice(0, len(marked) - 1)
        held = marked.slice(len(marked) - 1, 1)
    if held is not None:  # the block's last row
        yield held.set_column(5, "edge", pa.array([before], pa.binary()))


def _meet(batches):
    """The LCP of each block's first row with the last row of the block before (-1: there is none)."""
    for batch in batches:
        lefts = []
        for a, b in zip(batch.column("before"), batch.column("first"), strict=True):
            lefts.append(-1 if a.as_py() is None else int(shared(*_binary(pa.array([a.as_py(), b.as_py()], pa.binary())))[1]))
        yield pa.record_batch([batch.column("part"), batch.column("inner"), pa.array(lefts, pa.int32())], names=["part", "inner", "lcp"])


def neighbours(blocks: list[tuple[int, int | None, int]]) -> list[tuple[int, int, int, list[int], list[int]]]:
    """For blocks (part, least LCP inside, LCP with the one before) in order: their LCPs to the left and the right, and the
    nearest blocks to the left with ever smaller least LCPs, and those."""
    least = [min(left, inner) if inner is not None else left for _, inner, left in blocks]
    out: list[tuple[int, int, int, list[int], list[int]]] = []
    stack: list[int] = []
    for i, (part, _, left) in enumerate(blocks):
        # from the nearest: each further block counts only if its least is smaller
        out.append((part, left, blocks[i + 1][2] if i + 1 < len(blocks) else -1, [blocks[s][0] for s in reversed(stack)], [least[s] for s in reversed(stack)]))
        while stack and least[stack[-1]] >= least[i]:
            stack.pop()
        stack.append(i)
    return out


def segments(lcp: list[int], size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of rows and the depths at which they are nodes: first, last, low, top and parent, the number of another or -1.

    lcp: one more than rows, -1 at both ends. One stack finds the nearest smaller values on both sides; equal values are one.
    """
    n = len(size)
    left, right, same = [0] * (n + 1), [n] * (n + 1), list(range(n + 1))
    stack = [[0, 0]]  # the first and the last place of each value that is still open
    for j in range(1, n + 1):
        value = lcp[j]
        while lcp[stack[-1][0]] > value:
            right[stack.pop()[0]] = j
        if lcp[stack[-1][0]] == value:
            same[j], stack[-1][1] = stack[-1][0], j
        else:
            left[j] = stack[-1][1]
            stack.append([j, j])
    values, left, right, same = (np.array(x, np.int64) for x in (lcp, left, right, same))
    inner = np.flatnonzero((same == np.arange(n + 1)) & (values >= 0))
    number = np.full(n + 1, -1, np.int64)
    number[inner] = np.arange(len(inner))
    rows = np.arange(n)
    alone = rows[size > np.maximum(values[:-1], values[1:])]
    begin, end = np.concatenate([left[inner], alone]), np.concatenate([right[inner], alone + 1])
    above = np.where(values[begin] >= values[end], begin, end)
    return begin, end - 1, values[above] + 1, np.concatenate([values[inner], size[alone]]), number[same[above]]


def _nodes(rows: pa.Table, info: pa.Table) -> pa.Table:
    """All nodes of a block and pieces of nodes."""
    rows = rows.sort_by("at").combine_chunks()
    n, part = rows.num_rows, info.column("part")[0].as_py()
    left, right = info.column("left")[0].as_py(), info.column("right")[0].as_py()
    blocks, leasts = np.array(info.column("blocks")[0].as_py(), np.int64), np.array(info.column("leasts")[0].as_py(), np.int64)
    conv = rows.column("conv_id").to_numpy()
    words = rows.column("words").chunk(0)
    size = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    total = np.concatenate([[0], np.cumsum(words.flatten().to_numpy(zero_copy_only=False).astype(np.int64))])
    lcp = np.concatenate([[left], rows.column("lcp").to_numpy()[1:], [right]]).astype(np.int64)
    begin, end, low, top, parent = segments([-1, *lcp[1:-1].tolist(), -1], size)

    running = lambda x: np.concatenate([[0], np.cumsum(x)])
    common = running(total[first[:-1] + np.maximum(lcp[:-1], 0)] - total[first[:-1]])
    leaf = running(lcp[1:] < size)
    bounds = np.append(np.stack([begin, end + 1], axis=1).reshape(-1), n)
    least = np.minimum.reduceat(np.append(conv, conv[-1]), bounds)[:-1:2]
    children = np.bincount(parent[parent >= 0], minlength=len(begin))
    # equal sequences lie together: how many from each first one
    copy = np.concatenate([[False], (lcp[1:-1] == size[1:]) & (size[1:] == size[:-1])])
    starts = np.flatnonzero(~copy)
    copies = np.zeros(n, np.int64)
    copies[starts] = np.diff(np.append(starts, n))

    # a node for each depth of a run
    count = top - low + 1
    of = np.repeat(np.arange(len(begin)), count)
    depth = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    b, e = begin[of], end[of]

    def sides(b: np.ndarray, e: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """0 for whole nodes, 1 for pieces of a run from the left, 2 of one to the right; and the block where the run begins."""
        from_left, to_right = (b == 0) & (depth <= left) & (depth >= 0), (e == n - 1) & (depth <= right) & (depth >= 0)
        origin = np.full(len(b), part, np.int64)
        origin[from_left] = blocks[np.searchsorted(-leasts, -depth[from_left], side="right")]  # the nearest block with a smaller least
        return np.where(from_left, 1, np.where(to_right, 2, 0)), origin

    side, origin = sides(b, e, depth)
    up = np.where(depth > low[of], of, parent[of])
    parent_side, parent_origin = sides(begin[up], end[up], depth - 1)
    saved = common[e + 1] - common[b + (side != 1)]
    before = total[first[b] + np.maximum(depth - 1, 0)] - total[first[b]]
    held = (e - b + 1).astype(np.int64)
    kids = np.where(depth < top[of], 1, children[of]) - ((b == 0) & (depth + 1 <= left))
    last = (depth == top[of]) & (size[b] == depth)
    ends = [""] * len(of)
    for i in np.flatnonzero(last):
        ends[i] = ",".join(map(str, conv[b[i] : b[i] + copies[b[i]]].tolist()))
    for i in np.flatnonzero(side == 0):
        ends[i] = hashlib.sha256(ends[i].encode()).hexdigest() if ends[i] else NONE
    root, whole = depth == 0, side == 0
    masked = lambda x, mask, kind: pa.array(x, kind, mask=mask)
    return pa.table(
        [
            pa.array(np.full(len(of), part), pa.int32()), pa.array(depth, pa.int32()), pa.array(least[of], pa.int64()), masked(least[up], root | (parent_side > 0), pa.int64()), pa.array(held), pa.array(kids, pa.int64()),
            pa.array(leaf[e + 1] - leaf[b], pa.int64()), pa.array(np.where(whole, saved - (held - 1) * before, saved), pa.int64()), pa.array(ends, pa.string()), pa.array(before, pa.int64()),
            masked(origin, whole, pa.int32()), masked(parent_side, root, pa.int32()), masked(parent_origin, root, pa.int32()), pa.array(side, pa.int32()),
        ],
        names=[c.split()[0] for c in FOUND.split(", ")],
    )


def _hashed(batches):
    """The digest of the ids of each (begins, depth), whose pieces come in order; only a digest's state is held."""
    now, state = None, None
    for batch in batches:
        done = []
        for begins, depth, ends in zip(*(batch.column(c).to_pylist() for c in ("begins", "depth", "ends")), strict=True):
            if (begins, depth) != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (begins, depth), hashlib.sha256()
                state.update(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield _digest_rows(done)
    yield _digest_rows([(*now, state.hexdigest())] if now is not None else [])


def _digest_rows(rows: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string()))], names=["begins", "depth", "digest"])


def prefix_trie(convs: DataFrame, blocks: int | None = None) -> DataFrame:
    """A row for each node of the trie of conversations (conv_id long, turns array<struct<d, w>>), each conv_id once.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    blocks: into which the order is dealt, at least; without it one for each 262,144 turns, or 32.
    """
    convs = cut(convs)
    if blocks is None:
        blocks = max(32, (convs.agg(F.sum(F.size("turns"))).first()[0] or 0) >> 18)
    keyed = convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["d"]), "")).alias("key"), F.transform("turns", lambda t: t["w"]).alias("words"))
    ordered = keyed.repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    marked = cut(ordered.select(F.spark_partition_id().alias("part"), "conv_id", "key", "words").mapInArrow(_mark, MARKED))
    sums = marked.groupBy("part").agg(F.min(F.when(F.col("at") > 0, F.col("lcp"))).alias("inner"), F.min_by("edge", F.when(F.col("edge").isNotNull(), F.col("at"))).alias("first"), F.max_by("edge", F.when(F.col("edge").isNotNull(), F.col("at"))).alias("last"))
    met = sums.select("part", "inner", "first", F.lag("last").over(Window.orderBy("part")).alias("before"))  # a row for each block
    lefts = met.mapInArrow(_meet, "part int, inner int, lcp int").collect()
    info = convs.sparkSession.createDataFrame(neighbours(sorted(map(tuple, lefts))), "part int, left int, right int, blocks array<int>, leasts array<int>")

    found = cut(marked.groupBy("part").cogroup(info.groupBy("part")).applyInArrow(_nodes, FOUND))
    pieces = found.filter("side > 0")
    sums = (F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.max("before").alias("before"), F.max("parent_begins").alias("parent_begins"))
    runs = cut(pieces.groupBy("begins", "depth").agg(*sums))
    told = pieces.filter("ends <> ''").select("begins", "depth", "part", "ends").repartition("begins", "depth").sortWithinPartitions("begins", "depth", "part")
    digests = told.mapInArrow(_hashed, "begins int, depth int, digest string")
    parents = runs.select(F.col("begins").alias("parent_begins"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))
    joined = runs.join(digests, ["begins", "depth"], "left").join(parents, ["parent_begins", "depth"], "left")
    saved = (F.col("saved") - (F.col("n_convs") - 1) * F.col("before")).alias("saved")
    columns = ("conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves")
    across = joined.select(*columns, saved, F.coalesce("digest", F.lit(NONE)).alias("ends"))

    # a whole node whose parent is a piece: the piece's block, side and depth name it
    inside = found.filter("side = 0 and (depth = 0 or parent_side = 0)").select(*columns, "saved", "ends")
    named = pieces.join(runs.select("begins", "depth", F.col("conv_id").alias("name")), ["begins", "depth"]).select("part", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), "name")
    below = found.filter("side = 0 and depth > 0 and parent_side > 0").join(named, ["part", "parent_side", "depth"]).withColumn("parent", F.col("name")).select(*columns, "saved", "ends")
    drop(convs, marked)
    return inside.union(below).union(across).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")
    )


def digests(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(rebuilt(gathered(turns)))


#: DuckDB SQL for ``digests`` over tables without two rows of one turn.
ORACLE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, {crc32_sql("CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id AS c FROM t)),
r AS (SELECT c, p, role, text FROM c JOIN t ON conv_id = c - c % 20 WHERE p <= h UNION ALL SELECT c, p, role, text FROM c JOIN t ON conv_id = c WHERE p > h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY p) AS d, sha256(length(role) || ':' || role || text) AS k, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM r),
x AS (SELECT c, d, w, string_agg(k, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS path FROM s UNION ALL SELECT c, 0, 0, '' FROM c),
n AS (SELECT path, d, min(c) AS conv_id, count(*) AS n, any_value(w) AS w, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = d) AS ends
      FROM x JOIN (SELECT c, max(d) AS size FROM x GROUP BY c) USING (c) GROUP BY path, d),
kid AS (SELECT left(path, 64 * (d - 1)) AS path, count(*) AS k FROM n WHERE d > 0 GROUP BY 1),
sub AS (SELECT left(n.path, 64 * e) AS path, sum((n - 1) * w) AS saved, count(*) FILTER (k IS NULL) AS leaves
        FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM n) n LEFT JOIN kid ON kid.path = n.path GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n LEFT JOIN kid USING (path) JOIN sub USING (path) LEFT JOIN n AS up ON n.d > 0 AND up.path = left(n.path, 64 * (n.d - 1))
"""
