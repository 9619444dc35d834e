"""Removal of word passages that occur more than once, found by difference-cover anchors.

A difference cover D modulo v holds, for every d, two members that differ by d.
So for any two places p and q there is a shift k < v with both p + k and q + k
in D modulo v, and two equal passages of ``width`` words share an aligned
anchor: a window of ``width - v + 1`` words that starts at a cover position of
each document. Only windows at cover positions are hashed and dealt out; where
an anchor turns out to occur twice, the full windows around it (the extension to
either side) are hashed and dealt out in turn, and those that occur twice cover
the words to remove.

Documents are dealt once into blocks of a few MB by a hash of the row. A block
sends each of its hashes once, with a mark if it has it several times, so that a
passage that a third of all documents share costs each block one entry; what
gathers the hashes answers each block with those of its hashes that occur twice.
Neither step ever puts the documents of a passage together, and no block, bucket
or passage has a cap. Anchors, and a first hash of 64 bits, only nominate windows; these
count as equal if a digest of their words themselves is, under a key that each run
draws anew, so that no text can be made to collide.

Defined cases: null and empty texts have no words; documents shorter than a
window keep all words; repeated rows are separate documents and so remove each
other's passages; null ids are kept as they are; an empty table gives an empty
table; a text of any length is one row of its block; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm import words as W
from factorloom.llm.common import pmod, slices, small_batches, text_bytes

SENT = "bucket int, block int, ones binary, many binary"
REPLY = "block int, hashes binary"


def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences are all residues modulo ``period``."""
    for size in range(1, period + 1):
        for rest in itertools.combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    return tuple(range(period))


class _Documents:
    """The words of one run of rows."""

    def __init__(self, text: pa.Array):
        self.data, self.offsets = text_bytes(text)
        self.starts, self.ends, self.first = W.split(self.data, self.offsets)
        self.hash = W.word_hashes(self.data, self.starts, self.ends)
        counts = np.diff(self.first)
        self.at = np.arange(len(self.hash)) - np.repeat(self.first[:-1], counts)  # place in the document
        self.left = np.repeat(self.first[1:], counts) - np.arange(len(self.hash))  # words from here to its end

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a window fits into its document, and their hashes as one column."""
        found = W.window_hashes(self.hash, width)[:, None]
        places = np.flatnonzero(self.left[: len(found)] >= width)
        return places, found[places]

    def told(self, places: np.ndarray, hashes: np.ndarray, width: int, key: bytes) -> np.ndarray:
        """The hashes and beside them a keyed digest of each window's words, joined by one space."""
        lengths = self.ends - self.starts
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        joined, inside = np.full(int(begin[-1]), 0x20, np.uint8), np.ones(int(begin[-1]), bool)
        inside[begin[1:] - 1] = False
        joined[inside] = self.data[~W.SPACE[self.data]]
        text = memoryview(joined.tobytes())
        ranges = zip(begin[places].tolist(), (begin[places + width] - 1).tolist(), strict=True)
        digests = b"".join(hashlib.blake2b(text[a:b], digest_size=8, key=key).digest() for a, b in ranges)
        return np.concatenate([hashes, np.frombuffer(digests, np.uint64)[:, None]], axis=1)


def _runs(rows: pa.Table, most: int = 1 << 21):
    """The block's rows in runs of about ``most`` bytes."""
    rows = rows.combine_chunks()
    if rows.num_rows:
        text = rows.column("text").chunk(0)
        for i, j in slices(text_bytes(text)[1], most):
            yield rows.slice(i, j - i), _Documents(text.slice(i, j - i))


def _joined(keys: list[np.ndarray], columns: int) -> np.ndarray:
    return np.concatenate([*keys, np.zeros((0, columns), np.uint64)])


def _read(column: pa.ChunkedArray, columns: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64).reshape(-1, columns) for x in column]


def _order(key: np.ndarray, *first: np.ndarray) -> np.ndarray:
    """Sorts rows of hashes, by other columns before."""
    return np.lexsort([*key.T[::-1], *reversed(first)])


def _begins(key: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows begin."""
    return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else np.zeros(0, np.int64)


def _ends(begin: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where the runs that begin at ``begin`` end."""
    return np.append(begin, len(key))[1:] if len(begin) else begin


def _send(block: int, keys: list[np.ndarray], buckets: int, columns: int) -> pa.Table:
    """Each hash of a block once, by bucket, apart as it occurs here once or more often."""
    key = _joined(keys, columns)
    bucket = ((W.mix(key[:, 0]) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = _order(key, bucket)
    key, bucket = key[order], bucket[order]
    begin = _begins(key)
    count = _ends(begin, key) - begin
    key, bucket = key[begin], bucket[begin]
    ids, begin = np.unique(bucket, return_index=True)
    parts = [(key[i:j], count[i:j]) for i, j in zip(begin, _ends(begin, key), strict=True)]
    return pa.table(
        [pa.array(ids, pa.int32()), pa.array([block] * len(ids), pa.int32()), pa.array([k[c == 1].tobytes() for k, c in parts], pa.binary()), pa.array([k[c > 1].tobytes() for k, c in parts], pa.binary())],
        names=["bucket", "block", "ones", "many"],
    )


def _gather(columns: int):
    """Tells each block which of the hashes it sent to this bucket occur twice at least."""

    def run(rows: pa.Table) -> pa.Table:
        blocks = rows.column("block").to_numpy()
        ones, many = _read(rows.column("ones"), columns), _read(rows.column("many"), columns)
        key = _joined([*ones, *many], columns)
        sizes = [len(x) for x in (*ones, *many)]
        weight = np.repeat([1] * len(ones) + [2] * len(many), sizes)
        owner = np.repeat([*range(len(ones)), *range(len(many))], sizes)
        order = _order(key)
        key, weight, owner = key[order], weight[order], owner[order]
        begin = _begins(key)
        total = np.add.reduceat(weight, begin) if len(key) else weight
        twice = np.repeat(total > 1, _ends(begin, key) - begin)
        key, owner = key[twice], owner[twice]
        order = np.argsort(owner, kind="stable")
        key, owner = key[order], owner[order]
        ids, begin = np.unique(owner, return_index=True)
        return pa.table(
            [pa.array(blocks[ids], pa.int32()), pa.array([key[i:j].tobytes() for i, j in zip(begin, _ends(begin, key), strict=True)], pa.binary())],
            names=["block", "hashes"],
        )

    return run


def _answers(replies: pa.Table, columns: int) -> np.ndarray:
    key = _joined(_read(replies.column("hashes"), columns), columns)
    key = key[_order(key)]
    return key[_begins(key)]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which rows of hashes are among the known ones (sorted, each once)."""
    found = np.zeros(len(values), bool)
    if len(known):
        first = np.ascontiguousarray(known[:, 0])
        at = np.searchsorted(first, values[:, 0])
        alike = np.diff(np.append(np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])), len(first))).max()
        for step in range(int(alike)):  # those with one first hash lie together
            here = np.minimum(at + step, len(known) - 1)
            found |= (known[here] == values).all(axis=1)
    return found


def _spread(places: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Marks places - before .. places + after of n."""
    total = np.zeros(n + 1, np.int64)
    np.add.at(total, np.maximum(places - before, 0), 1)
    np.add.at(total, np.minimum(places + after + 1, n), -1)
    return np.cumsum(total[:-1]) > 0


def _dealing(bytes_in: int, block_bytes: int | None) -> tuple[int, int]:
    """Blocks of documents and buckets of hashes for so many bytes of text.

    Blocks grow with the root of the input from 4 to 64 MB, and a bucket takes the hashes of eight blocks' text, so that
    what a block sends to a bucket stays a run of hashes rather than single ones.
    """
    block_bytes = block_bytes or int(min(max(4 << 20, (bytes_in * (1 << 15)) ** 0.5), 64 << 20))
    blocks = max(64, -(-bytes_in // block_bytes))
    return blocks, max(64, -(-blocks // 8))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, period: int = 21, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by a space) for each row.

    width: words of a window, up to 512; period: of the difference cover (anchors have width - period + 1 words);
    block_bytes: text of a block of documents, about (4 to 64 MB by the size of the input, if not given).
    """
    small_batches(docs.sparkSession)
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True
    anchor = width - period + 1
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n, buckets = _dealing(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, block_bytes)
    dealt = docs.withColumn("block", pmod(F.xxhash64("doc_id", "text"), n).cast("int"))
    schema = dealt.schema["doc_id"].dataType.simpleString()
    key = os.urandom(16)

    def anchors(found: _Documents):
        places, hashes = found.windows(anchor)
        # only documents that have a window at all
        at = cover[found.at[places] % period] & (found.at[places] + found.left[places] >= width)
        return places[at], hashes[at]

    def send_anchors(rows: pa.Table) -> pa.Table:
        return _send(rows.column("block")[0].as_py(), [anchors(found)[1] for _, found in _runs(rows)], buckets, 1)

    def send_windows(rows: pa.Table, replies: pa.Table) -> pa.Table:
        known, keys = _answers(replies, 1), []
        for _, found in _runs(rows):
            places, hashes = anchors(found)
            near = _spread(places[_among(hashes, known)], period - 1, 0, len(found.hash))
            places, hashes = found.windows(width)
            near = near[places]
            keys.append(found.told(places[near], hashes[near], width, key))
        block = (rows if rows.num_rows else replies).column("block")[0].as_py()
        return _send(block, keys, buckets, 2)

    def keep(rows: pa.Table, replies: pa.Table) -> pa.Table:
        known, out = _answers(replies, 2), []
        first = known[_begins(known[:, :1])][:, :1]
        for part, found in _runs(rows):
            places, hashes = found.windows(width)
            maybe = _among(hashes, first)
            places, hashes = places[maybe], found.told(places[maybe], hashes[maybe], width, key)
            gone = _spread(places[_among(hashes, known)], 0, width - 1, len(found.hash))
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[found.first[1:]] - total[found.first[:-1]]
            texts = []
            for i in range(part.num_rows):
                here = found.data[found.offsets[i] : found.offsets[i + 1]].tobytes().split()
                if removed[i]:
                    here = itertools.compress(here, ~gone[found.first[i] : found.first[i + 1]])
                texts.append(b" ".join(here))
            out.append(pa.table([part.column("doc_id"), pa.array(np.diff(found.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], rows.schema.field("doc_id").type), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    blocks = dealt.groupBy("block")
    repeated = blocks.applyInArrow(send_anchors, SENT).groupBy("bucket").applyInArrow(_gather(1), REPLY)
    repeated = blocks.cogroup(repeated.groupBy("block")).applyInArrow(send_windows, SENT).groupBy("bucket").applyInArrow(_gather(2), REPLY)
    return blocks.cogroup(repeated.groupBy("block")).applyInArrow(keep, f"doc_id {schema}, n_words long, n_removed long, kept string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB SQL for ``digests``: every window of every document, by digest of its words.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT rid, p, md5(array_to_string(w[p:p + 34], ' ')) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + 35)) AS p FROM win JOIN twice USING (k)),
placed AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM placed ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
