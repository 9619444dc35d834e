"""Byte-level BPE encoding and decoding by overlapping chunks.

A document of one chunk is encoded where it lies. A longer one is cut into
chunks that overlap; the chunks are pre-tokenised in parallel, each from its own
arbitrary start, and two neighbours are stitched at a pre-token boundary which
both of them have inside their overlap. The pre-tokeniser scans from left to
right and its only state is its position, so from a common boundary on both
scans agree. Stitches follow a character that isn't white space, so that a piece
is pre-tokenised alike by itself. The text between two stitches is a piece; pieces
are encoded in parallel and their ids put together in order. Where an overlap holds no common
boundary (one word of many thousand letters) the neighbours become one piece.

Defined cases: a null text is empty, an empty text has no ids; each input row
gives one output row, repeated rows too; null document ids are kept. Other
columns of the input are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import small_batches

IDS = "doc_id {id_type}, n_tokens long, ids array<int>"


class Codec:
    """Ranks and pre-token pattern of one vocabulary; small enough to send to every task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self._made = None

    @classmethod
    def from_file(cls, path: str, pattern: str) -> "Codec":
        """``path``: lines of a base64 token, a space and its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}, pattern)

    def __getstate__(self):
        return self.ranks, self.pattern

    def __setstate__(self, state):
        self.__init__(*state)

    def _tools(self):
        if self._made is None:
            import tiktoken

            encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
            # the property both engines agree on; \s alone means other characters in each
            same = self.pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
            self._made = encoding, regex.compile(same)
        return self._made

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        encoding, cutter = self._tools()
        try:
            return encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int32)
        except BaseException as stopped:  # its regex engine gives up on some very long runs
            if isinstance(stopped, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            ids: list[int] = []
            for match in cutter.finditer(text):
                ids += encoding._encode_single_piece(match.group().encode())
            return np.asarray(ids, np.int32)

    def decode(self, ids) -> bytes:
        """The bytes the ids stand for, one after the other."""
        return self._tools()[0].decode_bytes(np.asarray(ids).tolist())

    def boundaries(self, text: str, whole: bool) -> np.ndarray:
        """Ends of the pre-tokens of a chunk; the last is unsure unless the text ends there."""
        ends = np.fromiter((m.end() for m in self._tools()[1].finditer(text)), np.int64)
        return ends if whole else ends[ends < len(text)]


def _free(text: str, at: int) -> bool:
    """A letter before and white space after: a boundary wherever the scan began."""
    return 0 < at < len(text) and text[at - 1].isalpha() and text[at] in " \n\t\r"


def _edges(codec: Codec, step: int, overlap: int):
    """For each chunk, its boundaries in the overlap with the chunk before and the one after."""

    def run(batches):
        for batch in batches:
            heads, tails, free = [], [], []
            for text, last in zip(batch.column("chunk").to_pylist(), batch.column("last").to_pylist(), strict=True):
                ends = np.concatenate([[0], codec.boundaries(text, last)])
                heads.append(ends[ends <= overlap].tolist())
                # a piece must not end in white space: how much of it a pre-token takes depends on what follows
                tail = [e for e in ends[ends >= step].tolist() if not text[e - 1].isspace()]
                tails.append([e - step for e in tail])
                free.append([_free(text, e) for e in tail])
            yield pa.record_batch(
                [batch.column("key"), batch.column("k"), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32())), pa.array(free, pa.list_(pa.bool_()))],
                names=["key", "k", "head", "tail", "free"],
            )

    return run


def _stitch(step: int):
    """Where each chunk's piece begins: an offset in the chunk, or none if it belongs to the piece before."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        ks, heads, tails, free = (rows.column(c).to_pylist() for c in ("k", "head", "tail", "free"))
        cuts, sure = [0], True
        for i in range(1, len(ks)):
            here = set(heads[i])
            # a boundary of a scan that was itself never stitched counts only if it needs no scan
            at = next((t for t, f in zip(tails[i - 1], free[i - 1], strict=True) if t in here and (sure or f)), None)
            cuts.append(at)
            sure = at is not None
        piece, pieces, nexts = 0, [], [*cuts[1:], None]
        for i, cut in enumerate(cuts):
            piece = ks[i] if cut is not None else piece
            pieces.append(piece)
        return pa.table(
            [rows.column("key"), rows.column("k"), pa.array(pieces, pa.int32()), pa.array([c or 0 for c in cuts], pa.int32()), pa.array(nexts, pa.int32())],
            names=["key", "k", "piece", "start", "next_start"],
        )

    return run


def chunked(step: int, overlap: int):
    """Rows (key, k, chunk, last) of the overlapping chunks of each text."""

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                last = max(0, -(-(len(text) - overlap) // step) - 1)
                ks = list(range(last + 1))
                for i in range(0, len(ks), 64):
                    part = ks[i : i + 64]
                    yield pa.record_batch(
                        [pa.array([key] * len(part), pa.string()), pa.array(part, pa.int32()), pa.array([text[k * step : k * step + step + overlap] if k < last else text[k * step :] for k in part], pa.string()), pa.array([k == last for k in part])],
                        names=["key", "k", "chunk", "last"],
                    )

    return run


def encode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text", step: int = 32768, overlap: int = 1024, decoded: bool = False) -> DataFrame:
    """Columns doc_id, n_tokens and ids: a row for each row of ``docs``.

    step, overlap: characters of a chunk and how many more it shares with the next.
    decoded: add what the ids decode to, made piece by piece in the same pass.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = IDS.format(id_type=docs.schema["doc_id"].dataType.simpleString()) + ", decoded binary" * decoded
    sent = docs.sparkSession.sparkContext.broadcast(codec)  # a vocabulary: its size doesn't depend on the rows
    length = F.coalesce(F.length("text"), F.lit(0))

    def columns(ids: list[np.ndarray]) -> list[pa.Array]:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)))
        return [listed, *([pa.array([sent.value.decode(x) for x in ids], pa.binary())] if decoded else [])]

    names = ["ids", *(["decoded"] if decoded else [])]

    def whole(batches):
        for batch in batches:
            ids = [sent.value.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), *columns(ids)], names=["doc_id", "n_tokens", *names])

    short = docs.filter(length <= step + overlap).mapInArrow(whole, schema)

    # equal rows are encoded once; the key of a text is its digest
    long = docs.filter(length > step + overlap).withColumn("key", F.sha2("text", 256))
    owners = long.groupBy("key", "doc_id").count()
    chunks = long.dropDuplicates(["key"]).select("key", "text").mapInArrow(chunked(step, overlap), "key string, k int, chunk string, last boolean").repartition("key", "k")
    cuts = (
        chunks.mapInArrow(lambda batches: _edges(sent.value, step, overlap)(batches), "key string, k int, head array<int>, tail array<int>, free array<boolean>")
        .groupBy("key")
        .applyInArrow(_stitch(step), "key string, k int, piece int, start int, next_start int")
    )
    # chunk k gives its text from where its piece starts up to where the next chunk takes over
    upto = F.when(F.col("last"), F.length("chunk")).otherwise(F.lit(step) + F.coalesce("next_start", F.lit(0)))
    text = F.expr("substring(chunk, start + 1, greatest(upto - start, 0))")
    parts = chunks.join(cuts, ["key", "k"]).withColumn("upto", upto).select("key", "piece", "k", text.alias("part"))

    def pieces(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        ids = sent.value.encode("".join(rows.column("part").to_pylist()))
        return pa.table([rows.column("key")[:1], rows.column("piece")[:1], *columns([ids])], names=["key", "piece", *names])

    def together(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("piece").combine_chunks()
        ids = rows.column("ids").chunk(0).flatten()
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        joined = [pa.array([b"".join(rows.column("decoded").to_pylist())], pa.binary())] if decoded else []
        return pa.table([rows.column("key")[:1], listed, *joined], names=["key", *names])

    kept = "key string, {}ids array<int>" + ", decoded binary" * decoded
    encoded = parts.groupBy("key", "piece").applyInArrow(pieces, kept.format("piece int, "))
    texts = encoded.groupBy("key").applyInArrow(together, kept.format(""))
    done = owners.join(texts, "key").select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *names, F.explode(F.expr("sequence(1L, count)")).alias("copy"))
    return short.unionByName(done.drop("copy"))


def decode(encoded: DataFrame, codec: Codec, ids_col: str = "ids") -> DataFrame:
    """The rows with a column ``decoded``: the bytes of the ids (none: no bytes)."""
    small_batches(encoded.sparkSession)
    sent = encoded.sparkSession.sparkContext.broadcast(codec)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"

    def run(batches):
        for batch in batches:
            column = batch.column(ids_col)
            texts = [sent.value.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in column]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    both = encode(docs, codec, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
