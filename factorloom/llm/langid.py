"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ``order`` bytes with the
counts of the byte that followed. A byte seen c times after a context with T
continuations of q kinds costs log2((T + q) / c) bits; an unseen one costs the
escape, log2((T + q) / q), and goes on in the context shorter by its oldest
byte, down to 8 bits for a byte no context knows. The statistics are frozen
after training, so the cost of a byte depends only on the few bytes before it:
the costs of all languages lie in one hash table per order, and a text is scored
by table look-ups. A text's language is the one that codes it shortest.

Training takes a documented, bounded sample: about ``per_lang`` documents of each
language, ``most`` in all, chosen by a hash of id and text, each whole; repeated rows
count once.
Scoring reads every byte of every text.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
equal code lengths go to the first language by code point; without a training
row everything is ``und``; a null id counts as held out; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import cut, drop, small_batches, text_bytes

UNKNOWN = "und"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _Table:
    """Open-addressing hash from 64-bit keys to rows of a cost matrix."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask, self.costs = np.uint64(64 - bits), (1 << bits) - 1, costs
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.rows[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            won = todo[free][first]
            self.rows[at], self.keys[at] = won, keys[won]
            left = self.rows[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        slot = self._slot(keys)
        rows = self.rows[slot]
        todo = np.flatnonzero((rows >= 0) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            rows[todo] = self.rows[slot[todo]]
            todo = todo[(rows[todo] >= 0) & (self.keys[slot[todo]] != keys[todo])]
        return rows


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes up to each position, the newest lowest; positions before n - 1 are left out."""
    out = np.zeros(max(0, len(data) - n + 1), np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | data[k : k + len(out)].astype(np.uint64)
    return out


class Model:
    """Frozen context statistics of all languages."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = 4):
        self.langs, self.order = sorted(samples), order
        self.symbols: list[_Table] = []  # by gram length from 1: cost of its last byte after the others
        self.escapes: list[_Table] = []  # by gram length from 1: cost of leaving that context
        shorter, n_langs = None, len(self.langs)
        for n in range(1, order + 2):
            counts = []
            for lang in self.langs:
                grams = np.concatenate([np.zeros(0, np.uint64), *(_grams(np.frombuffer(t, np.uint8), n) for t in samples[lang])])
                counts.append(np.unique(grams, return_counts=True))
            keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in counts)]))
            contexts = np.unique(keys >> np.uint64(8))
            costs, leave = np.zeros((len(keys), n_langs)), np.zeros((len(contexts), n_langs))
            low = np.uint64((1 << 8 * (n - 1)) - 1)
            for i, (grams, seen) in enumerate(counts):
                inside = np.searchsorted(contexts, grams >> np.uint64(8))
                total = np.bincount(inside, seen, len(contexts))
                kinds = np.bincount(inside, minlength=len(contexts))
                known = kinds > 0
                leave[known, i] = np.log2((total[known] + kinds[known]) / kinds[known])
                # what this language hasn't seen here costs the escape and then the shorter context
                backed = shorter.costs[shorter.find(keys & low), i] if shorter else 8.0
                costs[:, i] = leave[np.searchsorted(contexts, keys >> np.uint64(8)), i] + backed
                costs[np.searchsorted(keys, grams), i] = np.log2((total + kinds)[inside] / seen)
            shorter = _Table(keys, costs)
            self.symbols.append(shorter)
            self.escapes.append(_Table(contexts, leave))

    def costs(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Bits of each byte in each language; ``begin``: place of each byte in its document."""
        n, out = len(data), np.zeros((len(data), len(self.langs)))
        grams = np.zeros(n, np.uint64)
        for k in range(min(self.order, n - 1), -1, -1):
            grams[k:] = (grams[k:] << np.uint64(8)) | data[: n - k].astype(np.uint64)
            grams[:k] <<= np.uint64(8)
        todo, key = np.arange(n), grams
        for m in range(self.order + 1, 0, -1):
            fits = begin[todo] >= m - 1  # the document has bytes enough before it
            rows = np.full(len(todo), -1, np.int32)
            rows[fits] = self.symbols[m - 1].find(key[fits])
            hit = rows >= 0
            out[todo[hit]] += self.symbols[m - 1].costs[rows[hit]]
            todo, key, fits = todo[~hit], key[~hit], fits[~hit]
            left = self.escapes[m - 1].find(key[fits] >> np.uint64(8))
            known = left >= 0
            out[todo[fits][known]] += self.escapes[m - 1].costs[left[known]]
            key = key & np.uint64((1 << 8 * (m - 1)) - 1)
        out[todo] += 8
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray, most: int = 1 << 18) -> np.ndarray:
        """Bits of each document in each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for i in range(0, len(data), most):
            j, back = min(i + most, len(data)), max(0, i - self.order)
            owner = np.searchsorted(offsets, np.arange(back, j), side="right") - 1
            bits = self.costs(data[back:j], np.arange(back, j) - offsets[owner])[i - back :]
            owner = owner[i - back :]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[owner[first]] += np.add.reduceat(bits, first, axis=0)
        return out


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", order: int = 4, per_lang: int = 150, most: int = 6000) -> Model:
    """A model of all languages that occur, from about ``per_lang`` different rows of each (all, if fewer), whole.

    most: rows in all; with many languages each has as many fewer (but one).
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    counts = cut(rows.groupBy("lang").agg(F.countDistinct("h").alias("n")))
    n_langs = counts.count()
    if not n_langs:
        return Model({}, order)
    # a row is taken if its hash falls into the share of its language; rows of one hash are taken once
    space, each = 1 << 30, max(1, min(per_lang, most // n_langs))
    shares = counts.select("lang", F.ceil(F.lit(space * each) / F.col("n")).alias("share"))
    taken = rows.join(shares, "lang").filter(F.pmod("h", F.lit(space)) < F.col("share")).dropDuplicates(["lang", "h"]).select("lang", "text")
    samples: dict[str, list[bytes]] = {}
    for r in taken.collect():
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    drop(counts)
    for lang in samples:
        samples[lang].sort()
    return Model(samples, order)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = (), names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """Columns ``keep``, lang_pred, score (the posterior of that language if all are equally likely) and bits_per_byte.

    names: of the three; a kept column of one of these names gives way.
    """
    keep = tuple(c for c in keep if c not in names)
    small_batches(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).cast("string").alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "__text") + f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` double"

    def run(batches):
        model = sent.value
        langs = np.array([*model.langs, UNKNOWN], dtype=object)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            data, offsets = text_bytes(text)
            size = np.diff(offsets)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            pred = np.full(len(size), len(model.langs))
            score, rate = np.zeros(len(size)), np.full(len(size), np.nan)
            if model.langs:
                bits = model.code_lengths(data, offsets)
                best = bits.min(axis=1)
                pred[letters] = bits.argmin(axis=1)[letters]
                with np.errstate(under="ignore"):
                    score[letters] = (1 / np.exp2(np.maximum(best[:, None] - bits, -1000)).sum(axis=1))[letters]
                rate[letters] = best[letters] / size[letters]
            yield pa.record_batch([*batch.columns[:-1], pa.array(langs[pred].tolist(), pa.string()), pa.array(score), pa.array(rate, mask=~letters | (not model.langs))], names=[*batch.schema.names[:-1], *names])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is kept from training: crc32 of its id as text is divisible by ``folds`` (null id: yes)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score, learned from the rows that aren't held out."""
    model = train(docs.filter(~held_out()))
    return predict(docs, model, keep=("doc_id",)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
