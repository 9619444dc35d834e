"""Near duplicates by order MinHash, verified by banded alignment.

A text's k-mers are its runs of five words, each labelled with how often it came
before. One sketch entry takes the few labelled k-mers with the smallest hashes
and keeps them in text order, so two texts agree on an entry if they share those
k-mers in the same order: what edit similarity asks for and a set of shingles
doesn't see. One changed word of a short text touches nearly all of its k-mers, so
texts of up to 14 words also get an entry for each way to leave out as many words
as a link may change: any two of them that are a link share one. Texts that agree
on an entry are candidates; a pair is a link if the
edit distance of their words is at most ``1 - least`` of the longer one, found by
a furthest-reaching alignment inside that band of diagonals.

Equal texts are one node. In each bucket (texts with one sketch entry) every text
is first compared with the bucket's smallest; links join texts into components.
Buckets that still hold several components have their remaining pairs, those across
components, compared block by block inside tasks, until what is similar is joined;
texts are sent there only if the counts of their words, in 256 bins, leave a link possible.
So no link that a bucket offers is left out of the classes, a class of thousands
costs a comparison a member, and pairs are never listed. A text that many others are
compared with is sent to several tasks.

Words are lower-cased (A-Z). Defined cases: null texts and texts without a word
are alone in their class; texts of fewer than five words are one k-mer; repeated
rows and equal texts share a class, named by its smallest id (null ids name no
class); other columns are ignored. Equal texts are told by 96 bits of two hashes.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm import words as W
from factorloom.llm.common import cut, drop, pmod, release, slices, small_batches, text_bytes
from factorloom.llm.components import components

_RANDOM = np.random.Generator(np.random.PCG64(8)).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labelled(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k-mer and of how many equal ones stand before it."""
    kmers = W.window_hashes(words, min(k, len(words)))
    order = np.argsort(kmers, kind="stable")
    same = kmers[order]
    new = np.concatenate([[True], same[1:] != same[:-1]])
    begin = np.flatnonzero(new)
    nth = np.empty(len(kmers), np.uint64)
    nth[order] = np.arange(len(kmers)) - np.repeat(begin, np.diff(np.append(begin, len(kmers))))
    return W.mix(kmers + nth * np.uint64(0x9E3779B97F4A7C15))


def sketch(words: np.ndarray, k: int = 5, take: int = 2, entries: int = 64) -> np.ndarray:
    """A 64-bit value for each entry: the ``take`` smallest labelled k-mers in text order."""
    marks = labelled(words, k)
    take, n = min(take, len(marks)), len(marks)
    out = np.empty(entries, np.uint64)
    rows = max(1, (1 << 21) // n)
    for i in range(0, entries, rows):
        some = _RANDOM[i : min(i + rows, entries)]
        hashes = marks[None, :] * some[:, None]
        least = np.sort(np.argpartition(hashes, take - 1, axis=1)[:, :take], axis=1) if n > take else np.tile(np.arange(n), (len(some), 1))
        value = np.arange(i, i + len(some), dtype=np.uint64)
        for j in range(take):
            value = W.mix(value * np.uint64(0xD6E8FEB86659FD93) + marks[least[:, j]])
        out[i : i + len(some)] = value
    return out


_SHORT, _LEFT_OUT = 14, 2  # words of a text that is blocked exactly, and the most that are left out of it


@cache
def _kept(n: int, gone: int) -> np.ndarray:
    """Each way to leave ``gone`` of n words out: the places of the others."""
    return np.array(list(combinations(range(n), n - gone)), np.int64).reshape(-1, n - gone)


def remainders(words: np.ndarray, least: float = 0.8) -> np.ndarray:
    """A 64-bit value for each text left of a short one when as many words as a link may change, or fewer, are left out.

    Texts of n >= m words that are within e edits have n - e words in common in the same order: n loses e of its words, m
    loses e - (n - m), and neither is more than a link may change in a text of that length. So a link of two short texts
    always has a value in common.
    """
    n = len(words)
    if n > _SHORT:
        return np.zeros(0, np.uint64)
    out = []
    for gone in range(min(_LEFT_OUT, int((1 - least) * n + 1e-9), n - 1) + 1):
        places = _kept(n, gone)
        value = np.full(len(places), (1 << 32) + n - gone, np.uint64)
        for j in range(n - gone):
            value = W.mix(value * np.uint64(0xD6E8FEB86659FD93) + words[places[:, j]])
        out.append(value)
    return np.unique(np.concatenate(out))


def aligned(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether at most ``most`` words must be changed, added or taken out to make a into b."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) <= most
    # reach[d + zero]: how far the words of a are used up on diagonal d; it never goes back, so no word is met twice
    zero, never = most + 1, -(1 << 40)
    diagonals = np.arange(-zero, zero + 1)
    limits = np.minimum(n, m - diagonals)
    reach = np.full(2 * most + 3, never)

    def slide(at: np.ndarray, d: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Down each diagonal while the words agree: a few steps together, then each diagonal in growing runs."""
        go = np.flatnonzero((at >= 0) & (at + d >= 0) & (at < limit))
        for _ in range(4):
            go = go[a[at[go]] == b[at[go] + d[go]]]
            if not len(go):
                return at
            at[go] += 1
            go = go[at[go] < limit[go]]
        for i in go:
            x, k, end, run = int(at[i]), int(d[i]), int(limit[i]), 16
            while x < end:
                upto = min(x + run, end)
                differ = a[x:upto] != b[x + k : upto + k]
                first = int(differ.argmax())
                if differ[first]:
                    x += first
                    break
                x, run = upto, min(run * 4, 1 << 14)
            at[i] = x
        return at

    goal = m - n
    reach[zero] = 0
    reach[zero : zero + 1] = slide(reach[zero : zero + 1].copy(), diagonals[zero : zero + 1], limits[zero : zero + 1])
    for edits in range(most + 1):
        if edits:
            # diagonals from which the goal is still within the band
            low, high = max(-edits, goal - (most - edits), -n) + zero, min(edits, goal + (most - edits), m) + zero + 1
            here = np.maximum(np.maximum(reach[low:high], reach[low + 1 : high + 1]) + 1, reach[low - 1 : high - 1])
            here = np.minimum(here, limits[low:high])
            new = np.full(2 * most + 3, never)
            new[low:high] = slide(here, diagonals[low:high], limits[low:high])
            reach = new
        if reach[goal + zero] >= n:
            return True
    return False


class _Text:
    """A text's words for comparison, and their counts."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.kinds, self.counts = np.unique(words, return_counts=True)

    def similar(self, other: "_Text", least: float) -> bool:
        longer = max(len(self.words), len(other.words))
        most = int((1 - least) * longer + 1e-9)
        if abs(len(self.words) - len(other.words)) > most:
            return False
        # each edit takes away at most one word of the longer text's that the other has too
        _, i, j = np.intersect1d(self.kinds, other.kinds, assume_unique=True, return_indices=True)
        if longer - int(np.minimum(self.counts[i], other.counts[j]).sum()) > most:
            return False
        return aligned(self.words, other.words, most)


def _texts(column: pa.Array):
    data, offsets = text_bytes(column)
    data = W.LOWER[data]
    starts, ends, first = W.split(data, offsets)
    hashes = W.word_hashes(data, starts, ends)
    return [hashes[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]


def _packed(column: pa.Array) -> pa.Array:
    """Texts as they are written and sent: their length in 8 bytes, then what zstd makes of them."""
    codec = pa.Codec("zstd", 1)
    data = (None if x is None else x.encode() for x in column.to_pylist())
    return pa.array([None if x is None else len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in data], pa.binary())


def _unpacked(column: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd", 1)
    return pa.array([codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) if x is not None else None for x in column.to_pylist()], pa.string())


BINS = 256


def bag(words: np.ndarray) -> bytes:
    """How many words fall into each bin, 255 at most."""
    return np.minimum(np.bincount((W.mix(words) % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def may_link(n: int, bins: np.ndarray, others_n: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Whether a text of n words may be similar to each of the others, by what an edit can change of lengths and bags.

    A word replaced changes two bins by one, a word added or taken out one bin and the length.
    """
    most = ((1 - least) * np.maximum(others_n, n) + 1e-9).astype(np.int64)
    return np.abs(others_n - n) + np.abs(others.astype(np.int16) - bins.astype(np.int16)).sum(axis=1, dtype=np.int64) <= 2 * most


def verify(pairs: DataFrame, texts: DataFrame, least: float, words: int = 1 << 18) -> DataFrame:
    """Those of the pairs (a, b) whose texts (key, n, packed) are similar; many pairs may share b.

    Pairs are dealt out by b, the pairs of a b that has many by a as well, into groups of about ``words`` words.
    """
    each = pairs.groupBy("b").agg(F.count("*").alias("__c")).filter("__c > 64")
    hot = cut(each)  # written, so that the join below deals the pairs anew and can split those of a hot b
    salt = F.coalesce(F.pmod(F.xxhash64("a"), F.ceil(F.col("__c") / 64)), F.lit(0).cast("long"))
    salted = pairs.join(hot, "b", "left").select("a", "b", salt.alias("salt"))
    # a pair's words are at most twice those of its longer text, which is at most a quarter longer than the other
    total = pairs.join(texts.select(F.col("key").alias("a"), "n"), "a").agg(F.count("*"), F.sum("n")).first()
    groups = max(64, (total[0] or 0) // 256, 2 * (total[1] or 0) // words)
    dealt = salted.select("a", "b", pmod(F.xxhash64("b", "salt"), groups).cast("int").alias("g"))
    needed = dealt.select("g", F.explode(F.array("a", "b")).alias("key")).distinct()
    there = needed.join(texts.select("key", "packed"), "key").select(F.col("g").alias("at"), "key", "packed")

    def compare(some: pa.Table, texts: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        known = dict(zip(texts.column("key").to_pylist(), map(_Text, _texts(_unpacked(texts.column("packed"))) if texts.num_rows else []), strict=True))
        a, b = some.column("a").to_pylist(), some.column("b").to_pylist()
        good = [x in known and y in known and known[x].similar(known[y], least) for x, y in zip(a, b, strict=True)]
        return some.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return cut(dealt.groupBy("g").cogroup(there.groupBy("at")).applyInArrow(compare, "a long, b long"), hot)


def _facing(cast: DataFrame, load: Column, carried: tuple[str, ...], compare, schema: str, texts: DataFrame | None = None) -> DataFrame:
    """compare(members, guests) for each pair of blocks of a host, of load 1 about, whatever the host's size is.

    Rows have what is carried beside task, host, key, owner, guest and entries; it may come from ``texts``, by key.
    """
    tally = cut(cast.groupBy("host").agg(F.ceil(F.sum(F.when(F.col("guest"), load).otherwise(0.0))).alias("gs"), F.ceil(F.sum(load)).alias("ms")))
    full = cast.join(tally, "host")
    full = full if texts is None else full.join(texts, "key")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    columns = ("host", "key", "owner", "guest", "entries", *carried)
    members = full.select(*(F.col(c).alias(c) for c in columns), mine("ms").alias("m"), each("gs").alias("g"))
    guests = full.filter("guest").select(*(F.col(c).alias(c) for c in columns), mine("gs").alias("g"), each("ms").alias("m"))
    task = F.xxhash64("host", "g", "m")
    groups = max(64, int(tally.agg(F.sum(F.col("gs") * F.col("ms"))).first()[0] or 0) // 2)
    members, guests = (x.withColumn("task", task).withColumn("at", pmod(F.col("task"), groups).cast("int")).drop("g", "m") for x in (members, guests))
    return cut(members.groupBy("at").cogroup(guests.groupBy("at")).applyInArrow(compare, schema), tally)


def _tasks(lying: pa.Table, asking: pa.Table, *carried: str):
    """Members and guests of each task: host, key, owner, guest, entries and what is carried; and the members that have an entry."""
    sides = []
    for rows in (lying, asking):
        rows = rows.combine_chunks().sort_by("task")
        plain = [rows.column(c).to_numpy(zero_copy_only=False) for c in ("task", "host", "key", "owner", "guest")]
        sides.append((*plain, *(rows.column(c) for c in ("entries", *carried))))
    for t in np.intersect1d(sides[0][0], sides[1][0]):
        ends = [(int(np.searchsorted(x[0], t)), int(np.searchsorted(x[0], t, side="right"))) for x in sides]
        members, guests = ([c[i:j] if isinstance(c, np.ndarray) else c.slice(i, j - i) for c in x[1:]] for x, (i, j) in zip(sides, ends, strict=True))
        having: dict[int, list[int]] = {}
        for j, some in enumerate(members[4].to_pylist()):
            for entry in some:
                having.setdefault(entry, []).append(j)
        yield members, guests, having


def _meeting(sized: DataFrame, least: float, block: int = 1024) -> DataFrame:
    """(host, key) of the rows, with n and bag, that may have a link to another component's in their host."""

    def compare(lying: pa.Table, asking: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for members, guests, having in _tasks(lying, asking, "n", "bag"):
            (m_n, m_bag), (g_n, g_bag) = ((x[5].to_numpy().astype(np.int64), np.frombuffer(b"".join(x[6].to_pylist()), np.uint8).reshape(-1, BINS)) for x in (members, guests))
            m_met, g_met = np.zeros(len(m_n), bool), np.zeros(len(g_n), bool)
            for i, some in enumerate(guests[4].to_pylist()):
                shared = np.fromiter({j for entry in some for j in having.get(entry, ())}, np.int64)
                other = (members[2][shared] != guests[2][i]) & ~(members[3][shared] & (members[1][shared] <= guests[1][i]))
                shared = shared[other & ~(m_met[shared] & g_met[i])]
                shared = shared[may_link(int(g_n[i]), g_bag[i], m_n[shared], m_bag[shared], least)]
                m_met[shared], g_met[i] = True, g_met[i] or len(shared) > 0
            found += [(members[0][m_met], members[1][m_met]), (guests[0][g_met], guests[1][g_met])]
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], names=["host", "key"])

    return _facing(sized, F.lit(1 / block), ("n", "bag"), compare, "host long, key long")


def across(cast: DataFrame, texts: DataFrame, least: float, block: int = 512, words: int = 1 << 17) -> DataFrame:
    """Links (a, b) between components that meet in a bucket, enough to join those that are similar.

    cast: (host, key, owner, guest, entries), for each bucket of several components its largest one as host, the bucket's
    texts, whether they are of another component and which of their entries are in such buckets. Guests are compared with
    all texts of a host that share an entry with them and have another owner; both are dealt into blocks of about ``block``
    texts and ``words`` words, so that a task gets one block of each whatever a host's size is. Only texts whose lengths
    and bags leave a link possible are sent. texts: (key, n, packed, bag).
    """
    sized = cut(cast.join(texts.select("key", "n", "bag"), "key"))
    some = _meeting(sized, least)
    wanted = cut(sized.drop("bag").join(some.distinct(), ["host", "key"], "left_semi"), sized, some)
    release(cast.sparkSession)

    def compare(lying: pa.Table, asking: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        known: dict[int, _Text] = {}

        def text(key: int, column, i: int) -> _Text:
            if key not in known:
                known[key] = _Text(_texts(_unpacked(column.slice(i, 1)))[0])
            return known[key]

        for (_, m_key, m_owner, m_guest, _, m_text), (_, g_key, g_owner, _, g_entries, g_text), having in _tasks(lying, asking, "packed"):
            root: dict[int, int] = {}

            def find(x: int, root=root) -> int:
                while root.setdefault(x, x) != x:
                    x = root[x]
                return x

            for i, entries in enumerate(g_entries.to_pylist()):
                shared = {j for entry in entries for j in having.get(entry, ())}
                for j in sorted(shared):
                    if m_owner[j] == g_owner[i] or m_guest[j] and m_key[j] <= g_key[i]:  # two guests meet once
                        continue
                    x, y = find(int(g_owner[i])), find(int(m_owner[j]))
                    if x != y and text(int(g_key[i]), g_text, i).similar(text(int(m_key[j]), m_text, j), least):
                        found.append((int(g_key[i]), int(m_key[j])))
                        root[x] = y
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    # written, so that its size is known: where it is small, texts are chosen where they lie and only these are sent
    keys = cut(wanted.select("key").distinct())
    chosen = texts.select("key", "packed").join(keys, "key", "left_semi")
    links = _facing(wanted, 1 / block + F.col("n") / words, ("packed",), compare, "a long, b long", chosen)
    drop(wanted, keys)
    return links


def _components(docs: DataFrame, k: int, take: int, entries: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(key, check, doc_id, n, component) of each different text of docs (doc_id, text, key, check); doc_id is its smallest.

    Also the keys that more than one text has; see ``_told_apart``. Both are written tables.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketches(batches):
        for batch in batches:
            for i, j in slices(text_bytes(batch.column("text"))[1], 1 << 20):
                part = batch.slice(i, j - i)
                words = _texts(part.column("text"))
                found = [np.concatenate([sketch(w, k, take, entries), remainders(w, least)]).view(np.int64) if len(w) else None for w in words]
                bags = [bag(w) if len(w) else None for w in words]
                columns = [part.column(c) for c in ("key", "check", "doc_id")]
                columns += [_packed(part.column("text")), pa.array([len(w) for w in words], pa.int32()), pa.array(found, pa.list_(pa.int64())), pa.array(bags, pa.binary())]
                yield pa.record_batch(columns, names=["key", "check", "doc_id", "packed", "n", "entries", "bag"])

    # of each text one row, before it is read: copies are merged where they lie
    rows = docs.groupBy("key", "check").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    sketched = cut(rows.mapInArrow(sketches, f"key long, check int, doc_id {kind}, packed binary, n int, entries array<long>, bag binary"))
    release(spark)
    shared = cut(sketched.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"))
    nodes = _told_apart(sketched, shared)
    entry = nodes.filter("n > 0").select("key", "n", F.explode("entries").alias("entry"))
    # written, as hosts below, so that the join deals both sides anew and can split a bucket of very many texts
    buckets = cut(entry.groupBy("entry").agg(F.min("key").alias("to"), F.min_by("n", "key").alias("to_n"), F.count("*").alias("c")).filter("c > 1").drop("c"))
    members = cut(entry.join(buckets, "entry"), buckets)
    release(spark)
    near = lambda x, y: F.abs(x - y) <= F.floor((1 - least) * F.greatest(x, y) + 1e-9)
    first = cut(members.filter((F.col("key") != F.col("to")) & near(F.col("n"), F.col("to_n"))).select(F.col("key").alias("a"), F.col("to").alias("b")).distinct())
    release(spark)
    texts = nodes.select("key", "n", "packed", "bag")
    links = verify(first, texts, least)
    drop(first)
    release(spark)

    # what the comparison with the smallest has left: pairs of a bucket that lie in different components
    near_first = components(links)
    owned = members.join(near_first.toDF("key", "component"), "key", "left").select("entry", "key", F.coalesce("component", "key").alias("owner"))
    sizes = owned.groupBy("entry", "owner").agg(F.count("*").alias("c"))
    hosts = cut(sizes.groupBy("entry").agg(F.max_by("owner", F.struct("c", "owner")).alias("host"), F.count("*").alias("owners")).filter("owners > 1").drop("owners"))
    met = owned.join(hosts, "entry").select("host", "key", "owner", (F.col("owner") != F.col("host")).alias("guest"), "entry")
    cast = cut(met.groupBy("host", "key", "owner", "guest").agg(F.collect_list("entry").alias("entries")), members, near_first, hosts)  # a text's own entries at most
    release(spark)
    more = across(cast, texts, least)
    drop(cast)
    found = components(links.union(more))
    release(spark)
    named = nodes.join(found.toDF("key", "component"), "key", "left").select("key", "check", "doc_id", "n", F.coalesce("component", "key").alias("component"))
    return cut(named, sketched, links, more, found), shared


def _told_apart(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows whose ``key`` other texts have too get another, from the second hash; ``shared``: such keys, hardly ever any."""
    hit = shared.select("key", F.lit(True).alias("__hit"))
    other = F.xxhash64(F.lit("other"), "check", "key")
    return rows.join(hit, "key", "left").withColumn("key", F.when(F.col("__hit"), other).otherwise(F.col("key"))).drop("__hit")


def _hashes(text: Column) -> tuple[Column, Column]:
    """Two hashes of a text, of 64 and 32 bits."""
    return F.xxhash64(text).alias("key"), F.hash(text).alias("check")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), *_hashes(text))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, take: int = 2, entries: int = 64, least: float = 0.8) -> DataFrame:
    """doc_id, class_id (the smallest id of its class) and n_words for each row.

    k: words of a k-mer; take, entries: k-mers of a sketch entry and entries; least: edit similarity of a link.
    """
    docs = _keyed(docs, id_col, text_col)
    named, shared = _components(docs, k, take, entries, least)
    least_id = cut(named.groupBy("component").agg(F.min("doc_id").alias("class_id")))
    named = named.join(least_id, "component").select("key", "n", F.when(F.col("n") > 0, F.col("class_id")).alias("class_id"))
    keys = _told_apart(docs.select("doc_id", "key", "check"), shared)
    return keys.join(named, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("n").cast("long").alias("n_words"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, take: int = 2, entries: int = 64, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the one with the smallest id.

    Texts without a word all stay. Of rows that agree in id and text the one with the smallest hash of all columns stays.
    """
    named, shared = _components(_keyed(docs, id_col, text_col), k, take, entries, least)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("key").alias("key")))
    chosen = named.filter("n > 0").groupBy("component").agg(first.alias("c")).select(F.col("c.key").alias("key"), F.col("c.id").alias("id"), F.lit(True).alias("worded"))
    stay = cut(chosen.union(named.filter("n = 0").select("key", F.lit(None).cast(chosen.schema["id"].dataType), F.lit(False))).toDF("__key", "__id", "__worded"), named)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    keyed = _told_apart(docs.select(row, *_hashes(F.col(f"`{text_col}`").cast("string"))), shared)
    # by key and id, so that the rows of a text with very many copies are dealt out
    its_id = F.col("__row").getField(id_col).eqNullSafe(F.col("__id"))
    found = keyed.join(stay.filter("__worded"), (keyed["key"] == stay["__key"]) & its_id)
    one = found.groupBy("key").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row")).select("__row")
    empty = keyed.join(stay.filter("not __worded").select("__key"), keyed["key"] == F.col("__key"), "left_semi").select("__row")
    return one.union(empty).select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))
