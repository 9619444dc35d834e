"""Fill-in-the-middle, sharding and the trie of conversations against plain versions."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from factorloom.llm import fim, sharding, trie

# --- fill-in-the-middle


def plain_fim(doc_id, text, rate=90, spm=20):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(text), "plain", None, None, text
    a, b = sorted(x % (len(text) + 1) for x in h[:2])
    p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(text), form, a, b - a, s + p + m if form == "spm" else p + s + m


def test_fim_equals_a_plain_version(spark, odd):
    rows = [(i, f"zeile {i}\n\U0001f600é漢 \r\n" * (i % 7)) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(("<P>", "a<S>b", "x" * 50 + "<M>", "<p><s>", "$1\\Q\\E", None, ""))]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), odd):
        found = fim.rearranged(docs).collect()
        assert sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in found))) == sorted(str((r.doc_id, *plain_fim(r.doc_id, r.text))) for r in docs.collect())
        assert all(r.restored == (r.text or "") for r in fim.restored(fim.rearranged(docs)).collect())
    assert {r.form for r in fim.rearranged(docs.limit(0)).collect()} == set()


def test_fim_cuts_other_units(spark):
    docs = spark.createDataFrame([(i, "one line\ntwo lines\n\nand no end") for i in range(50)], "doc_id long, text string")
    rows = fim.rearranged(docs, rate=100, spm=0, unit="[^\n]*\n|[^\n]+").collect()
    assert {r.n for r in rows} == {4} and {r.form for r in rows} == {"psm"}
    assert all(re.fullmatch("(?:.*\n|.*no end)?", r.output[3 : r.output.index("<S>")], re.S) for r in rows)
    own = fim.Sentinels("[[", "||", "]]")
    marked = fim.rearranged(docs, rate=100, sentinels=own)
    assert all(r.output.count("[[") == 1 and r.restored == r.text for r in fim.restored(marked, sentinels=own).collect())
    with pytest.raises(ValueError):
        fim.rearranged(docs, rate=101)


def test_fim_keeps_columns_and_gives_way(spark, empty):
    docs = spark.createDataFrame([(1, "abc", "old", 7)], "doc_id long, text string, output string, n int")
    row = fim.rearranged(docs, rate=100).first()
    assert row.n == 3 and row.output != "old" and row.text == "abc"
    assert fim.digests(empty).count() == 0


# --- sharding


def plain_jump(key, shards):
    state = int(hashlib.sha256(("" if key is None else str(key)).encode()).hexdigest()[:15], 16)
    b, j = -1, 0
    while j < shards:
        b = j
        state = (state * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 7, 40, 1000])
def test_jumps(spark, shards):
    keys = spark.range(400).withColumn("id", F.col("id") * 977)
    for r in sharding.jump(keys, F.col("id"), shards).collect():
        assert (r["__shard"], r["__grown"]) == (plain_jump(r.id, shards), plain_jump(r.id, shards + 1))
        assert r["__grown"] in (r["__shard"], shards)


def test_late_jumps_are_made(spark):
    """Jumps beyond the usual number are made too."""
    state = spark.range(200).select(sharding.seed(F.col("id")).alias("k"), "id")
    rows = state.withColumn("s", F.expr(sharding._jumps("named_struct('b', -1L, 'j', 0L, 'k', k)", 500, 1)))
    rows = rows.withColumn("s", F.expr(sharding._jumps("s", 500, 500)))
    assert all(r.s.b == plain_jump(r.id, 500) for r in rows.collect())


def test_shards_of_odd_rows(spark, odd, empty):
    many = odd.union(odd).union(spark.createDataFrame([(77, "hot", "en", "a", 3, "k", 3, 0.5)] * 500, odd.schema))
    found = sharding.sharded(many, shards=5).collect()
    assert len(found) == many.count()
    places = {}
    for r in found:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.shard) == (len(data) + 16, zlib.crc32(data), "key", plain_jump(r.doc_id, 5))
        assert r.grown_shard == plain_jump(r.doc_id, 6) and r.key == "k"
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    again = sharding.digests(many.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, sharding.digests(many).collect()))
    assert sharding.digests(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.sharded(odd, shards=0)


def test_shards_are_written(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows = sharding.sharded(docs, shards=3)
    sharding.write(rows, str(tmp_path / "out"), slots=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.shard, r.slot, r.text) for r in back.collect()) == sorted((r.shard, r.slot, r.text) for r in rows.collect())


# --- trie


def plain_trie(convs):
    """Nodes of {conv_id: [(digest, words), ..]}."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            node = nodes.setdefault(tuple(x for x, _ in turns[:d]), {"members": [], "ends": [], "words": turns[d - 1][1] if d else 0})
            node["members"].append(c)
            if d == len(turns):
                node["ends"].append(c)
    out = set()
    for path, node in nodes.items():
        d = len(path)
        under = [(p, x) for p, x in nodes.items() if p[:d] == path]
        parents = {p[:-1] for p in nodes if p}
        out.add((
            min(node["members"]), d, min(nodes[path[:-1]]["members"]) if d else None, len(node["members"]), sum(len(p) == d + 1 for p, _ in under), sum(p not in parents for p, _ in under),
            sum((len(x["members"]) - 1) * x["words"] for _, x in under), hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest(),
        ))
    return out


def frame(spark, convs):
    rows = [(c, [(hashlib.sha256(str(x).encode()).hexdigest()[:32], w) for x, w in turns]) for c, turns in convs.items()]
    return spark.createDataFrame(rows, "conv_id long, turns array<struct<d: string, w: int>>")


CASES = {
    "random": lambda rng: {c: [(x, x + 1) for x in (rng.randrange(3) for _ in range(rng.randrange(6)))] for c in range(-40, 120)},
    "copies": lambda rng: {c: [(1, 5), (2, 0), (3, 7)] if c % 3 else [(10 + c % 5, c % 5)] * (c % 4) for c in range(150)},
    "chain": lambda rng: {c: [(9, 2)] * c for c in range(40)},
    "long": lambda rng: {c: [(i, 1) for i in range(400)] + [(c, 3)] for c in range(20)},
    "turnless": lambda rng: {c: [] for c in range(30)},
    "one": lambda rng: {7: [(1, 4), (2, 5)]},
}


@pytest.mark.parametrize("blocks", [1, 3, 24])
@pytest.mark.parametrize("case", CASES)
def test_trie_equals_a_plain_version(spark, case, blocks):
    convs = CASES[case](random.Random(f"{case}{blocks}"))
    wanted = plain_trie({c: t for c, t in convs.items()})
    found = trie.prefix_trie(frame(spark, convs), blocks).collect()
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted


def test_trie_of_odd_turns(spark):
    rows = [
        (20, None, None, None, 1), (20, 0, "user", "a b", 2), (20, 1, "user", "c", 3), (21, 0, "user", "x", 4), (21, 5, "user", "y\x0bz", 5), (21, 9, "user", "end", 6), (21, 10, "user", "end", 6),
        (43, 0, "u", "only", 7), (None, 0, "user", "nobody's", 8), (20, 1, "user", "c", 3), (-5, 0, "user", "neg", 1), (61, 0, "u", "", 1), (62, 0, "u", "long " * 50_000, 1),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, key int")
    own = {}
    for c, t, role, text, _ in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c / 20) * 20
        whole = sorted(own.get(base, []))[:h] + sorted(own[c])[h:]
        convs[c] = [((r, x), len(re.findall("[^\x20\x09-\x0d]+", x))) for _, _, r, x in whole]
    assert {tuple(r) for r in trie.digests(turns).collect()} == plain_trie(convs)
    assert trie.digests(turns.limit(0)).count() == 0


def test_neighbours_of_blocks():
    blocks = [(3, 2, -1), (4, None, 5), (7, 0, 4), (9, 6, 3)]
    assert trie.neighbours(blocks) == [(3, -1, 5, [], []), (4, 5, 4, [3], [-1]), (7, 4, 3, [4, 3], [5, -1]), (9, 3, -1, [7, 3], [0, -1])]
