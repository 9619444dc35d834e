import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from factorloom.llm import bpe, langid, licenses, substrings, words

CODEC = bpe.Codec.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# --- licences


def base_by_force(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    found = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_license_base_places(spark, odd, empty):
    texts = ["MIT license, mit LICENSE and cc-by 4.0", "gnu general public gnu general public license version 3", "Apache  License 2.0 apache_license", "café cc by\x85 cc by"]
    docs = odd.unionByName(spark.createDataFrame([(100 + i, t, "en", "a", 1, "k", 1, 0.0) for i, t in enumerate(texts)], odd.schema))
    wanted = Counter((r.doc_id, *base_by_force(r.text)) for r in docs.collect())
    got = licenses.digests(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == wanted
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.digests(empty).collect() == []


def test_templates():
    machine = licenses.Automaton({"t": "one <<beginOptional>>two <<beginOptional>>deep<<endOptional>><<endOptional>> three <<var;name=x;words=1-2>> end"})
    accepts = {"one three a end": True, "one two three a b end": True, "one two deep three a end": True, "one three end": False, "one three a b c end": False, "one deep three a end": False, "one two two three a end": False}
    for text, wanted in accepts.items():
        assert bool(machine.scan(text.encode())[1]) == wanted, text
    with pytest.raises(ValueError):
        licenses.Automaton({"t": "<<beginOptional>>only<<endOptional>><<var;name=x>>"})


def ends_by_force(parts, words, i):
    """Where a template's parts (word, nested list of an optional part, or (least, most)) can end if they begin at i."""
    if not parts:
        return {i}
    head, rest = parts[0], parts[1:]
    if isinstance(head, list):
        return ends_by_force(rest, words, i) | {e for j in ends_by_force(head, words, i) for e in ends_by_force(rest, words, j)}
    if isinstance(head, tuple):
        least, most = head
        upto = len(words) if most is None else min(len(words), i + most)
        return {e for j in range(i + least, upto + 1) for e in ends_by_force(rest, words, j)}
    return ends_by_force(rest, words, i + 1) if i < len(words) and words[i] == head else set()


def marked(parts):
    names = lambda p: f"<<beginOptional>>{marked(p)}<<endOptional>>" if isinstance(p, list) else p if isinstance(p, str) else f"<<var;name=x;words={p[0]}-{p[1]}>>" if p[1] is not None else '<<var;name="x";original="any <words>";match=".+">>' if p[0] else "<<var;name=x>>"
    return " ".join(map(names, parts))


def test_templates_equal_brute_force():
    pick = random.Random(17)

    def made(depth):
        out = [pick.choice("abcd")]
        for _ in range(pick.randint(0, 5)):
            kind = pick.random()
            out.append(pick.choice("abcd") if kind < 0.5 else made(depth + 1) if kind < 0.75 and depth < 2 else pick.choice([(0, 2), (1, 3), (2, 2), (0, None), (1, None)]) if kind >= 0.75 else "a")
        return out

    for _ in range(250):
        templates = {f"t{i}": made(0) for i in range(3)}
        machine = licenses.Automaton({k: marked(v) for k, v in templates.items()})
        words = [pick.choice("abcde") for _ in range(pick.randint(0, 25))]
        wanted = {(k, i, max(ends)) for k, v in templates.items() for i in range(len(words)) if (ends := ends_by_force(v, words, i))}
        n, places = machine.scan(" ".join(words).encode(), run=pick.choice([3, 1000]))
        assert n == len(words) and {tuple(p) for p in places} == wanted, (templates, words)


def test_published_markup():
    markup = '''<<beginOptional>>The Small License<<endOptional>> <<var;name="copyright";original="Copyright (c) <year> <owner>";match=".{0,5000}">>
    You may use <<var;name="it";original="this work";match=".{0,20}">> freely. <<beginOptional>><<var;name="bullet";original="1.";match=".{0,20}">><<endOptional>> Keep this notice.'''
    machine = licenses.Automaton({"small": markup})
    for text, wanted in {
        "The Small License Copyright (c) 2020 me You may use this work freely. Keep this notice.": True, "You may use the software and its documentation, all of it, freely. 1) Keep this notice": True,
        "You may use this work freely. Keep that notice.": False, "You may use a b c d e f g h i j k freely. Keep this notice.": False,
    }.items():
        assert bool(machine.scan(text.encode())[1]) == wanted, text


def test_regions_hold_what_their_match_says():
    found = lambda match, text: bool(licenses.Automaton({"t": f'granted by <<var;name="x";original="";match="{match}">> to all'}).scan(text.encode())[1])
    long = lambda n: "granted by " + "x " * n + "to all"
    assert found(".{0,5000}", long(2500)) and not found(".{0,5000}", long(2501)) and not found(".{0,5000}", long(20_000))
    assert found(".{0,200}", long(100)) and not found(".{0,200}", long(101)) and found(".{0,}", long(20_000)) and found(".+", long(20_000))
    assert not found(".+", long(0)) and not found(".{1,20}", long(0)) and found(".{0,20}", long(0))
    for match in ("MIT|ISC|the holder", "(MIT|ISC|the holder)", "(?:MIT|ISC|the holder)"):
        assert all(found(match, f"granted by {w} to all") for w in ("MIT", "isc", "The Holder"))
        assert not any(found(match, f"granted by {w} to all") for w in ("", "the", "proprietary no licence at all", "MIT ISC"))
    assert found("(holder|)", "granted by to all")
    for match in ("[0-9]+", "a(b|c)d", "x.y", "\\d", "a{2}"):
        with pytest.raises(ValueError):
            licenses.region(f'name="x";match="{match}"')


def test_mit_text_with_holder_and_long_runs():
    text = re.sub(r"<<var[^>]*>>", "THE AUTHORS OR COPYRIGHT HOLDERS", licenses.TEMPLATES["mit-text"])
    text = re.sub(r"<<[^>]*>>", "", text)
    machine = licenses.Automaton(licenses.TEMPLATES)
    for lead in ("", "words before it " * 50):
        whole = (lead + text + " and after").encode()
        n, places = machine.scan(whole, run=97)  # runs much shorter than the template
        assert n == len(licenses.words_of(whole))
        assert ("mit-text", len(lead.split())) in {(p.label, p.start) for p in places}
    assert "mit-text" not in {p.label for p in machine.scan(text.replace("merge", "mangle").encode())[1]}


def test_templates_reach_the_end_of_the_wording():
    machine = licenses.Automaton(licenses.TEMPLATES)
    ends = {"unlicense-text": "OTHER DEALINGS IN THE SOFTWARE", "zlib-text": "from any source distribution", "gpl-notice": "for more details", "isc-text": "PERFORMANCE OF THIS SOFTWARE", "bsd-2-clause-text": "POSSIBILITY OF SUCH DAMAGE", "bsd-3-clause-text": "POSSIBILITY OF SUCH DAMAGE", "apache-2.0-header": "limitations under the License"}
    for label, end in ends.items():
        text = re.sub(r"<<[^>]*>>", "", re.sub(r"<<var[^>]*>>", "THE OWNER", licenses.TEMPLATES[label]))
        assert " ".join(end.split()) in " ".join(text.split())
        found = {p.label for p in machine.scan(text.encode())[1]}
        assert label in found and len(found & {"bsd-2-clause-text", "bsd-3-clause-text"}) <= 1
        assert label not in {p.label for p in machine.scan(text.replace(end, "OTHER WORDING").encode())[1]}


# --- byte-level BPE


def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def test_bpe_equals_the_library(odd, empty):
    own = encoding()
    wanted = Counter()
    for r in odd.collect():
        ids = own.encode_ordinary(r.text or "")
        wanted[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(r.text or "")] += 1
    assert Counter(map(tuple, bpe.digests(odd, CODEC).collect())) == wanted
    assert bpe.digests(empty, CODEC).collect() == []


@pytest.mark.parametrize("step,overlap", [(128, 16), (64, 64), (50, 8)])
def test_chunks_are_stitched(spark, step, overlap):
    pick = random.Random(step)
    texts = ["".join(pick.choice("ab '\n1é ,　\x1c") for _ in range(pick.randint(0, 900))) for _ in range(30)]
    texts += ["a" * 700, " " * 500, "word " * 40 + "z" * 300 + " and more" * 30, "it's we'll " * 60, "\n" * 300 + "x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0] * 3)] * 2, "doc_id long, text string")
    rows = bpe.decode(bpe.encode(docs, CODEC, step=step, overlap=overlap), CODEC).collect()
    own = encoding()
    known = dict(enumerate(texts)) | {None: texts[0] * 3}
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert list(r.ids) == own.encode_ordinary(known[r.doc_id]) and bytes(r.decoded) == known[r.doc_id].encode()


# --- repeated passages


def removed_by_force(texts, width=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        yield len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))


def test_difference_cover():
    for period in (1, 2, 7, 13, 21):
        cover = substrings.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_repeats_equal_brute_force(spark, odd, empty):
    pick = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[pick.choice(vocabulary) for _ in range(n)] for n in (34, 35, 36, 60, 150)]
    texts = []
    for _ in range(60):
        parts = [[pick.choice(vocabulary) for _ in range(pick.randint(0, 80))] for _ in range(3)]
        for p in pick.sample(passages, 2):
            parts.insert(pick.randint(0, 3), p)
        texts.append(" \n\x0b"[pick.randint(0, 2)].join(w for p in parts for w in p))
    texts += ["ha " * 36, "ho " * 35, "one two " * 40]
    docs = odd.unionByName(spark.createDataFrame([(100 + i, t, "en", "a", 1, "k", 1, 0.0) for i, t in enumerate(texts)], odd.schema))
    rows = docs.collect()
    wanted = Counter((r.doc_id, *x) for r, x in zip(rows, removed_by_force([r.text for r in rows]), strict=True))
    assert Counter(map(tuple, substrings.digests(docs).collect())) == wanted
    assert substrings.digests(empty).collect() == []


def patterned(bits):
    """The word of a and b that polynomial hashes modulo powers of two can't tell from its complement."""
    return "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))


def test_words_that_cancel_out_differ(spark, odd):
    for bits in range(1, 13):
        word = patterned(bits).encode()
        pair = np.frombuffer(word + word.translate(bytes.maketrans(b"ab", b"ba")), np.uint8)
        hashes = words.word_hashes(pair, np.array([0, len(word)]), np.array([len(word), 2 * len(word)]))
        assert hashes[0] != hashes[1]
    one, two = patterned(10), patterned(10).translate(str.maketrans("ab", "ba"))
    texts = [" ".join([w] * 35) for w in (one, two)] + [" ".join([one] * 36)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, "k", 1, 0.0) for i, t in enumerate(texts)], odd.schema)
    wanted = Counter((i, *x) for i, x in enumerate(removed_by_force(texts)))
    assert Counter(map(tuple, substrings.digests(docs).collect())) == wanted


def test_words_of_one_hash_differ(spark):
    """Two words that the first hash can't tell apart; windows of them are told apart by their words."""
    one, other = "DFU6ciZ6pt1AqZpz", "WQKA9FU7+ageToVp"
    data = np.frombuffer(f"{one} {other}".encode(), np.uint8)
    hashes = words.word_hashes(data, np.array([0, 17]), np.array([16, 33]))
    assert hashes[0] == hashes[1]
    mixed = [one if i % 3 else other for i in range(40)]
    texts = [" ".join([one] * 35), " ".join([other] * 35), " ".join(mixed), " \t".join(mixed), " ".join(one if i % 3 else one for i in range(34))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.digests(docs).collect()) == [(0, 35, 0), (1, 35, 0), (2, 40, 40), (3, 40, 40), (4, 34, 0)]


def test_word_hashes_are_of_the_bytes_alone():
    pick = random.Random(5)
    found = {}
    for _ in range(300):
        parts = [bytes(pick.randrange(33, 36) for _ in range(pick.choice([1, 2, 7, 8, 9, 15, 16, 17, 255, 256, 257, 300]))) for _ in range(20)]
        data = np.frombuffer(b" ".join(parts), np.uint8)
        starts, ends, _ = words.split(data, np.array([0, len(data)]))
        for part, h in zip(parts, words.word_hashes(data, starts, ends).tolist(), strict=True):
            assert found.setdefault(part, h) == h
    assert len(set(found.values())) == len(found)


def test_hashes_are_compared_whole():
    """Windows that agree in their first hash only aren't taken for repeats."""
    known = np.array([[1, 5], [1, 7], [1, 9], [4, 1]], np.uint64)
    asked = np.array([[1, 7], [1, 8], [4, 1], [4, 2], [9, 9], [0, 0], [1, 9]], np.uint64)
    assert substrings._among(asked, known).tolist() == [True, False, True, False, False, False, True]
    sent = substrings._send(3, [np.array([[1, 5], [1, 7], [1, 5]], np.uint64)], 1, 2)
    assert (np.frombuffer(sent["ones"][0].as_py(), np.uint64).tolist(), np.frombuffer(sent["many"][0].as_py(), np.uint64).tolist()) == ([1, 7], [1, 5])


def test_dealing_grows_with_the_input():
    assert substrings._dealing(0, None) == (64, 64)
    for size in (10**9, 10**12, 10**14):
        blocks, buckets = substrings._dealing(size, None)
        assert size / blocks <= 64 << 20 and buckets <= blocks


# --- languages


def test_code_lengths_equal_a_plain_model():
    samples = {"x": [b"abracadabra abra", b"cadabra"], "y": [b"zyx zyx yyy", "été".encode()]}
    model = langid.Model(samples, order=3)

    def plain(lang, text):
        counts = Counter()
        for t in samples[lang]:
            for i in range(len(t)):
                for n in range(4):
                    if i >= n:
                        counts[t[i - n : i], t[i]] += 1
        import math

        bits = 0.0
        for i, b in enumerate(text):
            for n in range(min(3, i), -1, -1):
                context = text[i - n : i]
                here = {s: c for (k, s), c in counts.items() if k == context}
                if not here:
                    continue
                total, kinds = sum(here.values()), len(here)
                if b in here:
                    bits += math.log2((total + kinds) / here[b])
                    break
                bits += math.log2((total + kinds) / kinds)
            else:
                bits += 8
        return bits

    import numpy as np

    texts = [b"", b"a", b"abra zyx", b"q", "é".encode(), b"cadabra zz top abracadabra"]
    offsets = np.cumsum([0, *map(len, texts)])
    got = model.code_lengths(np.frombuffer(b"".join(texts), np.uint8), offsets, most=5)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx([plain(lang, t) for lang in ("x", "y")], rel=1e-5)


def test_languages(spark, odd, empty):
    words = {"en": "the and of to in is that with for it was on".split(), "de": "der die und das ist nicht ein mit von zu auch".split(), "fr": "le la les et une est que dans pour il été".split()}
    pick = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(pick.choices(words[lang], k=30)), lang, lang) for i in range(300) for lang in [pick.choice(list(words))]], "doc_id long, text string, lang string, source string")
    rows = langid.digests(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.99
    found = {r.doc_id: r for r in langid.digests(odd).collect()}
    assert found[1].lang_pred == found[2].lang_pred == found[3].lang_pred == found[8].lang_pred == "und"
    assert found[None].held_out and found[10].lang_pred != "und"
    assert len(langid.digests(odd).collect()) == odd.count()
    assert langid.digests(empty).collect() == []
    unlabelled = langid.digests(docs.withColumn("lang", docs["lang"].substr(100, 1)).replace("", None, "lang")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_prediction_ignores_labels(spark, odd):
    model = langid.train(odd)
    first = langid.predict(odd, model, keep=("doc_id",)).collect()
    blind = odd.withColumns({"lang": odd["source"], "source": odd["lang"]})
    assert Counter(map(str, first)) == Counter(map(str, langid.predict(blind, model, keep=("doc_id",)).collect()))


def test_language_sample_is_whole_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "Model", lambda samples, order: samples)
    rows = [(7, f"text {i}", "one id") for i in range(2000)] + [(8, "same", "one row")] * 2000 + [(9, "x" * 9000 + " end", "long")]
    samples = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert 90 <= len(samples["one id"]) <= 220
    assert samples["one row"] == [b"same"]
    assert samples["long"][0].endswith(b" end")
