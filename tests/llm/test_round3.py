"""Prefix tries, id files and source divergence against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexfold.llm import divergence, idfiles, prefixtrie
from lexfold.storage import shared_path

# 11 prefix trie


def brute_trie(rows):
    """Nodes of [(conv_id, turn, role, text)] with turns of distinct numbers."""
    own = defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((r or "", x or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in built.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)

    def below(p):
        return [q for q in members if q[: len(p)] == p]

    out = set()
    for p, m in members.items():
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below(p) if q)
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in below(p)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


CHAT = "conv_id long, turn long, role string, text string, node string, n long, key string, len long"
NAMES = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "k", 0) for r in rows], CHAT).repartition(3)


@pytest.fixture(scope="session")
def conversations():
    rng, rows = random.Random(7), []
    for c in [*range(0, 40), *range(100, 130), *range(215, 240), 10**12 + 5]:
        n = rng.choice([1, 1, 2, 3, 4, 7, 9])
        for t in range(n):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "é𝒳", "longer text"])))
    rows += [(300 + i, t, "user", ["same", "turns", "of all", "of these"][t]) for i in range(30) for t in range(4)]  # copies
    rows += [(400 + i, t, "user", "chain") for i in range(8) for t in range(3 * i + 1)]  # a long chain that others leave
    rows += [(None, 0, "user", "nobody"), (500, None, "user", "first"), (500, 3, "user", "x" * 100_000), (500, 1, "tool", "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [1, 20, prefixtrie.LIMIT])
def test_trie(spark, conversations, limit):
    got = prefixtrie.tried(chats(spark, conversations), limit).select(*NAMES).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_trie(conversations), key=repr)


def test_trie_edges(spark, conversations, monkeypatch):
    assert prefixtrie.tried(chats(spark, conversations).limit(0)).count() == 0
    assert prefixtrie.tried(chats(spark, [(None, 1, "user", "x")])).count() == 0
    # conversation 107 keeps none of its own turns where its first ones are those of 100, which is absent
    alone = [(c, 0, "user", "x") for c in range(100, 200) if zlib.crc32(str(c).encode()) % 6 and c % 100][:3]
    got = prefixtrie.tried(chats(spark, alone)).select(*NAMES).collect()
    assert [tuple(r) for r in got] == list(brute_trie(alone)) and got[0]["n_leaves"] == 1
    monkeypatch.setattr(prefixtrie, "CHUNK", 7)  # digests of many chunks
    got = prefixtrie.tried(chats(spark, conversations)).select(*NAMES).collect()
    assert set(map(tuple, got)) == brute_trie(conversations)
    # turns of one number, and rows that repeat, are turns each
    tied = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a")]
    got = prefixtrie.tried(chats(spark, tied), most=1).select("depth", "n_convs").collect()
    assert max(r["depth"] for r in got) == 3


# 12 id files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 300), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400), st.sampled_from([4, 64, 1024]))
def test_words(values, block):
    values = np.array(values, np.uint64)
    words, offsets = idfiles.encode(values, block)
    assert idfiles.decode(words).tolist() == values.tolist() and len(offsets) == -(-len(values) // block)
    for a, b in ((0, len(values)), (len(values) // 3, len(values) // 2), (len(values) - 1, len(values))):
        assert idfiles.part_of(words, offsets, max(a, 0), b, block).tolist() == values[max(a, 0) : b].tolist()


def test_words_are_packed():
    assert len(idfiles.encode(np.ones(60, np.uint64))[0]) == 1
    assert len(idfiles.encode(np.full(8, 127, np.uint64))[0]) == 1 and len(idfiles.encode(np.full(8, 128, np.uint64))[0]) == 2
    assert len(idfiles.encode(np.array([2**60], np.uint64))[0]) == 2


def test_pieces_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(2)
    letters = ["a", "b", " ", " ", "\n", "1", "é", "'s", "\t", ".", "\x1c", "word", " ", "😀", "<|endoftext|>", "\x01", "\r"]
    texts = [None, "", " ", "a b", "a\nb c", "\n", "a <|endoftext|> b", "don't stop\nit's 12345", "x" * 300 + " y"] + ["".join(rng.choices(letters, k=rng.randrange(1, 25))) for _ in range(4000)]
    texts += [" ".join(rng.choices(["plain", "words", "of", "é", "1984", "it's", "(so)", "a\nline"], k=12)) for _ in range(500)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        own, plain = idfiles.Encoder(path), Tokenizer.from_file(path)
        for got in (own(texts), own(texts)):
            assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
        own.shrink(10)
        assert len(own.known) <= 10 and [g.tolist() for g in own(texts)] == [g.tolist() for g in got]


def stored_ids(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, at, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for d, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("segment", [50, idfiles.SEGMENT])
def test_id_files(spark, docs, corpus, segment):
    out = shared_path(spark, "idfiles-test")
    idfiles.written(docs, out, segment=segment)
    want = stored_ids(sorted((d, t) for d, t, *_ in corpus))
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in idfiles.documents(spark, out, with_ids=True).collect())
    assert got == want
    every = [i for *_, ids in want for i in ids]
    for a, b in ((0, 10), (1000, 5000), (len(every) - 3, len(every) + 9), (7, 7)):
        assert [i for r in sorted(idfiles.between(spark, out, a, b).collect()) for i in r["ids"]] == every[a:b]


def test_id_files_edges(spark, docs):
    out = shared_path(spark, "idfiles-test")
    idfiles.written(docs.limit(0), out)
    assert idfiles.documents(spark, out).count() == 0
    out = shared_path(spark, "idfiles-test")
    rows = [(None, "b"), (None, None), (3, "a"), (3, "a"), (3, "c")]
    idfiles.written(spark.createDataFrame([(f"{d}" if d else None, t, 1) for d, t in rows], "id string, body string, part int"), out, id_col="id", text_col="body")
    got = sorted(idfiles.documents(spark, out).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, "3", "3", "3"] and [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]


# 13 source divergence


def brute_audit(rows, least, top):
    docs = [(g or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", brute.low(t))) for t, g, s in rows]
    out = set()
    for lang in {g for g, *_ in docs}:
        seen, n = Counter(), defaultdict(Counter)
        sources = {s for g, s, _ in docs if g == lang}
        for g, s, words in docs:
            if g == lang:
                seen.update(set(words))
                n[s].update(words)
        kept = [t for t in seen if seen[t] >= least]
        v = len(kept)
        p = {s: {t: 1 + 10**9 * (n[s][t] + 2) // (sum(n[s][k] for k in kept) + 2 * v) for t in kept} for s in sources}
        whole = {t: sum(n[s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 2) // (sum(whole.values()) + 2 * v) for t in kept}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(-gap(p[s][t], q[t]), t) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out |= {(lang, s, part, item, -value, i) for i, (value, item) in enumerate(found, 1)}
    return out


COLUMNS = "text string, lang string, source string, term string, n long, docs long, a string"


@pytest.mark.parametrize(("least", "top"), [(10, 10), (1, 2), (3, 5)])
def test_divergence(spark, least, top, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 50)
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "GAMMA", "ÉÉ", "éé", "𝒳", "it's", "x1y", "zeta", "rare"]
    rows = [(" ".join(rng.choices(vocabulary, weights=range(10, 0, -1), k=rng.randrange(0, 40))), rng.choice(["en", "fr", None, ""]), rng.choice(["s0", "s0", "s1", "s2", None, ""])) for _ in range(150)]
    rows += [(None, "en", "empty"), ("1 2 3", "de", "x"), ("", "de", "y"), ("once", "it", "only"), *[("copy copy", "en", "s0")] * 12]
    df = spark.createDataFrame([(*r, "x", 1, 1, "x") for r in rows], COLUMNS).repartition(3)
    assert {tuple(r) for r in divergence.audited(df, least, top).collect()} == brute_audit(rows, least, top)


def test_divergence_edges(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert divergence.audited(df).count() == 0
    # large counts stay exact where a long would not hold the product
    big = spark.createDataFrame([(9_000_000_000, 27_000_000_077), (8_999_999_999, 27_000_000_077), (0, 7)], "n long, size long")
    assert [r[0] for r in big.select(divergence._share("n", "size")).collect()] == [1 + 10**9 * (n + 2) // s for n, s in [(9_000_000_000, 27_000_000_077), (8_999_999_999, 27_000_000_077), (0, 7)]]
