"""Every operator against brute force, with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexfold.llm import common, decontam, langid, linededup, packing, pii, quality, simhash, toxicity, toolchat, urlrep


def twice(df):
    return df.union(df)


# 2 SimHash


def test_fingerprints_and_components(spark, docs, corpus):
    want = brute.components([(d, t) for d, t, *_ in corpus])
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want) - 10  # there is something to link
    again = simhash.near_duplicates(twice(docs)).collect()
    assert len(again) == 2 * len(got) and {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in again} == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_lists_lose_no_component(spark):
    """Fingerprints around one value, far more than a list may hold, and chains two bits long."""
    rng = np.random.default_rng(3)
    near = {0}
    for _ in range(300):
        x = 0
        for b in rng.integers(0, 64, 2):
            x ^= 1 << int(b)
        near.add(x)
    chain, x = [], 0xFF00FF00FF00FF00
    for b in range(0, 40, 2):
        x ^= 3 << b
        chain.append(x)
    ids = [int(v) - (1 << 64) if v >> 63 else int(v) for v in near | set(chain)]
    fps = spark.createDataFrame([(v,) for v in ids], "fp long")
    root = {v: v for v in ids}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(fps)).collect()}
    assert {v: got.get(v, v) for v in ids} == {v: find(v) for v in ids}


def test_long_and_short_lists_go_one_way(spark):
    """Thousands of fingerprints that differ in two free bytes alone, and pairs: every component is found."""
    near = [a << 40 | b << 8 for a in range(0, 256, 3) for b in range(0, 256, 7)]
    pairs = [x ^ y for i in range(40) for x in [int(np.random.default_rng(i).integers(1 << 62))] for y in (0, 1 << (i % 62) | 1 << (i * 7 + 1) % 62)]
    ids = sorted(set(near + pairs))
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(v,) for v in ids], "fp long"))).collect()}
    root = {v: v for v in ids}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    flips = [0, *(1 << b for b in range(64)), *(1 << b | 1 << c for b in range(64) for c in range(b))]
    for v in ids:
        for f in flips:
            if v ^ f in root:
                p, q = sorted((find(v), find(v ^ f)))
                root[q] = p
    assert {v: got.get(v, v) for v in ids} == {v: find(v) for v in ids}


def test_keep_first_keeps_one_of_each_group(docs, corpus):
    want = set(brute.similar([(d, t) for d, t, *_ in corpus]).values())
    kept = simhash.keep_first(twice(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want) and kept.columns == docs.columns and len(want) < len(corpus) - 5
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_a_repeated_id_of_two_texts_stands_for_its_group(spark):
    """A doc_id with two texts: as long as one of them stands for a group, a row of the id stays."""
    text = lambda s: " ".join(f"{s}{i}" for i in range(40))
    df = spark.createDataFrame([(1, text("a"), "x"), (2, text("a"), "x"), (2, text("b"), "x"), (3, text("b"), "x"), (None, text("a"), "x")], "doc_id long, text string, __id string")
    got = simhash.keep_first(df)
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 1, 2] and got.columns == df.columns


# 3 decontamination

ITEMS = [(1, " ".join(f"b{i}" for i in range(30))), (2, "Short ITEM text"), (3, None), (4, ""), (5, "?? --"), (6, " ".join(f"b{i}" for i in range(17, 45))), (7, "the the the the the the the the the the the the the the the"), (2, "Short ITEM text")]


def test_contamination(spark, docs, corpus):
    b = [f"b{i}" for i in range(45)]
    extra = [
        (900, " ".join(b[:13]), "en", "s"), (901, " ".join(b[:12]), "en", "s"), (902, "x " * 300 + " ".join(b[3:40]) + " y" * 10, "en", "s"), (903, "a short, item-text; Short item TEXT", "en", "s"),
        (904, "the " * 40, "en", "s"), (905, " ".join(b[:20]) + " short item text " + " ".join(b[20:45]), "en", "s"), (906, " ".join(b).upper() + " É é", "en", "s"), (907, "B0 " + "," .join(b[1:25]), "en", "s"),
    ]
    every = corpus + extra
    df = docs.select("doc_id", "text", "lang", "source", "h").unionByName(spark.createDataFrame([(d, t, g, s, "h") for d, t, g, s in extra], "doc_id long, text string, lang string, source string, h string"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute.contamination([t for _, t, *_ in every], ITEMS)
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in decontam.report(df, bench).collect()}
    assert got == {d: w for (d, *_), w in zip(every, want, strict=True)}
    assert sum(w[4] for w in want) >= 5
    assert decontam.report(twice(df), bench).count() == 2 * len(every)
    clean = decontam.clean(df, bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for (d, *_), w in zip(every, want, strict=True) if not w[4]) and clean.columns == df.columns
    assert decontam.report(df, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert decontam.report(df.limit(0), bench).count() == 0


def test_proximity_finds_phrases_with_words_between(spark):
    item = " ".join(f"q{i}" for i in range(13))
    near = item.replace("q6", "q6 inserted")
    df = spark.createDataFrame([(1, item), (2, "pad " * 40 + near), (3, "q0 " + "pad " * 40 + "q12")], "doc_id long, text string")
    tests = decontam.items(spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = {r["doc_id"] for r in decontam.proximity(decontam.index(df, tests), tests, slop=2).collect()}
    assert got == {1, 2}


# 4 quality


def test_quality_measures(docs, corpus):
    got = quality.judged(docs).collect()
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in got} == {d: brute.quality(t) for d, t, *_ in corpus}
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert quality.judged(docs.limit(0)).count() == 0 and quality.judged(twice(docs)).count() == 2 * len(corpus)


def test_bad_hosts_are_condemned_by_many_pages_alone(spark):
    good, bad = " ".join(f"g{i}" for i in range(80)), "%% $$ ## && " * 30 + " ".join(f"j{i}" for i in range(80))
    rows = [(i, good + f" u{i}", "fine") for i in range(200)] + [(1000 + i, bad + f" v{i}", "junk") for i in range(200)] + [(2000, good, "junk"), (3000, bad, "tiny"), (4000, good, None)]
    got = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] and got[4000] and not got[1000] and not got[2000]
    hosts = spark.createDataFrame([("a", 0, 0)], "host string, n long, failures long").limit(0)
    assert quality.prior(hosts) == (0.5, 0.5)


# 6 line dedup


@pytest.mark.parametrize("ratio,least", [(0.01, 3), (0.5, 2), (0.2, 1)])
def test_lines(docs, corpus, ratio, least):
    got = linededup.stripped(twice(docs), ratio, least).collect()
    want = dict(zip((d for d, *_ in corpus), brute.stripped([(s, t) for _, t, _, s in corpus], ratio, least), strict=True))
    assert len(got) == 2 * len(corpus) and {r["doc_id"]: r["text"] for r in got} == want
    assert linededup.stripped(docs.limit(0)).count() == 0


# 7 URLs

RULES = [(r.verdict, r.pattern) for r in urlrep.RULES]
URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/1", "https://a.example.org/en/1x?y#z", "https://a.example.org/en/2", "https://notexample.org/es/", "http://x.com/fr/a", "http://x.com/de/a", "http://x.com/de",
    "http://com/de/?q", "a://b://c.org/", "http://org", "http://x.org?p=/es/", "http://É.com/FR/", "http://x.com#/fr/", "http://u@h.co.uk:80/a", "http://10.0.0.1/a", "http://x.org/a\nb",
]


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urlrep.judged(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    for i, u in enumerate(URLS):
        host, path = brute.url(u)
        which, verdict = brute.rule(host, path, RULES)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, which, verdict or "allow"), u
    assert urlrep.judged(pages.limit(0), spark.createDataFrame([(1, 1)], "page_id long, bad int")).count() == 0


def test_reputation_shrinks_to_the_domain(spark):
    hosts = [("bad.one.net", 60, 57), ("bad.two.net", 1, 1), ("fine.three.net", 80, 2), ("new.one.net", 0, 0), *((f"h{i}.x.info", 30, 1) for i in range(20))]
    rows, labels, n = [], [], 0
    for h, k, b in hosts:
        for i in range(max(k, 1)):
            rows.append((n, f"http://{h}/p{i}"))
            if i < k:
                labels.append((n, int(i < b)))
            n += 1
    got = {r["host"]: r["verdict"] for r in urlrep.judged(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert got["bad.one.net"] == "block" and got["bad.two.net"] == "allow" and got["fine.three.net"] == "allow" and got["new.one.net"] == "block"
    d, s = urlrep.registered(F.col("h"))
    names = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk:80",), ("1.2.3.4",), ("org",), ("u@a.b.com",)], "h string").select(d.alias("d"), s.alias("s")).collect()
    assert [tuple(r) for r in names] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("1.2.3.4", ""), ("org", ""), ("b.com", "com")]


# 8 packing


@pytest.mark.parametrize("targets", [None, {"s0": 3.0, "s1": 1.0, "": 1.0}])
def test_pieces_cover_every_id_once(spark, docs, corpus, targets):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.packed(docs, sequence=64, window=512, targets=targets, with_ids=True).collect()
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert len(pieces) == len(corpus)
    for d, t, *_ in corpus:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        own, at = sorted(pieces[d], key=lambda r: r["start"]), 0
        for r in own:
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids"]) == (at, len(ids), part) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    last = max(seqs)
    assert sorted(seqs) == list(range(last + 1))
    for s, rs in seqs.items():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 64 or s == last and at <= 64


@pytest.mark.parametrize("targets", [None, {"s0": 3.0, "s1": 1.0, "s2": 0.5}])
def test_documents_are_sent_whole_in_the_order_of_the_round_robin(spark, targets):
    """Against a round-robin one document after another; a source of a thousandth of all tokens is one of the queues."""
    rng = np.random.default_rng(5)
    rows = [(f"d{i}", " ".join(["word"] * int(rng.integers(1, 300 if i % 50 else 5000))), f"s{i % 3 if i % 40 else 3}") for i in range(400)] + [("tiny", "x", "tiny"), ("none", None, "tiny")]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string").repartition(4)
    stored = packing.encoded(df, packing.tokenizer_path())
    found = packing.queues(stored, 2000, targets)
    windows = {r["source"]: r["windows"] for r in found.collect()}
    places = {r["doc_id"]: (r["place"], r["n"]) for r in packing.placed(stored, found).collect()}
    order = defaultdict(list)
    for r in sorted(stored.select("source", "part", "at", "doc_id", "n").collect()):
        order[r["source"]].append((r["doc_id"], r["n"]))
    want, at = {}, 0
    for s, k in brute.round_robin({s: [n for _, n in q] for s, q in order.items()}, windows):
        doc, n = order[s][k]
        want[doc] = (at, n)
        at += n
    assert places == want and max(windows.values()) > 10
    if targets is None:  # shares hold all along, within a document
        total, top = at, {s: sum(n for _, n in q) for s, q in order.items()}
        for s in ("s0", "s1", "s2"):
            half = sum(n for doc, n in order[s] if want[doc][0] < total / 2)
            assert abs(half - top[s] / 2) < 5000 + 2000
    else:  # the larger share is sent out first
        last = {s: max(want[d][0] for d, _ in q) for s, q in order.items()}
        assert last["s0"] < last["s1"] < last["s2"]


def test_ids_of_any_type_and_extra_columns(spark):
    df = spark.createDataFrame([("a", "x y", "s", 1, 2), (None, "z", None, 1, 2), ("a", "x y", "s", 1, 2)], "doc_id string, text string, source string, n int, place int")
    got = packing.packed(df).collect()
    assert sorted(r["doc_id"] or "" for r in got) == ["", "a", "a"] and sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got)
    big = spark.createDataFrame([((1 << 60) + 1, "x"), (None, "y")], "doc_id long, text string").withColumn("source", F.lit("s"))
    assert {r["doc_id"] for r in packing.packed(big).collect()} == {(1 << 60) + 1, None}


def test_encoder_equals_the_tokenizer_on_odd_texts():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    own = packing.encoder(packing.tokenizer_path())
    for t in ["a  b", " a", "a ", "a\nb", "a \nb", "a\n\nb", "it's  <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b c", "<|endoftext |> <|endoftex", "a\u00a0b c", "\n", "x\t y", "don't we're", "1,000 2.5", "é 𝒳 ß", "a\r\nb", "tab\tb c", "a\u2028 b", "  "]:
        assert np.frombuffer(own(t), own.kind).tolist() == tok.encode(t, add_special_tokens=False).ids + [0], repr(t)


def test_packing_edges(spark, docs):
    assert packing.packed(docs.limit(0)).count() == 0
    many = spark.createDataFrame([(i, f"w{i}", f"source{i}") for i in range(1030)], "doc_id long, text string, source string")
    got = packing.packed(many, sequence=64).agg(F.sum("length"), F.max("doc_tokens")).first()
    assert got[0] == many.count() * got[1] or got[0] > many.count()
    rows = packing.packed(many, sequence=64).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r["n"] != 64 for r in rows) <= 1


# 9 chat

CALL = '<tool_call>{"id": "%s", "name": "%s", "arguments": %s}</tool_call>'
RESULT = '<tool_result>{"id": "%s", "content": "ok"}</tool_result>'


def test_tool_calls_are_linked_and_ordered(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "let me " + CALL % ("a", "find", '{"q": "x", "n": 2}') + CALL % ("b", "open", '{"page": "$a"}')), (1, 2, "tool", RESULT % "a" + RESULT % "b"),
        (1, 3, "assistant", CALL % ("c", "open", '{"page": "$b", "again": "$a"}') + CALL % ("d", "find", '{"n": "two"}')), (1, 4, "tool", RESULT % "zz" + "<tool_result>not json</tool_result>"),
        (2, 0, "assistant", CALL % ("a", "x", '{"y": "$b"}') + CALL % ("b", "x", '{"y": "$a"}') + CALL % ("c", "x", '{"y": "$b"}')), (2, 1, "tool", RESULT % "a"), (3, 0, "user", None), (3, 0, "user", None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    schemas = {"find": {"q": ("string", True), "n": ("integer", False)}}
    every = toolchat.formatted(df, schemas).collect()
    got = {(r["conv_id"], r["kind"], r["call_id"]): r for r in every if r["kind"] != "message"}
    assert [got[1, "call", c]["depth"] for c in "abcd"] == [1, 3, 5, 1]
    assert [got[1, "result", c]["depth"] for c in "ab"] == [2, 4]
    assert [got[1, "call", c]["linked"] for c in "abcd"] == [True, True, False, False] and not got[1, "result", "zz"]["linked"]
    assert [got[1, "call", c]["valid"] for c in "abcd"] == [True, True, True, False] and not got[1, "result", None]["valid"]
    assert got[1, "call", "a"]["json"] == '{"arguments":{"n":2,"q":"x"},"id":"a","name":"find"}' and got[1, "result", None]["json"] == '"not json"'
    assert [got[2, "call", c]["depth"] for c in "abc"] == [None, None, None] and got[2, "result", "a"]["linked"]
    said = [r for r in every if r["kind"] == "message"]
    assert len(said) == len(rows) and {r["json"] for r in said if r["conv_id"] == 3} == {'{"content":"","role":"user"}'}
    assert next(r["json"] for r in said if (r["conv_id"], r["turn"]) == (1, 1)) == '{"content":"let me ","role":"assistant"}'
    assert toolchat.formatted(df.limit(0)).count() == 0


# 10 personal data

TEXTS = [
    None, "", "a@b.c_d@e.f", "x.y%z@h-1.co.uk, q@w", "1.2.3.4.5.6.7.8", "300.1.1.1 001.02.3.0255", "4111 1111 1111 1111", "4111-1111-1111-1112 4111 1111  1111 1111", "4111111111111111234", "+1 (988) 555-2485.", "+49 30 1", "++1 234 567 890",
    "é 𝒳 a@b.cd 𝒳 10.0.0.1", "7" * 40, "1 2 3 4 5 6 7 8 9 0 1 2 3", "a" * 20000 + "@", "9" * 20000, "a@b" * 3000, "+1" + "(" * 5000, "card 4111111111111111 tail 4111111111111111", "1.2.3.4@b.co", "+1.2.3.4.5.6.7.8.9",
]


def test_base_spans(spark, docs, corpus):
    rows = list(enumerate(TEXTS)) + [(100 + d, t) for d, t, *_ in corpus]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, spans string").repartition(4)
    got = pii.digest(pii.found(df)).collect()
    import hashlib

    for r in got:
        t = dict(rows)[r["doc_id"]]
        want = brute.pii(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (t or "")[:80]
        assert r["spans"].startswith(text) and [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]
    assert len(got) == len(rows) and pii.found(df.limit(0)).count() == 0


def test_added_spans_and_context(spark):
    t = ["account DE89 3704 0044 0532 0130 00 ok", "DE89370400440532013001", "ssn 123-45-6789", "code 123-45-6789", "password=b7db7aa4a5fcc78305 x", "mail a@b.co", "the a@b.co"]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id int, text string")
    got = {r["doc_id"]: [(s["kind"], t[r["doc_id"]][s["start"] : s["end"]], round(s["score"], 2)) for s in r["spans"]] for r in pii.found(df).collect()}
    assert got[0] == [("iban", "DE89 3704 0044 0532 0130 00", 1.0)] and got[1] == []
    assert got[2] == [("ssn", "123-45-6789", 0.7)] and got[3] == []
    assert got[4] == [("secret", "password=b7db7aa4a5fcc78305", 0.7)]
    assert got[5][0][2] == 1.0 and got[6][0][2] == 0.9
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert clean[5] == "mail <EMAIL>" and clean[0] == "account <IBAN> ok"


# 1 toxicity


def test_misspellings_share_their_ngrams(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("aeioulnrst"), 6))
    text = lambda bad: " ".join([word() for _ in range(20)] + ([bad] if bad else []) + [word() for _ in range(rng.integers(1, 200))])
    texts = [text(["worthless", "disgusting"][i % 2]) if i % 3 == 0 else text(None) for i in range(400)]
    labels = [int(i % 3 == 0) for i in range(400)]
    m = toxicity.fit(texts, labels)
    got = np.array(m.scorer().scores([text("worthlesss"), text("w0rthless"), text("disgustin"), text(None), text(None), "", None]))
    assert got[:3].min() > 5 * got[3:5].max() and (got[3:] < 0.5).all()
    df = spark.createDataFrame([(1, "x", "a"), (2, None, "a"), (None, "y", "a"), (1, "x", "a")], "doc_id long, text string, score string")
    rows = toxicity.scored(df, m).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: None if i is None else zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2, None)}
    assert toxicity.scored(df.limit(0), m).count() == 0


def test_labels_of_the_held_out_fold_are_never_read(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    ids = {r["doc_id"] for r in toxicity.sample(docs, labels).collect()}
    assert ids == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5}
    none = toxicity.fitted(docs, labels.limit(0))
    assert toxicity.rejected(docs, labels.limit(0)).count() == 100 and max(none.scorer().scores(["a", ""])) < 0.01


def test_scores_of_very_long_texts_read_all(spark):
    m = toxicity.Model(np.zeros(64, np.float32), -5.0)
    own = m.scorer()
    own["bad"] = 200.0
    for t in (" ".join(["fine"] * 300_000 + ["bad"]), "x" * (common.BLOCK + 5) + " bad"):
        assert own.scores([t])[0] > 0.5


# 5 language


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    T, L = 4, 3
    emit, trans, start = rng.random((1, T, L)) + 0.1, rng.random((L, L)) + 0.1, rng.random(L) + 0.1
    for n in range(1, T + 1):
        valid = np.arange(T)[None] < n
        node, edge, z = langid.forward_backward(emit, valid, trans, start)
        want, total, pairs = np.zeros((n, L)), 0.0, np.zeros((L, L))
        for y in itertools.product(range(L), repeat=n):
            p = start[y[0]] * np.prod([emit[0, t, y[t]] for t in range(n)]) * np.prod([trans[y[t - 1], y[t]] for t in range(1, n)])
            total += p
            for t in range(n):
                want[t, y[t]] += p
                if t:
                    pairs[y[t - 1], y[t]] += p
        assert np.allclose(node[0, :n], want / total) and np.allclose(edge, pairs / total) and np.isclose(z[0], np.log(total))


def test_languages(spark):
    rng = np.random.default_rng(3)
    vocab = {"aa": ["katha", "prosa", "melin", "torva"], "bb": ["xylo", "zefir", "quark", "wyrd"]}
    text = lambda g, n: " ".join(rng.choice(vocab[g], n))
    m = langid.fit([text(g, 30) for g in "ab" for g in [g * 2] for _ in range(40)], [g * 2 for g in "ab" for _ in range(40)])
    own = m.tagger()
    lang, score = own.predict([text("aa", 200), text("bb", 5), None, "", "12 34 %%", "kathas melins"])
    assert lang == ["aa", "bb", "und", "und", "und", "aa"] and all(0 <= s <= 1 for s in score) and score[2] == 0
    mixed = own.tag(" ".join([text("aa", 12), "42", text("bb", 12)]))
    assert [g for _, g in mixed] == ["aa"] * 12 + [None] + ["bb"] * 12
    df = spark.createDataFrame([(1, "katha", "aa"), (2, None, None), (None, "xylo", "bb"), (1, "katha", "aa")], "doc_id long, text string, lang_pred string")
    rows = langid.identified(df, m).collect()
    assert len(rows) == 4 and {r["lang_pred"] for r in rows if r["doc_id"] is None} == {"bb"}
    assert langid.identified(df.limit(0), m).count() == 0
    docs = spark.createDataFrame([(i, "katha", "aa" if i % 2 else None) for i in range(60)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in langid.sample(docs).collect()} == {i for i in range(60) if i % 2 and zlib.crc32(str(i).encode()) % 4 != 2}
    assert langid.identified(docs, langid.fitted(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
