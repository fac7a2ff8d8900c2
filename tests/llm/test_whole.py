"""Inputs on which operators once did less than the whole job."""

import random

import brute
import numpy as np
from pyspark.sql import functions as F

from lexfold.llm import common, decontam, grams, langid, linededup, packing, pii, simhash, toolchat, toxicity, urlrep


# 3 decontamination


def test_documents_that_begin_inside_an_item(spark):
    b = [f"b{i}" for i in range(30)]
    items = [(1, " ".join(b)), (2, "one two three")]
    texts = [" ".join(b[10:30]) + " and some more", " ".join(b[17:]), " ".join(b[18:]), "x " + " ".join(b[5:20]), " ".join(b[1:14]), "two three", " ".join(b[12:] + b)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.report(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == dict(enumerate(brute.contamination(texts, items)))
    assert got[0][1] == 20 and got[0][4] and got[1][4] and not got[2][4]


def test_passages_at_every_place_and_texts_of_one_word(spark):
    """Passages from word 0, 1 and 12 and up to the last word, short items, and a text with an alignment at each of its words."""
    b = [f"b{i}" for i in range(40)]
    items = [(1, " ".join(b)), (2, "one two three"), (3, "the " * 15), (4, "the " * 4 + "end"), (None, " ".join(b[5:25]))]
    pad = lambda n: [f"p{i}" for i in range(n)]
    texts = [" ".join(pad(k) + b[s : s + n] + pad(e)) for k in (0, 1, 12) for s in (0, 1, 12, 20) for n in (12, 13, 20) for e in (0, 1, 300)]
    texts += ["the " * 3000, "the " * 14, "the " * 15 + "x " + "the " * 20 + "end", "one two three", "x one two three", "one two x three", "three one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["contaminated"]) for r in decontam.report(df, spark.createDataFrame(items, "item_id int, text string")).collect()}
    want = brute.contamination(texts, items)
    assert got == {i: (w[0], w[1], w[4]) for i, w in enumerate(want)} and sum(w[4] for w in want) > 50


# near duplicates in the pipeline


def test_near_copies_of_one_text_meet_in_few_pairs(spark, monkeypatch):
    """Copies of one text with 0 to 6 words changed: links as by brute force; besides centres no more pairs meet than there are copies."""
    rng, rows, met, n = random.Random(9), [], [], 320
    base = [f"t{rng.randrange(10**6)}" for _ in range(150)]
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(5, 145), i % 7):
            w[at] = f"new{rng.randrange(10**8)}"
        rows.append((i, " ".join(w)))
    verified = simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, *a: met.append(pairs.distinct().count()) or verified(pairs, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in simhash.groups(df).collect()} == brute.similar(rows)
    assert len(met) == 2 and met[1] <= n


def test_rows_of_hot_keys_are_joined_once(spark):
    """A key of nine in ten rows, others, one without a partner and null: as by a plain join, and the others pass no anti join."""
    left = spark.range(3000).selectExpr("CASE WHEN id % 10 > 0 THEN 7 WHEN id % 100 > 0 THEN id + 100000 WHEN id % 200 > 0 THEN null ELSE -1 END AS k", "id")
    right = common.materialise(left.where("k >= 0").groupBy("k").agg(F.count("*").alias("n")), "test-counts")
    for how in ("inner", "left"):
        got = common.joined(left, right, "k", how)
        assert sorted(got.collect(), key=lambda r: r["id"]) == sorted(left.join(right, "k", how).collect(), key=lambda r: r["id"])
        assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_near_copies_are_one_document(spark):
    """Copies with words changed, a few far beyond two bits; and more of them than a list may hold."""
    import corpus_pipeline

    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for g, size in enumerate([1, 2, 3, 60]):
        base = text(200)
        for k in range(size):
            w = list(base)
            for at in rng.sample(range(200), 3 if k else 0):
                w[at] = f"new{rng.randrange(10**6)}"
            rows.append((100 * g + k, " ".join(w)))
    far = text(60)
    rows += [(900, " ".join(far)), (901, " ".join(far[:45] + text(15))), (902, None), (903, ""), (None, rows[0][1]), (904, "two words"), (905, "Two  WORDS")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"]: r["text"] or "" for r in corpus_pipeline.near_duplicates(spark, df, "").collect() if r["doc_id"] is not None}
    assert {0, 100, 200, 300, 900, 901, 902, 904} <= set(kept) and not {101, 201, 202, 903, 905} & set(kept)
    assert all(brute.jaccard(kept[i], kept[j]) < 0.8 for i in kept for j in kept if i < j)
    assert len(kept) <= 12
    again = simhash.keep_first(df.union(df))
    assert sorted(r["doc_id"] for r in again.where("doc_id is not null").collect()) == sorted(kept) and simhash.keep_first(df.limit(0)).count() == 0


# 1 toxicity, 5 language


def test_all_of_an_unspaced_text_is_read():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("aeioulnrst"), 6))
    text = lambda bad, sep=" ": sep.join([word() for _ in range(30)] + ([bad] if bad else []) + [word() for _ in range(30)])
    m = toxicity.fit([text("worthless" if i % 3 == 0 else None) for i in range(300)], [int(i % 3 == 0) for i in range(300)])
    bad, good = m.scorer().scores([text("worthless" * 3, ""), text(None, "")])
    assert bad > 3 * good
    assert all(any(w[i : i + 5] in p for p in grams.pieces([w])) for w in ["".join(rng.choice(list("abc"), 500))] for i in range(496))
    assert grams.pieces(["short", "." * 60 + "ab"]) == ["short", "." * 60 + "ab"]


def test_letters_and_ngrams_beyond_forty_characters_count():
    rng = np.random.default_rng(3)
    vocab = {"aa": ["katha", "prosa", "melin", "torva"], "bb": ["xylo", "zefir", "quark", "wyrd"]}
    text = lambda g, n, sep=" ": sep.join(rng.choice(vocab[g], n))
    own = langid.fit([text(g, 30) for g in vocab for _ in range(40)], [g for g in vocab for _ in range(40)]).tagger()
    long = "1" * 40 + text("bb", 200, "")
    lang, score = own.predict([long, "1" * 40 + text("aa", 200, ""), "1" * 90, "katha " + text("aa", 3)])
    assert lang == ["bb", "aa", "und", "aa"] and score[0] > 0.5
    assert [g for _, g in own.tag("katha " + "1" * 90 + " " + long)][1:] == [None, "bb"]


def test_more_languages_than_three_hundred(spark):
    rows = [(i, f"w{i}a w{i}b w{i}c " * 3, f"l{i:03}") for i in range(310)] + [(1000, "long " * 5000, "only long texts"), (None, "x", "l000"), (1001, " ", "blank")]
    known = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fold=False).collect()
    assert {r["lang"] for r in known} == {g for i, _, g in rows if i is not None and g != "blank"} and max(len(r["text"]) for r in known) <= langid.SAMPLE_CHARS
    m = langid.fit([r["text"] for r in known], [r["lang"] for r in known], epochs=1)
    assert len(m.labels) == 311 and m.weight.shape[1] == 311


def test_bounded_steps_are_one_step(monkeypatch):
    """The fit's sums do not depend on how many chains a step holds."""
    texts, langs = [f"{w}{i} {w}x {w}y" * 4 for w in ("ka", "zo", "mi") for i in range(30)], [g for g in "abc" for _ in range(30)]
    one = langid.fit(texts, langs, epochs=5)
    monkeypatch.setattr(langid, "STEP", 32 * 3 * 7)
    parts = langid.fit(texts, langs, epochs=5)
    a, b = (m.tagger().predict(["ka7 kax", "zo1 zoy mi2", "mi3 miy mix"]) for m in (one, parts))
    assert a[0] == b[0] == ["a", "b", "c"] and np.allclose(a[1], b[1], atol=0.02)


def test_toxicity_learns_from_long_texts_where_there_are_no_others(spark):
    docs = spark.createDataFrame([(i, ("worthless " if i % 2 else "fine ") * 4000) for i in range(20)] + [(30, "short"), (31, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(30, 0), (31, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.sample(docs, labels, fold=None).collect()}
    assert set(got) == {*range(20), 30} and max(len(r["text"]) for r in got.values()) == toxicity.SAMPLE_CHARS


# 7 URLs


def test_repeated_pages_add_no_evidence(spark):
    """A page once or in many rows: the outcomes of its id count once for its host."""
    rows = [(i, f"http://h{i % 4}.net/{i}") for i in range(40)]
    out = [(i, int(i % 4 == 0)) for i in range(40)]
    outcomes = spark.createDataFrame(out, "page_id long, bad int")
    once = urlrep.judged(spark.createDataFrame(rows, "page_id long, url string"), outcomes)
    many = urlrep.judged(spark.createDataFrame(rows + rows[:1] * 500, "page_id long, url string"), outcomes)
    assert {r["host"]: r["verdict"] for r in once.collect()} == {r["host"]: r["verdict"] for r in many.collect()} and many.count() == 540


# 8 packing


def test_each_of_many_sources_has_its_own_queue(spark):
    n, k = 1324, 3
    many = spark.createDataFrame([(i, " ".join(f"w{i % n}" for _ in range(12)), f"source{i % n}") for i in range(n * k)], "doc_id long, text string, source string").repartition(4)
    places = lambda **more: {r["doc_id"]: r for r in packing.packed(many, sequence=64, **more).withColumn("at", F.col("sequence_id") * 64 + F.col("offset")).groupBy("doc_id").agg(F.min("at").alias("a"), F.max(F.col("at") + F.col("length")).alias("b"), F.sum("length").alias("n")).collect()}
    total = sum(r["n"] for r in places().values())
    got = places(window=-(-total // 3))
    assert len(got) == n * k and sum(r["n"] for r in got.values()) == total and all(r["b"] - r["a"] == r["n"] for r in got.values())  # sent whole
    firsts = sorted(r["a"] for r in got.values())
    assert all(firsts[n * i] <= x < (firsts[n * (i + 1)] if i < 2 else total) for s in range(0, n, 50) for i, x in enumerate(sorted(got[s + n * j]["a"] for j in range(k))))  # one of every source in each window
    aimed = places(targets={"source7": 1.0}, window=4096)
    assert max(aimed[7 + n * j]["b"] for j in range(k)) <= 4096 and sum(r["n"] for r in aimed.values()) == total


# 9 chat


def test_long_chains_of_calls_are_ordered(spark):
    call = lambda c, *needs: '<tool_call>{"id": "%s", "name": "f", "arguments": {"x": [%s]}}</tool_call>' % (c, ", ".join(f'"${n}"' for n in needs))
    n = 1100
    rows = [(1, i, "assistant", call(f"c{i}", *([f"c{i - 1}"] if i else []))) for i in range(n)]
    # two calls needed by one, over ways of different lengths; a cycle and what hangs on it
    rows += [(2, 0, "a", call("a") + call("b", "a") + call("c", "b") + call("d", "a", "c") + call("e", "d", "gone")), (2, 1, "a", call("x", "y") + call("y", "z") + call("z", "x") + call("v", "z") + call("u", "v", "a") + call("t", "t"))]
    rows += [(1, n, "tool", '<tool_result>{"id": "c%d", "content": "ok"}</tool_result>' % (n - 1))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["kind"], r["call_id"]): r["depth"] for r in toolchat.formatted(df).where("kind <> 'message'").collect()}
    assert [got[1, "call", f"c{i}"] for i in range(n)] == list(range(1, 2 * n, 2)) and got[1, "result", f"c{n - 1}"] == 2 * n
    assert [got[2, "call", c] for c in "abcdexyzvut"] == [1, 3, 5, 7, 9] + [None] * 6


def test_arguments_are_validated_against_declared_schemas(spark):
    call = lambda c, args, name="find": '<tool_call>{"id": "%s", "name": "%s", "arguments": %s}</tool_call>' % (c, name, args)
    shape = '<tool_schema>{"name": "find", "parameters": {"q": {"type": "string", "required": true}, "n": {"type": "integer"}, "any": {"type": "thing"}}}</tool_schema>'
    calls = [("a", '{"q": "x"}', True), ("b", '{"q": "x", "n": 3, "any": [1]}', True), ("c", '{"n": 3}', False), ("d", '{"q": 1}', False), ("e", '{"q": "x", "n": "3"}', False), ("f", '{"q": "x", "more": 1}', False), ("g", "[1]", False), ("h", "{}", False)]
    rows = [(1, 0, "system", "tools: " + shape + '<tool_schema>{"name": "find", "parameters": {}}</tool_schema><tool_schema>{"parameters": 3}</tool_schema>'), (1, 1, "assistant", "".join(call(c, x) for c, x, _ in calls) + call("z", '{"w": 1}', "other")), (2, 0, "assistant", call("c", '{"n": 3}'))]
    got = toolchat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["call_id"]: r["valid"] for r in got if (r["conv_id"], r["kind"]) == (1, "call")} == {**{c: ok for c, _, ok in calls}, "z": True}
    assert [r["valid"] for r in got if (r["conv_id"], r["kind"]) == (2, "call")] == [True]
    assert [r["valid"] for r in sorted((r for r in got if r["kind"] == "schema"), key=lambda r: r["part"])] == [True, True, False]
    assert next(r["json"] for r in got if r["kind"] == "message" and (r["conv_id"], r["turn"]) == (1, 0)) == '{"content":"tools: ","role":"system"}'


# 10 personal data


def test_long_secrets_are_found_whole(spark):
    t = ["access_token=" + "eyJhbGci." * 40 + " after", "token: " + "x" * 20000]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id int, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.found(df).collect()}
    assert got == {0: [("secret", 0, 13 + 360)], 1: [("secret", 0, 7 + 20000)]}
    assert {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()} == {0: "<SECRET> after", 1: "<SECRET>"}


def test_assigned_secrets(spark):
    t = ['token = "b44e15e09fd311c3cf31"!! x', "API_KEY:\t'k3y-k3y-k3y'", "a token of my esteem", "the token = x", '{"password": "pa55w0rd!"}']
    got = {r["doc_id"]: [t[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "secret"] for r in pii.found(spark.createDataFrame(list(enumerate(t)), "doc_id int, text string")).collect()}
    assert got == {0: ['token = "b44e15e09fd311c3cf31"!!'], 1: ["API_KEY:\t'k3y-k3y-k3y'"], 2: [], 3: [], 4: ['password": "pa55w0rd!"}']}


def test_a_hundred_thousand_matches_in_a_text(spark):
    import time

    rng = random.Random(2)
    unit = ["mail a@b.co", "4111 1111 1111 1111", "10.0.0.1", "call +1 (988) 555-2485", "é𝒳", "ssn 123-45-6789;"]
    text = " ".join(rng.choice(unit) for _ in range(170_000))
    df = spark.createDataFrame([(1, text), (2, "x"), (3, text[:5000])], "doc_id int, text string")
    began = time.time()
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.found(df).collect()}
    assert len(got[1]) > 100_000 and time.time() - began < 60
    for d, t in ((1, text), (3, text[:5000])):
        assert [x for x in got[d] if x[0] != "ssn"] == brute.pii(t) and all(t[a:b] == "123-45-6789" for k, a, b in got[d] if k == "ssn")
    assert sum(k == "ssn" for k, *_ in got[1]) == text.count("ssn ")
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert clean[2] == "x" and "@" not in clean[1] and clean[1].count("<EMAIL>") == text.count("a@b.co") and clean[1].count("<SSN>") == text.count("ssn ")


# 6 line dedup


def test_pages_of_boilerplate_alone_are_emptied_in_the_pipeline(spark):
    import corpus_pipeline

    menu = ["home", "cookie notice", "footer", "imprint"]
    rows = [(i, "\n".join([*menu, f"own words {i}"]), "s") for i in range(5)] + [(10 + i, "\n".join(menu[i:]), "s") for i in range(4)] + [(20, None, "s"), (21, "home", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = linededup.stripped(df.withColumns({"__host": F.lit("x"), "drop": F.lit(1), "kept": F.lit(2), "__n_dropped": F.lit("s")}), spare=False)
    assert clash.columns == ["doc_id", "text", "source", "__host", "drop", "kept", "__n_lines", "__n_dropped"] and clash.where("__host = 'x' and kept = 2").count() == len(rows)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.boilerplate(spark, df, "").collect()}
    assert got == {**{i: f"own words {i}" for i in range(5)}, **{10 + i: "" for i in range(4)}, 20: None, 21: "home"}


def test_public_suffixes_by_rules(spark):
    rules = ("com", "uk", "co.uk", "*.ck", "!www.ck", "a.b.example", "*.deep.example")
    want = {"x.com": ("x.com", "com"), "a.x.com": ("x.com", "com"), "y.co.uk": ("y.co.uk", "co.uk"), "z.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", ""), "q.any.ck": ("q.any.ck", "any.ck"), "p.q.any.ck": ("q.any.ck", "any.ck"), "any.ck": ("any.ck", ""), "www.ck": ("www.ck", "ck"), "m.www.ck": ("www.ck", "ck"), "s.a.b.example": ("s.a.b.example", "a.b.example"), "s.t.deep.example": ("s.t.deep.example", "t.deep.example"), "plain": ("plain", ""), "10.0.0.1": ("10.0.0.1", ""), "": ("", "")}
    domain, suffix = urlrep.registered(F.col("h"), rules)
    got = spark.createDataFrame([(h,) for h in want], "h string").select("h", domain.alias("d"), suffix.alias("s")).collect()
    assert {r["h"]: (r["d"], r["s"]) for r in got} == want


def test_hosts_learn_from_their_registered_domain_as_rules_say(spark):
    """Blog hosts of one platform: with it as a suffix each is judged by itself, without it all of them together."""
    pages = [(i, f"http://u{i % 40}.blogs.example/{i}") for i in range(800)] + [(1000, "http://new.blogs.example/1")]
    bad = [(i, 1) for i in range(800)]
    judge = lambda rules: {r["page_id"]: r["verdict"] for r in urlrep.judged(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([*bad], "page_id long, bad int"), rules=(), suffixes=rules).collect()}[1000]
    assert judge(()) == "block"
    mixed = [(i, int(i % 2)) for i in range(800)]
    bad[:] = mixed
    assert judge(("blogs.example",)) == "allow"


def test_near_copies_on_one_template_are_found(spark):
    """Lists of many texts that are unlike but for a template: the pairs among them are still linked, nothing else is."""
    rng, n = random.Random(3), 250
    template, rows = [f"t{rng.randrange(10**6)}" for _ in range(200)], []
    for k in range(n):
        own = [f"w{rng.randrange(10**7)}" for _ in range(65)]
        again = [*own[:44], *(f"v{rng.randrange(10**7)}" for _ in range(21))]  # similarity 0.825
        rows += [(2 * k, " ".join(own + template)), (2 * k + 1, " ".join(again + template))]
    assert brute.jaccard(rows[0][1], rows[1][1]) >= 0.8 > 0.7 > brute.jaccard(rows[0][1], rows[2][1])
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[2 * k] == 2 * k for k in range(n)) and sum(got[2 * k + 1] != 2 * k for k in range(n)) <= 1


def test_no_pair_of_the_least_similarity_is_left_out(spark):
    """Pairs of 80 shingles in common of 100, and of 79: all of the first are linked and none of the others, alone and among 60 near copies."""
    rng, rows, want = random.Random(7), [], {}
    text = lambda n: [f"w{rng.randrange(10**8)}" for _ in range(n)]
    for k in range(400):
        words = text(94)
        cut = 84 if k % 4 else 83
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:cut] + text(94 - cut)))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k + (0 if k % 4 else 1)}
    base = text(94)
    for i in range(60):  # 10 of them, with 19 shingles of their own, are like none
        rows.append((1000 + i, " ".join(base[: 94 - (i % 8 if i < 50 else 19)] + text(i % 8 if i < 50 else 19))))
        want[1000 + i] = 1000 if i < 50 else 1000 + i
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want and brute.jaccard(rows[2][1], rows[3][1]) == 0.8 > brute.jaccard(rows[0][1], rows[1][1]) and want == brute.similar(rows[790:]) | {i: want[i] for i, _ in rows[:790]}
