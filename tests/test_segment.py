"""Segmentation against a sequential pass, and the quirks that the windows must keep."""

import random

import pytest
from pyspark.sql import functions as F

from lexfold import schemas
from lexfold.operators import segment as S

def lines(spark, texts, **kw):
    rows = []
    for i, t in enumerate(texts):
        t = t if isinstance(t, dict) else {"text": t}
        rows.append(("d", i, t["text"], t.get("page", 1), t.get("top"), t.get("bottom"), t.get("height"), t.get("bold", False), None))
    return spark.createDataFrame(rows, schemas.RAW_LINE)


def texts(df, order="block_no"):
    return [r["text"] for r in df.orderBy(order).collect()]


def test_flags(spark):
    t = ["DEFINITIONS", "1. Grant", "1.Grant", "1.1 Grant", "1.5 million", "(i)Affiliate", "U.S. dollars", "(xl) X", "Section 2.3. X", "plain text", "WHOLE LINE, IN CAPITALS"]
    got = {r["text"]: r for r in S.flagged(lines(spark, t)).collect()}
    assert [x for x in t if got[x]["is_header"]] == ["DEFINITIONS", "WHOLE LINE, IN CAPITALS"]
    assert [x for x in t if got[x]["is_top"]] == ["1. Grant", "1.Grant"]
    assert [x for x in t if got[x]["is_decimal"]] == ["1.1 Grant", "1.5 million", "Section 2.3. X"]
    assert [x for x in t if got[x]["is_subpart"]] == ["(i)Affiliate", "U.S. dollars"]


def test_blocks_break_at_pages_gaps_headers_and_sealed_lines(spark):
    g = lambda text, top, page=1, **k: {"text": text, "top": top, "bottom": top + 10.0, "height": 10.0, "page": page, **k}
    got = S.blocks(lines(spark, [g("a", 0.0), g("b", 25.0), g("c", 50.1), g("RECITALS", 61.0), g("d", 72.0), g("e", 0.0, 2), g("(a) f", 11.0, 2), g("g", 22.0, 2)]))
    assert texts(got) == ["a b", "c", "RECITALS", "d", "e", "(a) f g"]  # a gap of exactly 1.5 heights does not break


def test_bold_capitals_are_headers(spark):
    got = S.flagged(lines(spark, [{"text": "FEES!", "bold": True}, {"text": "FEES!"}, {"text": "Fees", "bold": True}]))
    assert [r["is_header"] for r in got.orderBy("line_no").collect()] == [True, False, False]


def fold(blocks):
    """The sequential pass: a block absorbs the next while that is not of its own and it has not ended."""
    out, i = [], 0
    while i < len(blocks):
        text, own, closed = blocks[i]["text"], blocks[i]["own"], blocks[i]["closed"]
        i += 1
        if not closed:
            while i < len(blocks) and not blocks[i]["own"] and not text.rstrip().endswith((".", ";", ":")):
                text += " " + blocks[i]["text"]
                i += 1
        out.append(text)
    return out


def test_merge_equals_the_sequential_pass(spark):
    random.seed(5)
    kinds = {"end.": (False, False), "go on": (False, False), "(a) part": (True, True), "1. top": (True, False), "DEFINITIONS": (True, True), "2.1 dec;": (True, True), "A. letter": (True, True)}
    for _ in range(6):
        seq = [random.choice(list(kinds)) for _ in range(60)]
        rows = [("d", i, t, 1, None, None, t == "DEFINITIONS", t in ("(a) part", "A. letter"), t == "2.1 dec;", False) for i, t in enumerate(seq)]
        df = spark.createDataFrame(rows, "source_file string, block_no int, text string, page int, top double, bottom double, is_header boolean, is_subpart boolean, is_decimal boolean, bold boolean")
        assert texts(S.merged(df)) == fold([{"text": t, "own": kinds[t][0], "closed": kinds[t][1]} for t in seq])


def test_split_and_enrichment(spark):
    long = "one two three four five six seven eight nine ten"
    got = S.clauses(lines(spark, ["RECITALS", f"{long}. (a) {long}; (b) {long}.", "Page 3", "short one.", f"1. {long} the parties."])).orderBy("clause_id").collect()
    assert [r["subpart_label"] for r in got] == [None, "(a)", "(b)", None]
    assert [r["parent_clause_id"] for r in got] == [None, 1, 1, None]
    assert {r["section_header"] for r in got} == {"RECITALS"} and got[3]["party_refs"] == ["the parties"]
    assert [r["position"] for r in got] == ["middle", "middle", "late", "late"]


def test_positions_count_dropped_blocks(spark):
    long = "one two three four five six seven eight nine ten."
    page = lambda n, text: {"text": text, "page": n}
    got = S.clauses(lines(spark, [page(1, long), page(2, "Page 3."), page(3, "short one."), page(4, "[x]."), page(5, long)])).orderBy("clause_id").collect()
    assert [r["position"] for r in got] == ["early", "middle"]


def test_boilerplate_quirk_and_noise(spark):
    t = ["Title to the goods passes", "Page 3 of 12", "— 4 —", "xiv", "[end]", "A clause", "Source: X", "My file-1.pdf"]
    df = spark.createDataFrame([(x,) for x in t], "text string")
    assert [r["text"] for r in df.where(~S.is_boilerplate(F.col("text"))).collect()] == ["A clause"]
    assert [r["text"] for r in df.where(~S.is_noise(F.col("text"), 5)).collect()] == ["Title to the goods passes", "Page 3 of 12", "— 4 —", "[end]", "A clause", "My file-1.pdf"]


def test_older_versions(spark):
    t = ["1.Grant of things", "goes on", "(a) part"]
    assert len(texts(S.blocks(lines(spark, t), S.Rules.older(1)), "block_no")) == 1
    assert len(texts(S.blocks(lines(spark, ["a", "1. Grant", "b"]), S.Rules.older(2)))) == 2
    with pytest.raises(ValueError):
        S.Rules.older(3)


def test_empty_input(spark):
    assert S.clauses(spark.createDataFrame([], schemas.RAW_LINE)).count() == 0


def test_documents_and_paragraphs(spark):
    c = S.clauses(lines(spark, ["one two three four five six seven eight nine ten."]))
    row = S.documents(c).first()
    assert row["clause_count"] == 1 and row["clauses"][0]["clause_id"] == 1
    p = spark.createDataFrame([(1, "a\nb\r\n\r\n\nc\n\n  \n\nd")], "id int, text string")
    assert [r["paragraph"] for r in S.paragraphs(p).orderBy("paragraph_no").collect()] == ["a b", "c", "d"]


def test_enrichment_of_a_written_contract(spark):
    """Labels, references, counts and parents of clauses as they stand in a contract."""
    long = "shall pay all sums that are due within thirty days"
    t = ["DEFINITIONS", f"1. The Licensee {long}.", f"1.1 Each party {long}.", f"(ii) Neither {long}.", "GRANT OF RIGHTS", f"RIGHTS GRANTED: Licensor {long}.", f"Section 2.3. Both parties {long}."]
    got = S.clauses(lines(spark, t)).orderBy("clause_id").collect()
    assert [r["section_header"] for r in got] == ["DEFINITIONS"] * 3 + ["GRANT OF RIGHTS"] * 2
    assert [r["subpart_label"] for r in got] == [None, "1.1", "(ii)", None, "2.3."]
    assert [r["parent_clause_id"] for r in got] == [None, 1, 1, None, 4]
    assert [r["parent_clause_header"] for r in got] == [None, "DEFINITIONS", "DEFINITIONS", None, "GRANT OF RIGHTS"]
    assert [r["inline_label"] for r in got] == [None, None, None, "RIGHTS GRANTED", None]
    assert [r["party_refs"] for r in got] == [["licensee"], ["each party"], [], ["licensor"], ["both parties"]]
    assert [r["token_count"] for r in got] == [len(x.split()) for x in t if x.split()[-1].endswith(".")]


def test_scans_equal_windows(spark, monkeypatch):
    """Sums, last values, lags and totals, with nulls, over ranges that cut the groups."""
    from lexfold.operators import order
    from lexfold.operators.order import lag, last, medians, scanned, total, whole, windowed

    ranges, stored = [], order.stored
    monkeypatch.setattr(order, "stored", lambda df, tag: ranges.append(got := stored(df, tag)) or got)

    rng = random.Random(9)
    rows = [(g, i, rng.choice([None, rng.randrange(100)]), rng.choice([None, "a", "b"])) for g, n in (("long", 3000), ("b", 7), (None, 40), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, v int, s string").repartition(5)
    scans = {"upto": total(F.col("v")), "before": total(F.col("v"), before=True), "n": total(F.lit(1)), "l": last(F.col("s")), "lb": last(F.col("v"), before=True), "p": lag(F.col("s")), "w": whole(F.col("v"))}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scanned(df, "g", ["i"], **scans)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, windowed(df, "g", ["i"], **scans).collect()), key=repr)
        assert got.columns == [*df.columns, *scans]
        assert ranges[0].where("g = 'long'").groupBy("__part").count().agg(F.max("count")).first()[0] < 2000  # of 3000: no range has the group
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m")).collect() if r["m"] is not None}
    assert {r["g"]: r["median"] for r in medians(df, "g", F.col("v")).collect()} == want


def test_long_documents_are_cut_like_short_ones(spark):
    rng = random.Random(4)
    words = "one two three four five six seven eight nine ten".split()
    kinds = [lambda: "DEFINITIONS", lambda: "(a) " + " ".join(words), lambda: "1.1 " + " ".join(words) + ";", lambda: "2. " + " ".join(words), lambda: " ".join(words) + ".", lambda: " ".join(words[:6]), lambda: "Page 3"]
    rows = []
    for d, n in (("long", 1500), ("b", 40), ("c", 1)):
        top = 0.0
        for i in range(n):
            h = rng.choice([9.0, 10.0, 12.0, 1.0, None])
            top += rng.choice([11.0, 12.0, 40.0])
            rows.append((d, i, rng.choice(kinds)(), 1 + i // 50, top, top + (h or 10.0), h, rng.random() < 0.1, None))
    df = spark.createDataFrame(rows, schemas.RAW_LINE).repartition(4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        short, long = (sorted(map(tuple, S.clauses(df, long=x).collect()), key=repr) for x in (False, True))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert short == long and len(short) > 300
