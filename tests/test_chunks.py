"""Scans by chunks: right where chunks cut groups, and few passes over the text."""

import random

from lexfold import schemas
from lexfold.operators import order
from lexfold.operators import segment as S


def _lines(spark):
    rng = random.Random(5)
    words = "one two three four five six seven eight nine ten".split()
    kinds = [lambda: "DEFINITIONS", lambda: "(a) " + " ".join(words), lambda: "1.1 " + " ".join(words) + ";", lambda: " ".join(words) + ".", lambda: " ".join(words[:6]), lambda: "Page 3"]
    rows = []
    for d, n in (("long", 400), ("b", 9), (None, 20), ("c", 1)):
        for i in range(n):
            top = 12.0 * i + rng.choice([0, 0, 30])
            rows.append((d, i, rng.choice(kinds)(), 1 + i // 50, top, top + 10, rng.choice([9.0, 12.0, 1.0, None]), rng.random() < 0.1, None))
    return spark.createDataFrame(rows, schemas.RAW_LINE).repartition(3)


def test_clauses_by_chunks_move_the_text_few_times(spark, monkeypatch):
    tables = []
    for module in (order, S):
        was = getattr(module, "stored", None)
        monkeypatch.setattr(module, "stored", lambda df, tag, was=was: tables.append(df.columns) or was(df, tag), raising=False)
    monkeypatch.setattr(order, "CHUNK", 7, raising=False)
    df = _lines(spark).where("source_file is not null")
    got = sorted(map(tuple, S.clauses(df, long=True).collect()), key=repr)
    assert sum("text" in c for c in tables) == 3
    assert got == sorted(map(tuple, S.clauses(df).collect()), key=repr) and len(got) > 100


def test_chunked_scans_equal_windows(spark, monkeypatch):
    monkeypatch.setattr(order, "CHUNK", 7)
    df = _lines(spark).select("source_file", "line_no", "text", "height")
    F = S.F
    scans = {"upto": order.total(F.col("line_no")), "before": order.total(F.col("line_no"), before=True), "l": order.last(F.when(F.col("text") == "DEFINITIONS", F.col("line_no"))), "lb": order.last(F.col("height"), before=True), "p": order.lag(F.col("height")), "w": order.whole(F.col("line_no"))}
    got = order.chunked(order.cut(df, "source_file", ["line_no"]), "source_file", ["line_no"], **scans).drop("__by", "__part")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, order.windowed(df, "source_file", ["line_no"], **scans).collect()), key=repr)
    assert got.columns == [*df.columns, *scans]


def test_bold_headings_by_a_pattern(spark):
    rows = [(t, b) for t in ("A B C D E F 7", " A  B C D E F 7 ", "A B C D E F G 8", "A", "1 2", "Ab C", "", "A B C D E F G H") for b in (True, False)]
    df = spark.createDataFrame(rows, "text string, bold boolean").withColumn("is", S.is_header(S.F.col("text"), S.F.col("bold"), S.Rules(header="^$a")))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r["text"] for r in df.where("is").collect()} == {t for t, b in rows if b and t.strip() and t.strip().upper() == t.strip() and any("A" <= c <= "Z" for c in t) and len(t.split()) <= 7}
