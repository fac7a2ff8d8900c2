"""Readers, writers and streams on files."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lexfold import schemas
from lexfold.operators import segment
from lexfold.sources import readers, writers
from lexfold.streaming import annotate_stream, chat_sessions, clause_stream


def test_jsonl(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"clause_text": "x", "clause_type": "t", "risk_level": "High"}\n\nnot json\n{"clause_text": "y"}\n')
    assert readers.jsonl(spark, str(f), schemas.CONTRACT_CSV).count() == 2
    good, bad = readers.jsonl_tolerant(spark, str(f), schemas.CONTRACT_CSV)
    assert sorted((r["_lineno"], r["clause_text"]) for r in good.collect()) == [(1, "x"), (4, "y")]
    assert [(r["_lineno"], r["line"]) for r in bad.collect()] == [(3, "not json")]
    assert readers.splits(spark, schemas.CONTRACT_CSV, train=str(f), val=str(f)).groupBy("split").count().count() == 2


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """A file that is read in many splits, and a second one; line ends of two kinds."""
    lines = ['{"n": %d}' % i if i % 9 else ["", "bad", "  "][i % 3] for i in range(1, 3000)]
    (tmp_path / "a.jsonl").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "b.jsonl").write_text('{"n": 7}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        good, bad = readers.jsonl_tolerant(spark, str(tmp_path / "*.jsonl"), "n int")
        got = [(r["_file"][-7], r["_lineno"], r["n"]) for r in good.collect()]
        assert sorted(got) == sorted([("a", i, i) for i in range(1, 3000) if i % 9] + [("b", 1, 7)])
        assert {r["_lineno"] for r in bad.collect()} == {i for i in range(1, 3000) if lines[i - 1] == "bad"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_retrieval_is_off_without_its_dataset(spark, tmp_path):
    with pytest.warns(UserWarning, match="retrieval is off"):
        assert readers.index_or_build(spark, str(tmp_path / "i"), lambda: 1 / 0, str(tmp_path / "none")) is None


def test_json_array_csv_and_texts(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"clause_text": "x"}, {"clause_text": "y"}]')
    assert readers.json_array(spark, str(tmp_path / "a.json"), schemas.CONTRACT_CSV).count() == 2
    (tmp_path / "a.csv").write_text('clause_text,clause_type,risk_level\n"a ""q""\nb",Exclusivity,HIGH\n')
    assert readers.contract_csv(spark, str(tmp_path / "a.csv")).first()["clause_text"] == 'a "q"\nb'
    (tmp_path / "a.txt").write_text("short\n\nthis piece is\nlong enough to keep\r\n\r\nanother piece of enough length\n")
    got = readers.blank_line_files(spark, str(tmp_path / "a.txt")).orderBy("clause_index").collect()
    assert [(r["clause_index"], r["clause_text"]) for r in got] == [(1, "this piece is long enough to keep"), (2, "another piece of enough length")]


def test_pdf_failures_are_rows(spark, tmp_path):
    for name, data in (("a.pdf", b"ok"), ("b.pdf", b"bad"), ("c.txt", b"ok")):
        (tmp_path / name).write_bytes(data)

    def reader(content):
        if content == b"bad":
            raise ValueError("broken")
        return [{"text": "one two three four five six seven eight nine ten.", "page": 1, "top": 0.0, "bottom": 9.0, "height": 9.0, "bold": False, "size": 8.0}]

    lines, failures = readers.pdf_lines(spark, str(tmp_path), reader)
    assert [tuple(r) for r in failures.collect()] == [("b.pdf", "broken")]
    assert segment.clauses(lines).count() == 1 and readers.bulk_text(lines).count() == 1


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, "two", None), ("b", 1, "one", 3), ("a", 1, "x", 1)], "source_file string, clause_id int, text string, page int")
    out = str(tmp_path / "o")
    writers.jsonl(rows.withColumn("_tmp", F.lit(1)), out, one_file=True)
    back = [json.loads(x) for f in (tmp_path / "o").glob("part-*") for x in f.read_text().splitlines()]
    assert len(back) == 3 and all("page" in r and "_tmp" not in r for r in back)
    writers.append(rows, out)
    assert spark.read.json(out).count() == 6
    assert {r["source_file"]: r["value"] for r in writers.joined_text(rows).collect()} == {"a": "x", "b": "one\n\ntwo"}
    s = {r["file"]: r for r in writers.summary(rows).collect()}
    assert (s["b"]["total_pdfs"], s["b"]["total_clauses"], s["b"]["pages"], s["a"]["clauses"]) == (2, 3, 3, 1)
    p = str(tmp_path / "p")
    rows.write.parquet(p)
    writers.rewritten(spark.read.parquet(p).where("source_file = 'b'"), p)
    assert spark.read.parquet(p).count() == 2
    assert "page" in writers.pretty(rows).first()["value"] and "rows" in writers.report("t", rows=rows)
    writers.jsonl_by(rows, str(tmp_path / "by"))
    writers.text_by(rows, str(tmp_path / "txt"))
    assert (tmp_path / "by" / "source_file=a").is_dir() and (tmp_path / "txt" / "source_file=b").is_dir()


def test_index_is_built_once(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.createDataFrame([("c", "t", "Low", "Low", "", "", 1, "e", [0.5])], schemas.CHUNK)

    for _ in range(2):
        assert readers.index_or_build(spark, str(tmp_path / "i"), build).count() == 1
    assert made == [1]


def test_annotation_stream_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema, out, ck = "clause_index int, clause_text string", str(tmp_path / "out"), str(tmp_path / "ck")
    (src / "1.json").write_text('{"clause_index": 1, "clause_text": "a"}\n{"clause_index": 2, "clause_text": "b"}\n')
    go = lambda: annotate_stream(clause_stream(spark, str(src), schema), lambda df: df.withColumn("status", F.lit("success")), out, ck).awaitTermination(120)
    go()
    time.sleep(1.1)
    (src / "2.json").write_text('{"clause_index": 2, "clause_text": "b"}\n{"clause_index": 3, "clause_text": "c"}\n')
    go()
    assert sorted(r["clause_index"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_session_stream(spark, tmp_path):
    src = tmp_path / "ev"
    src.mkdir()
    ev = [("s", 0, "user", "a"), ("s", 1, "upload", "f"), ("s", 2, "user", "b"), ("s", 3, "assistant", "c"), ("t", 0, "user", "d")]
    (src / "1.json").write_text("\n".join(json.dumps(dict(zip(("session_id", "turn", "role", "content"), e, strict=True))) for e in ev))
    stream = spark.readStream.schema(schemas.CHAT_TURN).json(str(src))
    q = chat_sessions(stream).writeStream.format("memory").queryName("chat_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = {(r["session_id"], r["turn"]): (r["session_no"], r["history"]) for r in spark.sql("select * from chat_out").collect()}
    assert got == {("s", 0): (0, 0), ("s", 2): (1, 0), ("s", 3): (1, 1), ("t", 0): (0, 0)}


@pytest.mark.parametrize("split", [150, 2000])
def test_json_arrays_are_read_split_by_split(spark, tmp_path, split):
    """Braces, brackets, quotes and escapes in strings; objects longer than a split; several files of all layouts."""
    rng = random.Random(split)
    odd = ["}", "{", '"', "\\", "]", "[", "a", "é", "\n", '\\"', "}{", "😀", ",", " "]
    text = lambda n: "".join(rng.choice(odd) for _ in range(rng.randrange(n)))
    thing = lambda i: {"id": i, "s": text(30), "o": {"a": [text(8), text(3)], "b": {"c": text(4)}}, "e": [], "n": None}
    want = {}
    for f, write in {"compact": lambda x: json.dumps(x), "wide": lambda x: json.dumps(x, indent=3, ensure_ascii=False), "lines": lambda x: "\n".join(map(json.dumps, x)), "empty": lambda _: "[]", "one": lambda x: json.dumps(x[0], indent=1), "spaced": lambda x: "\n [ " + " , ".join(json.dumps(y) for y in x) + "\n]\n"}.items():
        things = [thing(i) for i in range(rng.randrange(5, 12))] + [thing(-1) | {"s": "}" * 400}]
        (tmp_path / f"{f}.json").write_text(write(things))
        want[f] = [] if f == "empty" else things[:1] if f == "one" else things
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = readers.json_objects(spark, str(tmp_path)).collect()
        schema = "id long, s string, o struct<a:array<string>,b:struct<c:string>>, e array<int>, n string"
        rows = readers.json_array(spark, str(tmp_path), schema).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for f, things in want.items():
        own = sorted((r["_n"], json.loads(r["json"])) for r in got if r["_file"].endswith(f"/{f}.json"))
        assert [n for n, _ in own] == list(range(len(things))) and [x for _, x in own] == things, f
    assert sorted((r["id"], r["s"]) for r in rows) == sorted((x["id"], x["s"]) for things in want.values() for x in things)
