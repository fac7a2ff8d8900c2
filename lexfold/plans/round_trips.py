"""Queries that write a table by a writer, or as files of a source, and read it again: sources, sinks and streams."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas, streaming
from ..functions.labels import stand_in
from ..operators import curate
from ..sources import readers, snapshots, writers
from ..storage import shared_path
from .queries import ENRICHED, PRED, _clauses, _predictions, query, table
from .variants import GEO, SEGMENTS, docs, geometry, marked


def _store(spark: SparkSession, path: str, content: bytes) -> None:
    """A file in the shared folder, by the driver."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(content))
    out.close()


ROW = "doc_id long, text string, lang string, source string"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


# JSON, CSV and splits


@query("SELECT doc_id, md5(coalesce(text, '')) AS h, text IS NULL AS missing, lang, source FROM documents")
def jsonl_scan(spark, sf_dir):
    """JSON lines written with their null fields, without internal columns, and read by a schema."""
    path = shared_path(spark, "jsonl")
    writers.jsonl(_documents(spark, sf_dir).withColumn("_seen", F.lit(1)), path)
    got = readers.jsonl(spark, path, ROW)
    return got.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"), F.col("text").isNull().alias("missing"), "lang", "source")


_BAD = "CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 5 = 0 THEN '{broken ' || doc_id ELSE 'ok' END"


@query(f"WITH l AS (SELECT doc_id, lang, {_BAD} AS line, CAST(doc_id // 300 AS INT) AS file, CAST(row_number() OVER (PARTITION BY doc_id // 300 ORDER BY doc_id) AS INT) AS lineno FROM documents) SELECT file, lineno, CASE WHEN line = 'ok' THEN doc_id END AS doc_id, CASE WHEN line = 'ok' THEN lang END AS lang, CASE WHEN line <> 'ok' THEN line END AS malformed FROM l WHERE line <> ''")
def jsonl_tolerant_scan(spark, sf_dir):
    """Lines by file and number: good ones parsed, malformed ones kept, blank ones skipped. A file is 300 documents."""
    path, n = shared_path(spark, "tolerant"), F.col("doc_id")
    line = F.when(n % 7 == 0, "").when(n % 5 == 0, F.concat(F.lit("{broken "), n.cast("string"))).otherwise(F.to_json(F.struct("doc_id", "lang")))
    rows = _documents(spark, sf_dir).withColumn("file", F.floor(n / 300).cast("int")).repartition("file").sortWithinPartitions("file", "doc_id")
    rows.select("file", line.alias("value")).write.partitionBy("file").text(path)
    good, bad = readers.jsonl_tolerant(spark, path, "doc_id long, lang string")
    nothing, file = F.lit(None).cast("string"), F.regexp_extract("_file", r"file=(\d+)/", 1).cast("int").alias("file")
    return good.select(file, F.col("_lineno").alias("lineno"), "doc_id", "lang", nothing.alias("malformed")).union(bad.select(file, "_lineno", nothing.cast("long"), nothing, "line"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS h, text IS NULL AS missing, lang, CAST(n_chars AS BIGINT) AS n FROM documents")
def json_array_scan(spark, sf_dir):
    """Files that are JSON arrays, with indents, nested objects, and braces, brackets and quotes in strings; each is read by many tasks."""
    path = shared_path(spark, "array")
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.struct("doc_id", F.col("text").alias("text"), F.struct(F.array(F.lit('}],{"'), F.col("lang")).alias("l"), F.struct(F.col("n_chars").alias("n")).alias("size")).alias("about")).alias("r"))
    writers.json_array(rows.select("r.*"), path)
    got = readers.json_array(spark, path, "doc_id long, text string, about struct<l:array<string>,size:struct<n:long>>")
    return got.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"), F.col("text").isNull().alias("missing"), F.col("about.l")[1].alias("lang"), F.col("about.size.n").alias("n"))


@query("SELECT md5(coalesce(text, '')) AS h, source AS clause_type, lang AS risk_level, count(*) AS n FROM documents GROUP BY 1, 2, 3")
def csv_scan(spark, sf_dir):
    """A CSV with quotes and line ends in its fields."""
    path = shared_path(spark, "csv")
    rows = _documents(spark, sf_dir).select(F.col("text").alias("clause_text"), F.col("source").alias("clause_type"), F.col("lang").alias("risk_level"))
    rows.write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    got = readers.contract_csv(spark, path)
    return got.groupBy(F.md5(F.coalesce("clause_text", F.lit(""))).alias("h"), "clause_type", "risk_level").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def split_scan(spark, sf_dir):
    """Files of named splits as one table."""
    path, df = shared_path(spark, "splits"), _documents(spark, sf_dir)
    for name, part in (("train", df.where("doc_id % 10 <> 0")), ("validation", df.where("doc_id % 10 = 0"))):
        writers.jsonl(part, f"{path}/{name}")
    got = readers.splits(spark, ROW, train=f"{path}/train", validation=f"{path}/validation")
    return got.groupBy("split", "lang").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT doc_id // 300 AS file, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id) AS t FROM documents GROUP BY 1),
p AS (SELECT file, unnest(string_split(t, chr(10) || chr(10))) AS x, unnest(generate_series(1, len(string_split(t, chr(10) || chr(10))))) AS i FROM f),
k AS (SELECT file, i, replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS x FROM p)
SELECT CAST(file AS INT) AS file, CAST(row_number() OVER (PARTITION BY file ORDER BY i) AS INT) AS clause_index, md5(x) AS h FROM k WHERE length(x) > 20""")
def blank_line_file_scan(spark, sf_dir):
    """Files of pieces between blank lines, each of 300 documents, read split by split."""
    path = shared_path(spark, "blank")
    rows = _documents(spark, sf_dir).withColumn("file", F.floor(F.col("doc_id") / 300).cast("int")).repartition("file").sortWithinPartitions("file", "doc_id")
    rows.select("file", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("file").option("lineSep", "\n\n").text(path)
    return readers.blank_line_files(spark, path).select(F.regexp_extract("_file", r"file=(\d+)/", 1).cast("int").alias("file"), "clause_index", F.md5("clause_text").alias("h"))


# PDF by a plug-in, bulk text, uploads


@query("SELECT r_name || '.pdf' AS source_file, CASE WHEN r_regionkey <> 2 THEN r_name END AS text, CASE WHEN r_regionkey = 2 THEN 'broken' END AS error FROM region")
def pdf_scan(spark, sf_dir):
    """A folder's PDF files by a reader of one's own: other files are left out, one that fails is a row."""
    path = shared_path(spark, "pdf")
    for r in table(spark, sf_dir, "region").collect():
        _store(spark, f"{path}/{r['r_name']}.pdf", b"broken" if r["r_regionkey"] == 2 else r["r_name"].encode())
        _store(spark, f"{path}/{r['r_name']}.txt", b"other")

    def reader(content: bytes) -> list[dict]:
        if content == b"broken":
            raise ValueError("broken")
        return [{"text": content.decode(), "page": 1, "top": 0.0, "bottom": 9.0, "height": 9.0, "bold": False, "size": 8.0}]

    found, failures = readers.pdf_lines(spark, path, reader)
    nothing = F.lit(None).cast("string")
    return found.select("source_file", "text", nothing.alias("error")).union(failures.select("source_file", nothing, "error"))


@query(GEO.rstrip().rstrip(",") + " SELECT source_file, string_agg(t, chr(10) || chr(10) ORDER BY page) AS text FROM (SELECT source_file, page, string_agg(text, chr(10) ORDER BY line_no) AS t FROM ln GROUP BY 1, 2) GROUP BY 1")
def bulk_texts(spark, sf_dir):
    """All of a file's text, pages apart."""
    return readers.bulk_text(geometry(spark, sf_dir))


@query(SEGMENTS + " SELECT source_file, CAST(clause_id AS INT) AS clause_id, CASE WHEN regexp_matches(lower(text), 'indemnif|liabil|damages|penalty') THEN 'High' WHEN regexp_matches(lower(text), 'terminat|notice|warrant') THEN 'Medium' ELSE 'Low' END AS risk FROM en")
def analysed_uploads(spark, sf_dir):
    """Lines of uploads to their clauses' risk, by the stand-in; what is no PDF or empty is refused first."""
    for name, content, status in (("a.txt", b"x", 422), ("a.pdf", b"", 400)):
        try:
            readers.upload(name, content)
        except readers.Refused as e:
            assert e.status == status
        else:
            raise AssertionError("an upload was not refused")
    return readers.analyse(marked(spark, sf_dir), "Licensee").select("source_file", "clause_id", "risk")


# sinks


@query(ENRICHED + " SELECT d.source, en.source_file, clause_id, md5(text) AS h FROM (SELECT * FROM en) en JOIN (SELECT CAST(doc_id AS VARCHAR) AS id, source FROM documents) d ON d.id = en.source_file".replace("md5(text)", "md5(en.text)"))
def jsonl_by_source(spark, sf_dir):
    """A folder of JSON lines for each source."""
    path = shared_path(spark, "by")
    of = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_file"), "source")
    writers.jsonl_by(_clauses(spark, sf_dir).join(of, "source_file"), path, by="source")
    got = spark.read.schema(schemas.struct("source_file string, clause_id long, text string, source string")).json(path)
    return got.select("source", "source_file", "clause_id", F.md5("text").alias("h"))


@query("SELECT lang, 2 * count(*) AS n FROM documents GROUP BY 1")
def appended(spark, sf_dir):
    """Rows added to a JSONL table that is not read for it."""
    path, df = shared_path(spark, "append"), _documents(spark, sf_dir)
    writers.append(df, path)
    writers.append(df, path)
    return readers.jsonl(spark, path, ROW).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT md5(coalesce(text, '')) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def rewritten_in_place(spark, sf_dir):
    """A table replaced by its own rows without duplicates, in one version."""
    path = shared_path(spark, "rewrite")
    snapshots.append(_documents(spark, sf_dir).withColumn("h", F.md5(F.coalesce("text", F.lit("")))).select("h", "doc_id"), path)
    snapshots.replaced(spark, path, lambda df: curate.dedup_first(df, "h", order="doc_id"))
    return snapshots.read(spark, path)


@query("SELECT v AS version, CAST(o_orderstatus AS VARCHAR) AS status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3), orders WHERE CASE v WHEN 1 THEN o_orderkey % 3 <> 0 WHEN 2 THEN true ELSE o_orderstatus <> 'F' END GROUP BY 1, 2")
def table_versions(spark, sf_dir):
    """Three versions of a table, read after all were made: rows, rows added, and rows deleted; a write that is repeated is left out."""
    path, df = shared_path(spark, "versions"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    for n, part in enumerate((df.where("o_orderkey % 3 <> 0"), df.where("o_orderkey % 3 = 0"))):
        for _ in range(2):
            snapshots.append(part, path, "loader", n)
    snapshots.replaced(spark, path, lambda rows: rows.where("o_orderstatus <> 'F'"))
    got = None
    for v in (1, 2, 3):
        at = snapshots.read(spark, path, v).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).withColumn("version", F.lit(v))
        got = at if got is None else got.unionByName(at)
    return got.select("version", "status", "n", "keys")


@query("SELECT r_regionkey, r_name FROM region")
def pretty_records(spark, sf_dir):
    """Records as indented JSON."""
    got = writers.pretty(table(spark, sf_dir, "region").select("r_regionkey", "r_name")).where(F.contains("value", F.lit("\n")))
    return got.select(F.from_json("value", "r_regionkey int, r_name string").alias("r")).select("r.*")


@query(PRED + "c AS (SELECT y_true, count(*) AS n FROM pr GROUP BY 1) SELECT 'Labels' || chr(10) || '======' || chr(10) || chr(10) || 'counts' || chr(10) || '------' || chr(10) || 'y_true' || chr(9) || 'n' || chr(10) || string_agg(y_true || chr(9) || n, chr(10) ORDER BY y_true) || chr(10) AS report FROM c")
def text_report(spark, sf_dir):
    """Metric tables as text."""
    counts = _predictions(spark, sf_dir).groupBy("y_true").agg(F.count("*").alias("n")).orderBy("y_true")
    return spark.createDataFrame([(writers.report("Labels", counts=counts),)], "report string")


@query("SELECT CAST(vec_id AS VARCHAR) AS chunk_id, len(embedding) AS dim, 2 AS reads, false AS off FROM embeddings".replace("len(embedding) AS dim", "CAST(len(embedding) AS INT) AS dim"))
def index_scan(spark, sf_dir):
    """A retrieval table that is built where there is none, then read; off where its dataset is missing."""
    path = shared_path(spark, "index")
    text = F.lit("x")

    def build() -> DataFrame:
        rows = table(spark, sf_dir, "embeddings")
        named = {"chunk_id": F.col("vec_id").cast("string"), "raw_clause": text, "licensor_risk": text, "licensee_risk": text, "licensor_explanation": text, "licensee_explanation": text, "clause_index": F.col("vec_id").cast("int"), "enriched_text": text, "embedding": F.col("embedding").cast("array<float>")}
        return rows.select(*(v.alias(k) for k, v in named.items()))

    readers.index_or_build(spark, path, build)
    got = readers.index_or_build(spark, path, build, "nowhere")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        off = readers.index_or_build(spark, path + "-none", build, path + "-missing")
    return got.select("chunk_id", F.size("embedding").alias("dim"), F.lit(2).alias("reads"), F.lit(off is not None).alias("off"))


# streams


@query("SELECT doc_id AS clause_index, CASE WHEN regexp_matches(lower(coalesce(text, '')), 'indemnif|liabil|damages|penalty') THEN 'High' WHEN regexp_matches(lower(coalesce(text, '')), 'terminat|notice|warrant') THEN 'Medium' ELSE 'Low' END AS risk FROM documents")
def annotated_stream(spark, sf_dir):
    """Annotation as a stream, a file a trigger, in three runs by two checkpoints over tasks that overlap: each task has one result."""
    path = shared_path(spark, "stream")
    df = docs(spark, sf_dir).select(F.col("doc_id").alias("clause_index"), F.col("text").alias("clause_text"))
    writers.jsonl(df.where("clause_index % 3 <> 0"), f"{path}/in", mode="append")

    def annotate(batch: DataFrame) -> DataFrame:
        return batch.select("clause_index", stand_in(F.col("clause_text"), F.lit("Licensor"))["risk"].alias("risk"))

    for checkpoint in ("a", "b", "a"):  # the second run knows the first's results by the index of done keys alone
        tasks = streaming.clause_stream(spark, f"{path}/in", "clause_index long, clause_text string")
        streaming.annotate_stream(tasks, annotate, f"{path}/out", f"{path}/{checkpoint}").awaitTermination()
        writers.append(df.where("clause_index % 3 = 0 or clause_index % 5 = 0"), f"{path}/in")
    return snapshots.read(spark, f"{path}/out").select("clause_index", "risk")


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def exactly_once_stream(spark, sf_dir):
    """Events through the sink of snapshots, and its last batch run again after its commit: each row is there once."""
    path = shared_path(spark, "once")
    table(spark, sf_dir, "events").select("event_id", "event_type").repartitionByRange(4, "event_id").write.json(f"{path}/in")
    for _ in range(2):
        rows = spark.readStream.schema("event_id long, event_type string").option("maxFilesPerTrigger", 1).json(f"{path}/in")
        streaming.once(rows, f"{path}/out", f"{path}/ck").awaitTermination()
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/ck/commits/3")
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, False)  # as if the driver had died before it
    return snapshots.read(spark, f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, CAST(s AS INT) AS session_no FROM (SELECT *, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS s FROM conversations) WHERE role <> 'user'".replace("turn,", "CAST(turn AS INT) AS turn,"))
def session_stream(spark, sf_dir):
    """Chat sessions as a stream: turns in any order, over several triggers and Arrow batches of 100 rows, are let go in order."""
    path, batch = shared_path(spark, "sessions"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.timestamp_seconds(F.col("turn") + 10**8).alias("ts"), F.col("turn").cast("int").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("content"))
    turns.withColumn("deal", F.pmod(F.hash("session_id", "turn"), F.lit(3))).repartition("deal").sortWithinPartitions(F.md5(F.concat_ws("|", "session_id", "turn"))).write.partitionBy("deal").json(f"{path}/in")
    last = spark.range(1).select(F.lit("").alias("session_id"), F.timestamp_seconds(F.lit(10**9)).alias("ts"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("").alias("content"), F.lit(3).alias("deal"))
    last.write.mode("append").partitionBy("deal").json(f"{path}/in")  # an event long after lets the last turns go
    events = spark.readStream.schema("session_id string, ts timestamp, turn int, role string, content string, deal int").option("maxFilesPerTrigger", 1).json(f"{path}/in")
    before = spark.conf.get(batch)
    spark.conf.set(batch, "100")
    try:
        out = streaming.ordered_sessions(events, late="10 days", reset="user").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True)
        streaming.started(out, spark).awaitTermination()
    finally:
        spark.conf.set(batch, before)
    return spark.read.parquet(f"{path}/out").select("session_id", "turn", "session_no")
