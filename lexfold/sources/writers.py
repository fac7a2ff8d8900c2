"""Writers. Null fields are written; rows keep their order where a file has one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.curate import without_internal


def jsonl(rows: DataFrame, path: str, one_file: bool = False, mode: str = "errorifexists") -> None:
    df = without_internal(rows)
    (df.coalesce(1) if one_file else df).write.mode(mode).option("ignoreNullFields", False).json(path)


def jsonl_by(rows: DataFrame, path: str, by: str = "source_file") -> None:
    """A folder of JSONL for each value of by."""
    rows.write.partitionBy(by).option("ignoreNullFields", False).json(path)


def joined_text(clauses: DataFrame, by: str = "source_file") -> DataFrame:
    """(by, value): a document's clause texts in order, blank lines between."""
    return clauses.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("clause_id", "text"))), lambda x: x["text"]), "\n\n").alias("value"))


def text_by(clauses: DataFrame, path: str, by: str = "source_file") -> None:
    joined_text(clauses, by).write.partitionBy(by).text(path)


def files(clauses: DataFrame) -> DataFrame:
    """(file, pages, clauses): a row a file."""
    return clauses.groupBy(F.col("source_file").alias("file")).agg(F.max("page").cast("int").alias("pages"), F.count("*").cast("int").alias("clauses"))


def summary(clauses: DataFrame) -> DataFrame:
    """(total_pdfs, total_clauses, file, pages, clauses): a row a file, each with the totals; nested only where a document is made of it."""
    by = files(clauses)
    total = by.agg(F.count("*").alias("files"), F.coalesce(F.sum("clauses"), F.lit(0)).alias("clauses")).first()
    return by.select(F.lit(total["files"]).cast("int").alias("total_pdfs"), F.lit(total["clauses"]).cast("long").alias("total_clauses"), "file", "pages", "clauses")


def pretty(rows: DataFrame) -> DataFrame:
    """(value): each row as indented JSON."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def json_array(rows: DataFrame, path: str) -> None:
    """Files that are each one JSON array of indented objects, a file a partition."""

    def lines(batches):
        import pyarrow as pa

        before = "["
        for b in batches:
            put = []
            for x in b.column(0).to_pylist():
                put += [before, x]
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(put, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]"] if before == "," else ["[]"], pa.string())], ["value"])

    pretty(rows).mapInArrow(lines, "value string").write.text(path)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a JSONL table without reading it."""
    jsonl(rows, path, mode="append")


def rewritten(rows: DataFrame, path: str) -> None:
    """Replaces the Parquet table at path by rows that may be read from it: written aside, then swapped in."""
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    aside, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    to = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = to(path).getFileSystem(conf)
    if fs.exists(to(path)):
        fs.rename(to(path), to(old))
    fs.rename(to(aside), to(path))
    fs.delete(to(old), True)


def index(chunks: DataFrame, path: str) -> None:
    """A retrieval table: chunks with embeddings."""
    chunks.write.mode("overwrite").parquet(path)


def report(title: str, **tables: DataFrame) -> str:
    """Metric tables as text. For small tables: they are collected."""
    out = [title, "=" * len(title)]
    for name, df in tables.items():
        out += ["", name, "-" * len(name), "\t".join(df.columns)]
        out += ["\t".join(f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) for r in df.collect()]
    return "\n".join(out) + "\n"
