"""Intermediate tables: written to a folder that all executors share, so that a lost executor costs a reread."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Arrow batches, and those in which Parquet is read, are kept small so that a batch of long texts stays bounded.
BATCH_ROWS = 512
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.parquet.columnarReaderBatchSize": "4096"}


def bounded(spark: SparkSession) -> SparkSession:
    """Bound the batches of rows that a task holds."""
    for name, usual in BATCHES.items():
        if int(spark.conf.get(name, usual)) > BATCH_ROWS:
            spark.conf.set(name, str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in plain local mode a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="lexfold-")
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written once and read again."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
