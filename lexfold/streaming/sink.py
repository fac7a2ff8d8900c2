"""A sink that takes each row of a stream once, whatever is run again.

Tasks write files that no version of the table names and report them; a batch's files
become one version, as the transaction of its number. A batch that is run again is left
out by its number, and files of tasks that failed, or ran twice, are in no report.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.snapshots import PART, Add, Log, _nullable, new_name

#: Bytes of rows that a task holds before it writes them as a row group.
GROUP_BYTES = 32 << 20


def identity(checkpoint: str) -> str:
    """The name of the writer that a checkpoint belongs to, made with it: a new checkpoint's batches count anew."""
    log = Log(checkpoint)
    log.create("_writer", new_name().encode())
    with log.fs.open_input_stream(f"{log.root}/_writer") as f:
        return f.read().decode()


@dataclass
class Report(WriterCommitMessage):
    path: str | None
    rows: int


class SnapshotWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.who, self.schema = options["path"], options["who"], schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Report:
        import pyarrow.parquet as pq

        log, name, out, held, size, rows = Log(self.path), f"of={self.who}/{new_name()}.parquet", None, [], 0, 0

        def flush() -> None:
            nonlocal out, held, size
            if out is None:
                log.fs.create_dir(f"{log.root}/of={self.who}")
                out = pq.ParquetWriter(f"{log.root}/{name}", held[0].schema, filesystem=log.fs)
            out.write_table(pa.Table.from_batches(held))
            held, size = [], 0

        for b in iterator:
            if b.num_rows:
                held.append(b)
                rows, size = rows + b.num_rows, size + b.nbytes
            if size > GROUP_BYTES:
                flush()
        if held:
            flush()
        if out is not None:
            out.close()
        return Report(name if rows else None, rows)

    def commit(self, messages: list[Report | None], batchId: int) -> None:
        adds = [Add(m.path, PART, {"rows": m.rows}) for m in messages if m is not None and m.path]
        done = Log(self.path).commit(adds, schemas={PART: _nullable(self.schema).json()}, who=self.who, number=batchId)
        if done is None:
            self.abort(messages, batchId)

    def abort(self, messages: list[Report | None], batchId: int) -> None:
        log = Log(self.path)
        for m in messages:
            if m is not None and m.path:
                log.fs.delete_file(f"{log.root}/{m.path}")


class Snapshots(DataSource):
    """Options: path of the table, who: the writer's name, one for each checkpoint (``identity``)."""

    @classmethod
    def name(cls) -> str:
        return "lexfold_snapshots"

    def streamWriter(self, schema: StructType, overwrite: bool) -> SnapshotWriter:
        return SnapshotWriter(dict(self.options), schema)


def once(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts a stream of rows into the snapshot table at path, each row once."""
    rows.sparkSession.dataSource.register(Snapshots)
    out = rows.writeStream.format(Snapshots.name()).option("path", path).option("who", identity(checkpoint)).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
