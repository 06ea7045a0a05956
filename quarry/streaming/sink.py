"""Publish events as a stream: a sink that numbers them on from the last commit.

Tasks write their rows to files of their own, which nobody reads yet. A commit lists the files of
an epoch, with the number of the first event of each, in a manifest, and then moves them to where
readers look. An epoch that has a manifest is not taken again: what a repeated attempt wrote goes,
and moves that a broken driver left undone are done. Files of tasks whose epoch never committed
stay unread, and go with the next commit of their query.

Rows have a sequence number `seq` from 1, without gaps, in the order of epochs, tasks and rows.
The folder is a URI that Arrow's file systems know; one query at a time writes to it. An empty epoch commits nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Folders for files that wait, files that are published, and manifests; name of the source.
WAITING, PUBLISHED, EPOCHS, FORMAT = "waiting", "published", "epochs", "quarry_events"
PLACE = "__place"


@dataclass
class _Part(WriterCommitMessage):
    """A file that a task wrote; none if it had no rows."""

    task: int
    name: str | None
    rows: int


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _store(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        store, root = self._store()
        store.create_dir(f"{root}/{WAITING}", recursive=True)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            place = pa.array(range(rows, rows + batch.num_rows), pa.int64())
            numbered = pa.Table.from_batches([batch]).append_column(PLACE, place)
            if out is None:
                stream = store.open_output_stream(f"{root}/{WAITING}/{name}")
                out = pyarrow.parquet.ParquetWriter(stream, numbered.schema, coerce_timestamps="us")
            out.write_table(numbered)
            rows += batch.num_rows
        if out is not None:
            out.close()
            stream.close()
        return _Part(task, name if rows else None, rows)

    def _manifests(self) -> list[str]:
        store, root = self._store()
        found = store.get_file_info(pyarrow.fs.FileSelector(f"{root}/{EPOCHS}", allow_not_found=True))
        return sorted(f.path for f in found if f.base_name.endswith(".json"))

    def _load(self, path: str) -> dict:
        with self._store()[0].open_input_stream(path) as f:
            return json.loads(f.read())

    def commit(self, messages: list[_Part | None], batchId: int) -> None:
        store, root = self._store()
        for made in (EPOCHS, PUBLISHED):
            store.create_dir(f"{root}/{made}", recursive=True)
        path = f"{root}/{EPOCHS}/{batchId:012d}.json"
        there = self._manifests()
        if path not in there:
            first = self._load(there[-1])["next"] if there else 1
            files = []
            for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.task):
                files.append({"waits": part.name, "is": f"{first:020d}-{part.name}"})
                first += part.rows
            if not files:
                return
            with store.open_output_stream(f"{path}.new") as f:
                f.write(json.dumps({"files": files, "next": first}).encode())
            store.move(f"{path}.new", path)
        for own in self._load(path)["files"]:  # again, if a commit broke off
            if store.get_file_info(f"{root}/{WAITING}/{own['waits']}").type == pyarrow.fs.FileType.File:
                store.move(f"{root}/{WAITING}/{own['waits']}", f"{root}/{PUBLISHED}/{own['is']}")
        # one query writes here, and its tasks are done: what still waits belongs to no epoch
        for left in store.get_file_info(pyarrow.fs.FileSelector(f"{root}/{WAITING}", allow_not_found=True)):
            store.delete_file(left.path)

    def abort(self, messages: list[_Part | None], batchId: int) -> None:
        store, root = self._store()
        for part in messages:
            if part is not None and part.name:
                store.delete_file(f"{root}/{WAITING}/{part.name}")


class EventSink(DataSource):
    """`df.writeStream.format(FORMAT).option("path", folder)`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"].rstrip("/"))


def _numbered(rows: DataFrame) -> DataFrame:
    first = F.substring_index(F.col("_metadata.file_name"), "-", 1).cast("long")
    return rows.withColumn("seq", first + F.col(PLACE)).drop(PLACE)


def publish(events: DataFrame, folder: str, checkpoint: str):
    """A writer of a stream of events to folder, to be started with its trigger."""
    events.sparkSession.dataSource.register(EventSink)
    return events.writeStream.format(FORMAT).option("path", folder).option("checkpointLocation", checkpoint)


def published(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All events that are published so far, with their seq."""
    return _numbered(spark.read.schema(f"{schema}, {PLACE} long").parquet(f"{folder}/{PUBLISHED}"))


def subscribe(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Published events as a stream, with their seq; from the first on."""
    return _numbered(spark.readStream.schema(f"{schema}, {PLACE} long").parquet(f"{folder}/{PUBLISHED}"))
