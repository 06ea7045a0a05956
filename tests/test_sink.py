"""The event sink: numbers without gaps, epochs that are repeated, commits that break off, tasks whose epoch never commits."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.jobs import scratch
from quarry.operators import events
from quarry.streaming import sink

SCHEMA = "kind string, time timestamp, n int"
BASE = dt.datetime(2024, 5, 1)


def rows_of(a, b):
    return [(events.KINDS[k % 9], BASE + dt.timedelta(seconds=k), k) for k in range(a, b)]


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, **options):
    stream = spark.readStream.schema(SCHEMA).options(**options).parquet(f"{folder}/in")
    q = sink.publish(stream, f"{folder}/log", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert not q.isActive and q.exception() is None


def seen(spark, folder):
    return sorted((r["seq"], r["n"]) for r in sink.published(spark, f"{folder}/log", SCHEMA).collect())


def test_numbers_go_on_over_epochs_and_runs(spark):
    folder = scratch.fresh(spark, "sink")
    for a, b in ((0, 40), (40, 75), (75, 100)):
        land(spark, f"{folder}/in", rows_of(a, b))
    run(spark, folder, maxFilesPerTrigger="1")
    land(spark, f"{folder}/in", rows_of(100, 130))
    run(spark, folder)
    found = seen(spark, folder)
    assert [s for s, _ in found] == list(range(1, 131)) and sorted(n for _, n in found) == list(range(130)) and [n for s, n in found if s > 100] == list(range(100, 130))
    replayed = events.replay(sink.published(spark, f"{folder}/log", SCHEMA), 5, "seq").collect()
    assert [r["seq"] for r in replayed] == [126, 127, 128, 129, 130]
    stream = events.of_kinds(sink.subscribe(spark, f"{folder}/log", SCHEMA), "scan_started")
    q = stream.writeStream.format("memory").queryName("subscribed").option("checkpointLocation", f"{folder}/s").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["seq"] for r in spark.table("subscribed").collect()) == sorted(s for s, n in found if n % 9 == 0)


def task_writes(writer, values, task, monkeypatch):
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: task})()))
    return writer.write(iter([pa.RecordBatch.from_pydict({"kind": ["k"] * len(values), "time": pa.array([BASE] * len(values), pa.timestamp("us", "UTC")), "n": pa.array(values, pa.int32())})] if values else []))


def test_epochs_are_published_once(spark, monkeypatch):
    folder = scratch.fresh(spark, "sink")
    writer = sink._Writer(f"{folder}/log")
    first = [task_writes(writer, v, t, monkeypatch) for t, v in enumerate(([1, 2], [], [3]))]
    writer.commit(list(reversed(first)), 0)
    assert seen(spark, folder) == [(1, 1), (2, 2), (3, 3)]
    writer.commit([task_writes(writer, [1, 2], 0, monkeypatch), task_writes(writer, [3], 2, monkeypatch)], 0)  # the epoch again
    assert seen(spark, folder) == [(1, 1), (2, 2), (3, 3)]
    task_writes(writer, [77], 0, monkeypatch)  # written, and the driver dies before the commit
    writer.abort([task_writes(writer, [78], 1, monkeypatch)], 1)
    again = [task_writes(writer, [4], 0, monkeypatch), None]
    store = writer._store()[0]

    class Broken:
        def __getattr__(self, name):
            return getattr(store, name)

        def move(self, source, target):
            if f"/{sink.PUBLISHED}/" in target:
                raise OSError("the driver dies here")
            store.move(source, target)

    root = writer._store()[1]
    monkeypatch.setattr(writer, "_store", lambda: (Broken(), root))
    with pytest.raises(OSError):
        writer.commit(again, 1)
    monkeypatch.undo()
    assert seen(spark, folder) == [(1, 1), (2, 2), (3, 3)]
    writer.commit([task_writes(writer, [4], 0, monkeypatch)], 1)  # the repeated epoch finishes the first one's moves
    writer.commit([task_writes(writer, [5, 6], 3, monkeypatch)], 2)
    writer.commit([task_writes(writer, [], 0, monkeypatch)], 3)
    assert seen(spark, folder) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6)]
    assert sink.published(spark, f"{folder}/log", SCHEMA).where(F.col("kind") == "k").count() == 6
    assert store.get_file_info(pa.fs.FileSelector(f"{root}/{sink.WAITING}")) == []
