"""Streams with state against their batch forms: random splits into batches, many frames, restarts, snapshots."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.jobs import scratch, store
from quarry.operators import events
from quarry.streaming import events as streams
from quarry.streaming import stateful

BASE = dt.datetime(2024, 5, 1, 12)
COLUMNS = "seq long, kind string, time timestamp, source_id string, uri string, chunk_count int, error string, took_ms long, transport string, method string, pending_documents int, active_document string, active_stage string, worker_state string"


def happened(seed, n=240):
    rng, rows = random.Random(seed), []
    for k in range(n):
        kind = rng.choice([*events.KINDS, "document_queued", "document_ingested", "snapshot", None])
        maybe = lambda x: rng.choice([x, None])
        rows.append((k, kind, BASE + dt.timedelta(microseconds=rng.randrange(60_000_000) // 500 * 500), rng.choice("ab"), maybe(f"/f{k % 9}"), maybe(k % 5), rng.choice(["", "broken", None]), maybe(k * 3), rng.choice(["grpc", "http"]), rng.choice(["IngestBatch", "Search"]), rng.choice([None, 0, 3, -2]), maybe("/active"), maybe("reading"), maybe(rng.choice(["ready", "failed"]))))
    return rows


def run(stream, spark, folder, name):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{name}")


def land(spark, folder, rows, schema, parts, seed=0):
    """Rows dealt at random to as many files, each its own batch."""
    rng = random.Random(seed)
    dealt = [[] for _ in range(parts)]
    for r in rows:
        dealt[rng.randrange(parts)].append(r)
    for part in dealt:
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_display_equals_the_batch_form_for_any_split(spark, rocksdb):
    rows = happened(1)
    folder = scratch.fresh(spark, "display")
    end = (10_000, "scan_started", BASE + dt.timedelta(hours=5), "z", *[None] * 10)
    land(spark, f"{folder}/in", rows, COLUMNS, 4)
    spark.createDataFrame([end], COLUMNS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    got = run(stateful.display(stream, "source_id", "time", ["seq"], late="2 hours"), spark, folder, "out")
    want = events.display(spark.createDataFrame(rows, COLUMNS), "source_id", ["time", "seq"])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    of = lambda df: sorted((tuple(r) for r in df.select(*names).collect()), key=str)
    assert of(got) == of(want)


def test_display_starts_from_a_snapshot(spark, rocksdb):
    folder = scratch.fresh(spark, "display")
    at = lambda s: BASE + dt.timedelta(seconds=s)
    rows = [(1, "document_ingested", at(1), "a", *[None] * 10), (2, "document_queued", at(2), "a", *[None] * 10), (3, "document_deleted", at(3), "b", *[None] * 10), (9, None, at(9999), "z", *[None] * 10)]
    land(spark, f"{folder}/in", rows, COLUMNS, 1)
    first = spark.createDataFrame([("a", 5, "/now", "embedding", "ready")], "source_id string, pending_documents int, active_document string, active_stage string, worker_state string")
    stream = spark.readStream.schema(COLUMNS).parquet(f"{folder}/in")
    got = {r["seq"]: r for r in run(stateful.display(stream, "source_id", "time", ["seq"], snapshot=first), spark, folder, "out").collect()}
    assert (got[1]["pending"], got[1]["active_document"], got[1]["state"]) == (4, "/now", "ready") and got[2]["pending"] == 5
    assert (got[3]["pending"], got[3]["active_document"], got[3]["state"]) == (0, "", None)


SCHEDULE = "source string, at timestamp, kind string, planned timestamp, delay_ms long"


def scheduled(seed, n=160):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        at = BASE + dt.timedelta(milliseconds=rng.randrange(40_000) // 100 * 100)
        kind = rng.choice(["request", "request", "finished", "accepted"])
        rows.append((rng.choice("abc"), at, kind, at + dt.timedelta(milliseconds=rng.choice([0, 300, 2500])) if kind == "request" else None, rng.choice([None, 0, 200, 400, 3000]) if kind == "finished" else None))
    return rows


def batch_schedule(spark, rows):
    frame = spark.createDataFrame(rows, SCHEDULE)
    scans = events.coalesced(frame.where("kind = 'request'"), "source", "at", "planned").select("source", F.lit("scan").alias("what"), F.col("planned").alias("begins"), "requests")
    runs, accepted = frame.where("kind = 'finished'").withColumnRenamed("at", "finished"), frame.where("kind = 'accepted'")
    retries = events.scheduled_retries(runs, accepted, "source", "finished", "delay_ms", "at").select("source", F.lit("retry").alias("what"), F.col("fires").alias("begins"), F.lit(0).alias("requests"))
    return sorted(tuple(r) for r in scans.unionByName(retries).collect())


def test_schedule_equals_the_batch_forms_across_a_restart(spark, rocksdb):
    rows = list(dict.fromkeys(scheduled(3)))
    # one run at a time of a source, as it would be
    seen, own = set(), []
    for r in rows:
        if r[2] == "request" or (r[0], r[1]) not in seen:
            own.append(r)
        if r[2] != "request":
            seen.add((r[0], r[1]))
    folder = scratch.fresh(spark, "schedule")
    stream = lambda: stateful.schedule(spark.readStream.schema(SCHEDULE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), "source", "at", F.col("kind"), "planned", "delay_ms", late="1 hour")
    half = sorted(own, key=lambda r: r[1])
    land(spark, f"{folder}/in", half[:90], SCHEDULE, 3, 1)
    run(stream(), spark, folder, "out")
    land(spark, f"{folder}/in", half[90:], SCHEDULE, 3, 2)
    spark.createDataFrame([("z", BASE + dt.timedelta(hours=9), "accepted", None, None)], SCHEDULE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    got = run(stream(), spark, folder, "out")
    assert sorted(tuple(r) for r in got.select("source", "what", "begins", "requests").collect()) == batch_schedule(spark, own)


def test_gauge_of_a_key_with_many_frames(spark):
    folder = scratch.fresh(spark, "gauge")
    n = 30_000  # more than an Arrow batch; steps that only the order of time keeps at 0 in the end
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + (n - F.col("id"))).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.when(F.col("id") >= n // 2, "up").otherwise("down").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    rows.coalesce(1).write.parquet(f"{folder}/in")
    stream = streams.gauge(streams.follow(spark, f"{folder}/in"), F.when(F.col("event_type") == "up", 1).otherwise(-1))
    q = stream.writeStream.format("memory").queryName("levels").outputMode("update").option("checkpointLocation", f"{folder}/c").start()
    for _ in range(60):  # with a timeout in processing time there is always another batch
        if not q.isActive or spark.table("levels").count():
            break
        time.sleep(1)
    q.stop()
    assert [(r["level"], r["seen"]) for r in spark.table("levels").collect()] == [(0, n)]


def test_a_failed_write_gives_its_claim_back(spark):
    table = f"{scratch.fresh(spark, 'store')}/t"
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("document_id"), F.lit("s").alias("source_id"), F.lit(1).alias("bucket"))
    for write in (lambda df: store.publish_parts(df, table, [("s", 1)]), lambda df: store.publish(df, table + "2")):
        with pytest.raises(Exception, match="no"):
            write(broken)
        assert write(spark.range(3).select(F.col("id").cast("string").alias("document_id"), F.lit("s").alias("source_id"), F.lit(1).alias("bucket"))) == 1
