"""Calls that end, late, twice or never: the stream equals the batch join for any split, and keeps no more than it must."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quarry.streaming import latency

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
BEGINS = "request_id string, transport string, method string, at timestamp"
ENDS = "request_id string, at timestamp, code string"


def made(n, seed):
    rng = random.Random(seed)
    begins, ends = [], []
    for k in range(n):
        at = T0 + timedelta(seconds=10 * k)
        begins.append((f"r{k}", "grpc", rng.choice(["Search", "IngestBatch"]), at))
        how = rng.random()
        if how < 0.7:
            ends.append((f"r{k}", at + timedelta(milliseconds=rng.choice([0, 1, 999, 60_000])), rng.choice(["OK", "Canceled"])))
        elif how < 0.8:  # beyond the bound, or before it began
            ends.append((f"r{k}", at + timedelta(seconds=rng.choice([61, -5])), "OK"))
    return begins, [*ends, ("nobody", T0, "OK")]


def plain(begins, ends):
    out = []
    for i, transport, method, at in begins:
        found = [e for e in ends if e[0] == i and at <= e[1] <= at + timedelta(minutes=1)]
        out += [(i, method, e[2], (e[1] - at) // timedelta(milliseconds=1)) for e in found] or [(i, method, None, None)]
    return sorted(out)


def rows(df):
    return sorted((r["request_id"], r["method"], r["code"], r["took_ms"]) for r in df.collect())


def test_batch_equals_a_loop(spark):
    begins, ends = made(120, 1)
    begins, ends = [*begins, ("r3", "grpc", "Again", T0), (None, "http", "Nameless", T0)], [*ends, *ends[:5], (None, T0, "OK")]
    got = rows(latency.calls(spark.createDataFrame(begins[:-1], BEGINS), spark.createDataFrame(ends, ENDS), "1 minute"))
    assert got == plain(begins[:-1], ends)
    alone = latency.calls(spark.createDataFrame(begins[-1:], BEGINS), spark.createDataFrame(ends, ENDS), "1 minute").collect()
    assert [(r["method"], r["code"]) for r in alone] == [("Nameless", None)]
    none = spark.createDataFrame([], BEGINS)
    assert latency.calls(none, spark.createDataFrame(ends, ENDS)).collect() == []


@pytest.mark.parametrize("seed", [2, 3])
def test_stream_equals_batch_for_any_split(spark, tmp_path, seed):
    begins, ends = made(60, seed)
    rng = random.Random(seed)
    far = T0 + timedelta(days=1)  # moves the watermark beyond all others
    parts = rng.choice([2, 4])
    for name, own, schema, last in (("begins", begins, BEGINS, ("far", "", "", far)), ("ends", ends, ENDS, ("far away", far, ""))):
        size = -(-len(own) // parts)
        for k in range(parts):
            spark.createDataFrame(own[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        spark.createDataFrame([last], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    live = latency.live_calls(read("begins", BEGINS), read("ends", ENDS), "1 minute", "10 minutes")
    query = live.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(150)
        kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        query.stop()
    got = spark.read.parquet(f"{tmp_path}/out").where(F.col("request_id") != "far")
    assert rows(got) == plain(begins, ends)
    assert kept <= 2  # what moved the watermark, and nothing of the calls
    done = latency.completed(got).collect()
    assert len(done) == sum(r[2] is not None for r in plain(begins, ends)) and {r["kind"] for r in done} == {"rpc_completed"}
