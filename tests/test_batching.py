"""Greedy batches against a plain loop, for blocks of any size and many levels."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import batching, events


def looped(rows, most, target):
    """Pending documents are sent before one that doesn't fit, after one that takes them beyond the target, and before a deletion or another key."""
    out, batch, held, size, last = {}, 0, 0, 0, object()
    for key, n, bytes_, flush in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1]) if r[0] is not None else (False, 0, r[1])):
        if flush or key != last:
            held = size = 0
        last = key
        if flush:
            continue
        if held and (held >= most or size + (bytes_ or 0) > target):
            held = size = 0
        batch += held == 0
        out[key, n] = batch
        held, size = held + 1, size + (bytes_ or 0)
        if size > target:
            held = size = 0
    return out


@pytest.mark.parametrize(("most", "target", "block", "fan"), [(4, 100, 4, 2), (7, 60, 16, 3), (128, 4 << 20, 65_536, 256), (3, 1000, 50, 256)])
def test_batches_equal_a_loop(spark, most, target, block, fan):
    rng = random.Random(most)
    scale = max(1, target // 12)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2]), n, rng.choice([None, 0, 1, scale, scale // 2, 3 * scale, target, target + 1]), rng.random() < 0.05) for n in range(400)]
    df = spark.createDataFrame(rows, "source int, doc int, bytes long, deleted boolean").repartition(5)
    got = batching.batched(df, "source", ["doc"], "bytes", "deleted", most, target, block, fan)
    assert {(r["source"], r["doc"]): r["batch"] for r in got.collect()} == looped(rows, most, target)
    assert set(got.columns) == {*df.columns, "batch"}


def test_no_rows_and_only_deletions(spark):
    df = spark.createDataFrame([(1, 1, 5, True), (1, 2, 5, True)], "source int, doc int, bytes long, deleted boolean")
    assert batching.batched(df, "source", ["doc"], "bytes", "deleted").collect() == []
    assert batching.batched(df.where("false"), "source", ["doc"], "bytes").collect() == []


def test_numbers_of_events_stay_when_read_again(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"))
    got = events.numbered(df, ["x"])
    first = {r["x"]: r["seq"] for r in got.collect()}
    assert first == {x: n for n, x in enumerate(sorted(first), 1)} and len(first) == 5000
    assert {r["x"]: r["seq"] for r in got.orderBy("seq").collect()} == first
