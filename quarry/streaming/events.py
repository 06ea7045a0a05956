"""Streams over the event log: files that land in a folder."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: After so long without an event a key's level is forgotten.
IDLE_MS = 7 * 86_400_000
EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def follow(spark: SparkSession, folder: str, kinds: list[str] | None = None, replay: bool = True) -> DataFrame:
    """Events as they land, of the given kinds; the filter reaches the scan. Without replay, only files that land from now on."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if not replay:
        reader = reader.option("modifiedAfter", time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime())).option("timeZone", "UTC")
    stream = reader.parquet(folder)
    return stream if kinds is None else stream.where(F.col("event_type").isin(kinds))


def debounced(events: DataFrame, key: str = "user_id", quiet: str = "1 second", late: str = "1 minute") -> DataFrame:
    """(key, first, fires, hints): one row a run of hints, once it has been quiet and the watermark has passed."""
    runs = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("hints"))
    return runs.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("fires"), "hints")


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    level, seen = state.get if state.exists else (0, 0)
    # a batch's events of a key may come in several frames, which aren't in order among each other
    sums = np.cumsum(pd.concat([f[["ts", "event_id", "step"]] for f in frames]).sort_values(["ts", "event_id"])["step"].to_numpy(dtype=np.int64))
    if len(sums):  # a level that never falls under zero is the sum less its smallest value so far
        level, seen = int(sums[-1] + max(level, -int(sums.min()))), seen + len(sums)
    state.update((level, seen))
    state.setTimeoutDuration(IDLE_MS)
    yield pd.DataFrame({"key": [key[0]], "level": [level], "seen": [seen]})


def gauge(events: DataFrame, step, key: str = "user_id") -> DataFrame:
    """(key, level, seen) after each batch: a level that steps raise and lower and that never falls under zero.

    Order holds within a batch: an event that comes in a later batch than its time says counts there.
    A key that is silent for IDLE_MS is forgotten, so state doesn't grow without end.
    """
    return events.select(F.col(key).alias("key"), "ts", "event_id", step.alias("step")).groupBy("key").applyInPandasWithState(_fold, "key long, level long, seen long", "level long, seen long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def snapshots(spark: SparkSession, build, publish, checkpoint: str, every: str = "2 seconds"):
    """Call publish(build()) every so often: a gauge row for those who come later."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: publish(build())).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
