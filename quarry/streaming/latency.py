"""How long calls took: their beginnings joined with their ends, as a batch and as a stream.

A call begins once and ends at most once, within a bound. Both sides name it by request_id, so one
that never ends comes out too, without a code, once the watermark says that its end can't come
any more. Until then, and no longer, the stream keeps it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined(begins: DataFrame, ends: DataFrame, bound: str) -> DataFrame:
    ended = ends.select(F.col("request_id").alias("__id"), F.col("at").alias("__ended"), F.col("code").alias("code"))
    within = (F.col("request_id") == F.col("__id")) & (F.col("__ended") >= F.col("at")) & (F.col("__ended") <= F.col("at") + F.expr(f"INTERVAL {bound}"))
    took = F.floor((F.unix_micros("__ended") - F.unix_micros("at")) / 1000)
    return begins.join(ended, within, "left_outer").select("request_id", "transport", "method", F.col("at").alias("began"), F.col("__ended").alias("ended"), "code", took.alias("took_ms"))


def calls(begins: DataFrame, ends: DataFrame, bound: str = "5 minutes") -> DataFrame:
    """(request_id, transport, method, began, ended, code, took_ms): a row a call; ended, code and took_ms are null where no end came within bound.

    begins has request_id, transport, method and at, ends has request_id, at and code, both times being
    timestamps. An id that begins or ends more than once gives a row for each pair, one that is null a call without an end.
    """
    return _joined(begins, ends, bound)


def live_calls(begins: DataFrame, ends: DataFrame, bound: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """calls over two streams; rows that come later than late are dropped, and what is kept is at most bound and late old."""
    return _joined(begins.withWatermark("at", late), ends.withWatermark("at", late), bound)


def completed(calls_: DataFrame) -> DataFrame:
    """Calls that ended, as events of the log: kind, time, request_id, transport, method, code, took_ms."""
    return calls_.where(F.col("ended").isNotNull()).select(F.lit("rpc_completed").alias("kind"), F.col("ended").alias("time"), "request_id", "transport", "method", "code", "took_ms")
