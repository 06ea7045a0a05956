"""Streams with state of their own for each key: the live display and the scheduling of scans.

Rows wait in a list until the watermark has passed them, and are then taken in order, whatever
batches and frames they came in; what comes later than the watermark allows is dropped by Spark. A
key has one timer, for the next thing that it waits for. State is kept by the RocksDB provider
(use_rocksdb), which spark.sql.streaming.stateStore.providerClass has to name before a query starts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ms(micros: int) -> int:
    """The first millisecond that is not before it: a watermark there has passed it."""
    return -(-micros // 1000)


class _InOrder(StatefulProcessor):
    """Rows (micros, order as text, row as JSON) of a key, handed to take() in order once the watermark has passed them."""

    #: Columns of the value that a key keeps beside its waiting rows.
    KEPT = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros long, place string, row string")
        self.kept = handle.getValueState("kept", self.KEPT)

    def close(self) -> None:
        pass

    def new(self) -> dict[str, Any]:
        raise NotImplementedError

    def take(self, state: dict[str, Any], micros: int, row: dict[str, Any]) -> Iterator[tuple]:
        """Change state by a row; what comes out of it."""
        raise NotImplementedError

    def passed(self, state: dict[str, Any], watermark: int) -> Iterator[tuple]:
        """What comes out as all rows up to watermark (ms) have been taken."""
        return iter(())

    def next_time(self, state: dict[str, Any]) -> list[int]:
        """Milliseconds at which passed() has something to do."""
        return []

    def frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def _state(self) -> dict[str, Any]:
        return json.loads(self.kept.get()[0]) if self.kept.exists() else self.new()

    def _wait(self, times: list[int]) -> None:
        """One timer, at the earliest of times."""
        set_ = list(self.handle.listTimers())
        wanted = min(times) if times else None
        for t in set_:
            if t != wanted:
                self.handle.deleteTimer(t)
        if wanted is not None and wanted not in set_:
            self.handle.registerTimer(wanted)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [x for frame in rows for x in zip(frame["micros"].tolist(), frame["place"].tolist(), frame["row"].tolist(), strict=True)]
        self.waiting.appendList(new)
        self._wait([_ms(min(m for m, _, _ in new)), *self.handle.listTimers()])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        ready, left = [], []
        for x in self.waiting.get() if self.waiting.exists() else ():
            (ready if _ms(x[0]) <= watermark else left).append(tuple(x))
        state, out = self._state(), []
        for micros, place, row in sorted(ready, key=lambda x: (x[0], json.loads(x[1]))):
            out += self.take(state, micros, json.loads(row))
        out += self.passed(state, watermark)
        if ready:
            self.waiting.put(left) if left else self.waiting.clear()
        if state == self.new():
            self.kept.clear()
        else:
            self.kept.update((json.dumps(state),))
        self._wait([*[_ms(m) for m, _, _ in left], *self.next_time(state)])
        if out:
            yield self.frame(key, out)


def _rows(events: DataFrame, key: str, at: str, order: list[str], late: str) -> DataFrame:
    """key, at, and each row as what _InOrder reads."""
    listed = F.to_json(F.array(*[F.col(c).cast("long") for c in order])) if order else F.lit("[]")
    marked = events.withWatermark(at, late)
    return marked.select(F.col(key).alias("key"), F.col(at).alias("at"), F.unix_micros(at).alias("micros"), listed.alias("place"), F.to_json(F.struct(*[c for c in events.columns if c not in (at,)]), {"ignoreNullFields": "true"}).alias("row"))


# --- the live display ----------------------------------------------------------------------------

#: What a viewer shows after each event, beside the event itself; the same as operators.events.display gives.
SHOWN = (
    "pending long, active_document string, active_stage string, ingested_total long, chunks_total long, failed_total long, "
    "last_error string, last_scan_ms long, last_batch_ms long, state string"
)
_SHOWN = [c.split()[0] for c in SHOWN.split(", ")]
_ENDS = ("document_ingested", "document_failed", "document_deleted")


def shown_after(state: dict[str, Any], e: dict[str, Any]) -> None:
    """Change what is shown by one event."""
    kind = e.get("kind")
    if kind == "document_queued":
        state["live"] = True
        state["pending"] += 1
    elif kind in _ENDS:
        state["pending"] = max(0, state["pending"] - 1)
    elif kind == "snapshot" and not state["live"]:
        state["pending"] = max(0, e.get("pending_documents") or 0)
        state["active_document"], state["active_stage"] = e.get("active_document") or "", e.get("active_stage") or ""
    if kind in ("document_reading", "document_embedding"):
        state["active_document"], state["active_stage"] = e.get("uri"), kind.removeprefix("document_")
    elif kind in _ENDS and not state["pending"]:
        state["active_document"] = state["active_stage"] = ""
    if kind == "document_ingested":
        state["ingested_total"] += 1
        state["chunks_total"] += e.get("chunk_count") or 0
    elif kind == "document_failed":
        state["failed_total"] += 1
        state["last_error"] = ": ".join(x for x in (e.get("uri"), e.get("error")) if x is not None)
    elif kind == "scan_finished":
        if e.get("error") and e.get("source_id") is not None:
            state["last_error"] = f"scan {e['source_id']}: {e['error']}"
        state["last_scan_ms"] = state["last_scan_ms"] if e.get("took_ms") is None else e["took_ms"]
    elif kind == "rpc_completed" and (e.get("transport"), e.get("method")) == ("grpc", "IngestBatch") and e.get("took_ms") is not None:
        state["last_batch_ms"] = e["took_ms"]
    if kind in ("snapshot", "worker_state_changed") and e.get("worker_state") is not None:
        state["state"] = e["worker_state"]


class Display(_InOrder):
    """What a viewer shows after each event of a key."""

    KEPT = "shown string"

    def new(self) -> dict[str, Any]:
        return {"live": False, "pending": 0, "active_document": "", "active_stage": "", "ingested_total": 0, "chunks_total": 0, "failed_total": 0, "last_error": None, "last_scan_ms": None, "last_batch_ms": None, "state": None}

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        """A snapshot row that a key starts from, as if it had come before all its events."""
        state = self.new()
        for row in initialState["row"].tolist():
            shown_after(state, json.loads(row) | {"kind": "snapshot"})
        self.kept.update((json.dumps(state),))

    def take(self, state: dict[str, Any], micros: int, row: dict[str, Any]) -> Iterator[tuple]:
        shown_after(state, row)
        yield (row["__row"], *[state[c] for c in _SHOWN])

    def frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(("row", *_SHOWN), zip(*rows, strict=True), strict=True)})


def display(events: DataFrame, key: str, at: str, order: list[str], late: str = "10 seconds", snapshot: DataFrame | None = None) -> DataFrame:
    """events with the columns of SHOWN, as operators.events.display(events, key, [at, *order]) has them, each once the watermark has passed it.

    order breaks ties of at and has whole numbers. snapshot, if given, has a row for each key that doesn't start from nothing:
    key, pending_documents, active_document, active_stage, worker_state.
    """
    whole = events.withColumn("__row", F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}))
    first = None if snapshot is None else snapshot.select(F.col(key).alias("key"), F.to_json(F.struct(*[c for c in snapshot.columns if c != key])).alias("row")).groupBy("key")
    grouped = _rows(whole, key, at, order, late).groupBy("key")
    out = grouped.transformWithStateInPandas(Display(), f"row string, {SHOWN}", "append", "eventTime", first)
    back = F.from_json("row", events.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    own = [F.col("__e").getField(c).alias(c) for c in events.columns if c not in _SHOWN]  # what is shown takes the place of an event's own column of that name
    return out.withColumn("__e", back).select(*own, *_SHOWN)


# --- scheduling of scans -------------------------------------------------------------------------


class Schedule(_InOrder):
    """At most one scan of a key waits; requests that come before it begins are part of it. A retry waits until a scan is accepted or it fires."""

    KEPT = "waiting string"

    def new(self) -> dict[str, Any]:
        return {"scan": None, "retry": None}

    def _begin(self, state: dict[str, Any], until: int) -> Iterator[tuple]:
        """What has its time at until (microseconds) or before."""
        scan, retry = state["scan"], state["retry"]
        if scan is not None and scan[1] <= until:
            state["scan"] = None
            yield ("scan", *scan)
        if retry is not None and retry[1] <= until:
            state["retry"] = None
            yield ("retry", *retry, 0)

    def take(self, state: dict[str, Any], micros: int, row: dict[str, Any]) -> Iterator[tuple]:
        yield from self._begin(state, micros)
        kind = row["kind"]
        if kind == "request":
            if state["scan"] is None:
                state["scan"] = [micros, row["planned"], 1]
            else:
                state["scan"][2] += 1
        elif kind == "accepted":
            state["retry"] = None
        elif kind == "finished" and row.get("delay_ms") is not None:
            state["retry"] = [micros, micros + 1000 * row["delay_ms"]]
            yield from self._begin(state, micros)  # a retry without delay

    def passed(self, state: dict[str, Any], watermark: int) -> Iterator[tuple]:
        yield from self._begin(state, 1000 * watermark)

    def next_time(self, state: dict[str, Any]) -> list[int]:
        return [_ms(x[1]) for x in (state["scan"], state["retry"]) if x is not None]

    def frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        what, at, begins, requests = zip(*rows, strict=True)
        return pd.DataFrame({"key": [key[0]] * len(rows), "what": what, "at": at, "begins": begins, "requests": requests})


def schedule(events: DataFrame, key: str, at: str, kind: Column, planned: str, delay_ms: str, late: str = "10 seconds") -> DataFrame:
    """(key, what, at, begins, requests): scans as they begin, and retries as they fire, from one stream of what happens to each key.

    kind is request (with planned, when a scan that it starts would begin), finished (a run ended; with delay_ms it
    asks for a retry after that) or accepted (a scan was; a retry that waits is dropped). Scans equal operators.events.coalesced of
    the requests, retries scheduled_retries of the others. At one time finished comes before accepted.
    """
    rank = F.when(kind == "finished", 0).when(kind == "accepted", 1).otherwise(2)
    known = events.select(F.col(key).alias("key"), F.col(at).alias("at"), kind.alias("kind"), rank.alias("rank"), F.unix_micros(F.col(planned).cast("timestamp")).alias("planned"), F.col(delay_ms).cast("long").alias("delay_ms"))
    grouped = _rows(known, "key", "at", ["rank", "planned"], late).groupBy("key")
    out = grouped.transformWithStateInPandas(Schedule(), f"key {events.schema[key].dataType.simpleString()}, what string, at long, begins long, requests int", "append", "eventTime")
    return out.select(F.col("key").alias(key), "what", F.timestamp_micros("at").alias(at), F.timestamp_micros("begins").alias("begins"), "requests")
