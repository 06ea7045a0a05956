"""Batch views of the event log."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.jobs.scratch import written


def replay(events: DataFrame, n: int = 512, order: str = "event_id") -> DataFrame:
    """The newest n events, oldest first."""
    return events.orderBy(F.desc(order)).limit(n).orderBy(order)


def transitions(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """Rows whose state differs from the one before, of the same key; the first of a key is none."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("from_state", F.lag(state).over(w)).where(F.col("from_state").isNotNull() & (F.col("from_state") != F.col(state)))


def debounced(hints: DataFrame, key: str, ts: str, quiet_us: int) -> DataFrame:
    """(key, first, fires, hints): hints no more than quiet apart are one scan, which fires after that quiet."""
    w = Window.partitionBy(key).orderBy(ts)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    opened = hints.withColumn("__at", at).withColumn("__new", F.when(F.col("__at") - F.lag("__at").over(w) <= quiet_us, 0).otherwise(1))
    runs = opened.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "__run").agg(F.min(ts).alias("first"), F.max(ts).alias("__last"), F.count("*").alias("hints")).select(key, "first", (F.col("__last") + F.expr(f"INTERVAL '{quiet_us / 1e6:f}' SECOND")).alias("fires"), "hints")


def idle_gaps(events: DataFrame, key: str, ts: str, least_us: int) -> DataFrame:
    """(key, idle_from, idle_until) of pauses of at least least_us microseconds."""
    w = Window.partitionBy(key).orderBy(ts)
    nxt = F.lead(ts).over(w)
    gap = F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return events.select(key, F.col(ts).alias("idle_from"), nxt.alias("idle_until"), gap.alias("gap_us")).where(F.col("gap_us") >= least_us)


def gauge(events: DataFrame, key: str, step: Column, order: list[str]) -> DataFrame:
    """Running level of steps that never falls under zero: the plain sum less its smallest value so far, where that is negative."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = events.withColumn("__sum", F.sum(step).over(w))
    return summed.withColumn("level", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(w))).drop("__sum")


def retry_delays(failures: DataFrame, key: str, attempts: str, base_ms: int, most: int = 3) -> DataFrame:
    """(key, delay_ms): the longest doubling delay over its documents; those tried more than most times are left alone."""
    delay = F.when(F.col(attempts) <= most, F.expr(f"shiftleft({base_ms}, int({attempts} - 1))"))
    return failures.groupBy(key).agg(F.max(delay).alias("delay_ms"))


#: Kinds of events. Fixed values.
KINDS = (
    "scan_started", "scan_finished", "document_queued", "document_reading", "document_embedding", "document_ingested",
    "document_failed", "document_deleted", "worker_state_changed", "worker_progress", "rpc_completed", "snapshot",
)
UNLISTED = ("worker_progress", "rpc_completed", "snapshot")
#: One shape for all kinds; fields that a kind lacks are null.
SCHEMA = (
    "seq long, kind string, time timestamp, request_id string, source_id string, document_id string, uri string, chunk_count int, error string, ingested int, unchanged int, removed int, failed int, "
    "transport string, method string, code string, took_ms long, phase string, done long, total long, unit string, worker_state string, from_state string, detail string, "
    "pending_scans int, pending_documents int, active_document string, active_stage string, sources int, documents int, chunks int, ingest_failures int"
)


def numbered(events: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """events with their place in the order, from 1, without one task for all: sorted partitions are written once, counted, then numbered on from the sums before them. Rows that tie in order take any of their places."""
    ranged = events.repartitionByRange(*order).sortWithinPartitions(*order)
    own = written(ranged.withColumn("__id", F.monotonically_increasing_id()), "numbered")  # partition and place in it, fixed by writing
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = own.groupBy(part.alias("__part")).agg((F.max(place) + 1).alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__size")  # one row a partition
    return own.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, place + 1 + F.col("__before")).drop("__part", "__id", "__before")


def of_kinds(events: DataFrame, kinds: str, kind: str = "kind") -> DataFrame:
    """Events of the kinds of a comma list; blanks around them don't count, an empty list is all."""
    wanted = [k.strip() for k in kinds.split(",") if k.strip()]
    return events.where(F.col(kind).isin(wanted)) if wanted else events


def attempts(failures: DataFrame, key: str | list[str], error: str, at: str) -> DataFrame:
    """(key, attempts, error, failed_at): how often each failed, and the newest error."""
    keys = [key] if isinstance(key, str) else key
    return failures.groupBy(*keys).agg(F.count("*").alias("attempts"), F.max_by(error, at).alias("error"), F.max(at).alias("failed_at"))


def newest_first(failures: DataFrame, n: int, at: str = "failed_at", tie: str | None = None) -> DataFrame:
    order = [F.desc(at), *([F.asc(tie)] if tie else [])]
    return failures.orderBy(*order).limit(n)


def rates(events: DataFrame, counted: list[str], started: Column, now: Column, warm_s: float = 5.0) -> DataFrame:
    """One row: per minute rates of the sums of counted between started and now; null for the first seconds."""
    seconds = (F.unix_micros(now) - F.unix_micros(started)) / 1e6
    return events.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted]).select(*[F.when(seconds >= warm_s, F.col(c) / (seconds / 60)).alias(f"{c}_per_minute") for c in counted])


def per_minute(events: DataFrame, ts: str, kind: str, unit: str = "hour") -> DataFrame:
    minutes = {"minute": 1, "hour": 60, "day": 1440}[unit]
    return events.groupBy(F.date_trunc(unit, ts).alias(unit), kind).agg(F.count("*").alias("n"), (F.count("*") / minutes).alias("per_minute"))


def coalesced(requests: DataFrame, key: str, at: str, planned: str) -> DataFrame:
    """(key, at, requests): scans that run. A request waits until planned, when its scan begins; those that come while one waits are part of it, one after that begins the next.

    requests has, for each request, the time at which a scan that it starts would begin; a plain window
    can't tell which requests start one, so each key's requests pass in order through one task, which
    holds one Arrow frame and the scan that waits. Requests without a time come first and never wait.
    """
    sent = requests.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("__at"), F.unix_micros(F.col(planned).cast("timestamp")).alias("__planned"))
    kind = sent.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # key, at, planned, requests
        for batch in batches:
            done = []
            for k, t, begins in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if waiting and waiting[0] == k and t is not None and waiting[2] is not None and t < waiting[2]:
                    waiting[3] += 1
                    continue
                if waiting:
                    done.append(waiting)
                waiting = [k, t, begins, 1]
            if done:
                yield _frame(done, batch.schema)
        if waiting:
            yield _frame([waiting], batch.schema)

    def _frame(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*schema.types, pa.int32()], strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[*schema.names, "requests"])

    runs = sent.repartition(key).sortWithinPartitions(key, "__at", "__planned").mapInArrow(fold, f"`{key}` {kind}, __at long, __planned long, requests int")
    return runs.select(key, F.timestamp_micros("__at").alias(at), F.timestamp_micros("__planned").alias(planned), "requests")


def first_in_line(requests: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order): of the requests that wait, the first of each key keeps its place."""
    return requests.groupBy(key).agg(F.min(order).alias(order))


def scheduled_retries(runs: DataFrame, accepted: DataFrame, key: str, finished: str, delay_ms: str, at: str) -> DataFrame:
    """(key, fires): retries that come to fire. A run asks for one delay_ms after it finished; any scan accepted in between replaces it, and a run without a delay asks for none."""
    every = runs.where(F.col(delay_ms).isNotNull()).select(key, F.col(finished).alias("__t"), F.lit(0).alias("__kind"), F.col(delay_ms).cast("long").alias("__delay"))
    every = every.unionByName(accepted.select(key, F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__delay")))
    following = Window.partitionBy(key).orderBy("__t", "__kind")
    fires = F.timestamp_micros(F.unix_micros(F.col("__t").cast("timestamp")) + F.col("__delay") * 1000)
    nxt = F.lead("__t").over(following)
    return every.withColumns({"fires": fires, "__next": nxt}).where("__kind = 0 AND (__next IS NULL OR __next >= fires)").select(key, "fires")


def lines(events: DataFrame) -> DataFrame:
    """One compact JSON object an event; fields that are null, zero, false or empty are left out, but for seq, kind and time."""
    kept = ("seq", "kind", "time")

    def present(name: str, kind: str) -> Column:
        c = F.col(name)
        if name in kept or kind.startswith(("timestamp", "date", "struct")):
            return c
        empty = (c == "") if kind == "string" else (c == F.lit(False)) if kind == "boolean" else F.size(c) == 0 if kind.startswith(("array", "map")) else (c == 0)
        return F.when(~empty, c)

    return events.select(F.to_json(F.struct(*[present(n, k).alias(n) for n, k in events.dtypes]), {"ignoreNullFields": "true"}).alias("line"))


def decoded_stream(frames: DataFrame, schema: str = SCHEMA, column: str = "value") -> DataFrame:
    """Events from the lines of an event stream: only those that begin with "data: " count, and what isn't a JSON object is left out."""
    data = frames.where(F.startswith(column, F.lit("data: "))).select(F.substring(column, 7, 1 << 30).alias("__data"))
    listed = F.try_parse_json(F.concat(F.lit("["), F.col("__data"), F.lit("]")))  # in brackets, what follows a whole object is an error
    parsed = data.select(F.from_json("__data", schema, {"mode": "PERMISSIVE"}).alias("e"), listed.alias("__v"))
    one = F.startswith(F.schema_of_variant(F.try_variant_get("__v", "$[0]", "variant")), F.lit("OBJECT")) & F.try_variant_get("__v", "$[1]", "variant").isNull()
    return parsed.where(one).select("e.*")


def snapshot(sources: DataFrame, documents: DataFrame, failures: DataFrame, pending_scans: Column, pending_documents: Column) -> DataFrame:
    """One gauge row: what is indexed, what failed, what waits."""
    counts = sources.agg(F.count("*").alias("sources")).crossJoin(documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))).crossJoin(failures.agg(F.count("*").alias("ingest_failures")))  # one row each
    return counts.select(F.lit("snapshot").alias("kind"), pending_scans.alias("pending_scans"), pending_documents.alias("pending_documents"), "*")


def display(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """events with what a viewer would show after each: pending, active_document, active_stage, ingested_total, chunks_total, failed_total, last_error, last_scan_ms, last_batch_ms, state.

    pending never falls under zero; before the first queued document of a key, snapshots set it (and
    what is active), afterwards only events do. When nothing is pending any more nothing is active.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("kind")
    ends = kind.isin("document_ingested", "document_failed", "document_deleted")
    live = events.withColumn("__live", F.coalesce(F.max(kind == "document_queued").over(w), F.lit(False)))
    seeds = (kind == "snapshot") & ~F.col("__live")
    step = F.when(kind == "document_queued", 1).when(ends, -1).otherwise(0)
    part = live.withColumn("__part", F.sum(F.when(seeds, 1).otherwise(0)).over(w))
    own = Window.partitionBy(key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = part.withColumns({"__sum": F.sum(step).over(own), "__seed": F.coalesce(F.first(F.when(seeds, F.col("pending_documents"))).over(own), F.lit(0))})
    level = summed.withColumn("pending", F.col("__sum") + F.greatest(F.col("__seed"), -F.min("__sum").over(own)))
    nothing = F.struct(F.lit("").alias("document"), F.lit("").alias("stage"))
    set_ = (
        F.when(kind == "document_reading", F.struct(F.col("uri").alias("document"), F.lit("reading").alias("stage"))).when(kind == "document_embedding", F.struct(F.col("uri").alias("document"), F.lit("embedding").alias("stage")))
        .when(seeds, F.struct(F.coalesce("active_document", F.lit("")).alias("document"), F.coalesce("active_stage", F.lit("")).alias("stage"))).when(ends & (F.col("pending") == 0), nothing)
    )
    said = F.when(kind == "document_failed", F.concat_ws(": ", "uri", "error")).when((kind == "scan_finished") & (F.col("error") != ""), F.concat(F.lit("scan "), F.col("source_id"), F.lit(": "), F.col("error")))
    of = lambda c: F.last(c, ignorenulls=True).over(w)
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    active = F.coalesce(of(set_), nothing)
    return level.withColumns({
        "__active": active, "ingested_total": total(F.when(kind == "document_ingested", 1)), "chunks_total": total(F.when(kind == "document_ingested", F.col("chunk_count"))), "failed_total": total(F.when(kind == "document_failed", 1)),
        "last_error": of(said), "last_scan_ms": of(F.when(kind == "scan_finished", F.col("took_ms"))), "last_batch_ms": of(F.when((kind == "rpc_completed") & (F.col("transport") == "grpc") & (F.col("method") == "IngestBatch"), F.col("took_ms"))),
        "state": of(F.when(kind.isin("snapshot", "worker_state_changed"), F.col("worker_state"))),
    }).withColumns({"active_document": F.col("__active.document"), "active_stage": F.col("__active.stage")}).drop("__live", "__part", "__sum", "__seed", "__active")
