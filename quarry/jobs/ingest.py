"""One scan of a folder into an index: reconcile, read what may have changed, parse, chunk, embed, publish.

Chunks are published before documents: if a run breaks off between the two, the next one finds
the documents changed and writes them again. Documents that can't be ingested become rows of
failures with their stage and attempts, never an exception of the run, and what the index had of
them stays. Only the parts of the tables that changed documents lie in are written.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import Conflict, NotFound
from quarry.functions import ids, text
from quarry.jobs import store
from quarry.operators import catalog, chunking, embedding, reconcile, syntax, table_functions
from quarry.sources import localtree

DOCUMENTS = "id string, source_id string, bucket int, uri string, content_hash string, fingerprint string, chunk_count int, ingested_at timestamp"
CHUNKS = "point_id string, document_id string, source_id string, bucket int, uri string, chunk_index int, text string, start_line int, end_line int, embedding array<float>"
FAILURES = "source_id string, bucket int, uri string, attempts int, stage string, error string, failed_at timestamp"
MODEL = "hashed-words"
#: Bytes of a file beyond which it fails.
MOST_BYTES = 32 << 20


def _reader(most_bytes: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, uri in enumerate(batch.column("uri").to_pylist()):  # one file at a time is in memory
                content, stage, error = None, None, None
                try:
                    if Path(uri).stat().st_size > most_bytes:
                        stage, error = "RESOURCE_LIMIT", f"the file has more than {most_bytes} bytes"
                    else:
                        content = Path(uri).read_bytes()
                except OSError as e:
                    stage, error = "READ", e.strerror
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([content], pa.binary()), pa.array([stage], pa.string()), pa.array([error], pa.string())], names=[*batch.schema.names, "content", "stage", "error"])

    return read


def _touched(*changed: DataFrame) -> list[tuple[str, int]]:
    """The (source, bucket) parts that rows lie in: at most store.BUCKETS for a source."""
    out = None
    for df in changed:
        one = df.select(*store.LAYOUT).distinct()
        out = one if out is None else out.unionByName(one).distinct()
    return sorted((r["source_id"], r["bucket"]) for r in out.collect())


def ingest(spark: SparkSession, path: str, index: str, source_id: str, most_bytes: int = MOST_BYTES, most_chunks: int = chunking.MOST_CHUNKS, model: str = MODEL, chunker: str = "auto") -> dict[str, int]:
    """Bring index up to date with path; returns the totals of the run.

    The tree is listed once and each file read once, into tables beside the index; all that follows
    comes from these, so a lost executor can't mix two states of a file. They are deleted at the end,
    whether the run succeeds or not; what a killed run left is deleted by a later one.
    """
    _forget(spark, f"{index}/incoming")
    incoming = f"{index}/incoming/{uuid.uuid4().hex}"
    try:
        return _ingest(spark, path, index, source_id, most_bytes, most_chunks, model, chunker, incoming)
    finally:
        store.discard(spark, incoming)


def _forget(spark: SparkSession, left: str) -> None:
    """Delete what runs that were killed left, once no run can still be at work on it."""
    fs, folder = store._fs(spark, left)
    for old in fs.listStatus(folder) if fs.exists(folder) else []:
        if time.time() - old.getModificationTime() / 1000 > store.STALE_S:
            fs.delete(old.getPath(), True)


def _once(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stored(publish: Callable[[], int]) -> str | None:
    """What kept publish from storing, in short; another run at work is no failure of documents, but of this run."""
    try:
        publish()
    except Conflict:
        raise
    except Exception as e:  # whatever the storage or the job raises; the documents are failures of the stage STORE
        return (str(e).splitlines() or [type(e).__name__])[0][:500]
    return None


def _ingest(spark: SparkSession, path: str, index: str, source_id: str, most_bytes: int, most_chunks: int, model: str, chunker: str, incoming: str) -> dict[str, int]:
    root = localtree.canonical(path)
    if model not in embedding.MODELS:
        raise NotFound(f"no model {model!r}; there are {', '.join(sorted(embedding.MODELS))}")
    embedder = embedding.MODELS[model]
    store.check_manifest(spark, index, embedder.name, embedder.dimension)
    mine, failures = (store.read_parts(spark, f"{index}/{n}", s, source_id) for n, s in (("documents", DOCUMENTS), ("failures", FAILURES)))
    scan = _once(localtree.scan(spark, root).withColumn("source_id", F.lit(source_id)), f"{incoming}/scan")
    plan = reconcile.plan(scan, mine).persist()
    wanted = scan.join(plan.where("action IN ('new', 'changed')"), reconcile.KEYS).drop("content_hash", "action")
    schema = ", ".join(f"{c} {t}" for c, t in wanted.dtypes)
    taken = wanted.where(text.supported(F.col("mime_type"))).mapInArrow(_reader(most_bytes), f"{schema}, content binary, stage string, error string").withColumn("content_hash", ids.content_hash(F.col("content")))
    unparsed = wanted.where(~text.supported(F.col("mime_type"))).select("*", F.lit(None).cast("binary").alias("content"), F.lit("PARSE").alias("stage"), F.concat(F.lit("no parser for "), F.col("mime_type")).alias("error"), F.lit(None).cast("string").alias("content_hash"))
    known = mine.select(*reconcile.KEYS, "id", F.col("content_hash").alias("stored"), F.col("chunk_count").alias("old_count"), F.col("ingested_at").alias("old_time"))
    body, line = text.parsed(F.col("mime_type"), F.col("content"))
    read = _once(taken.unionByName(unparsed).withColumns({"text": body, "line": line}).drop("content"), f"{incoming}/read").join(known, reconcile.KEYS, "left")
    same = read.where("stage IS NULL AND stored <> '' AND stored = content_hash").withColumn("bucket", store.bucket_of(F.col("id")))
    fresh = read.where("stage IS NULL AND (stored IS NULL OR stored = '' OR stored <> content_hash)").withColumn("document_id", F.coalesce("id", ids.document_id(F.col("source_id"), F.col("uri"))))
    parsed = fresh.select("document_id", "source_id", "uri", "display_path", text.language_of(F.col("mime_type")).alias("language"), "text", "line")
    cut = _once(syntax.chunks(parsed, "document_id", line_col="line") if chunker == "auto" else table_functions.chunks(parsed, chunker, line_col="line"), f"{incoming}/chunks")
    counts = cut.groupBy("document_id").agg(F.count("*").cast("int").alias("chunk_count"))
    beyond = counts.where(F.col("chunk_count") > most_chunks).select("document_id")
    fresh = fresh.drop("text", "line").join(beyond, "document_id", "left_anti").withColumn("bucket", store.bucket_of(F.col("document_id"))).persist()

    asked = text.embed_text(text.label(F.col("display_path"), F.col("uri")), F.col("context"), F.col("text"))
    new = cut.join(beyond, "document_id", "left_anti").withColumns({"point_id": ids.point_id(F.col("document_id"), F.col("chunk_index")), "embedding": embedding.passages(embedder)(asked), "bucket": store.bucket_of(F.col("document_id"))})
    vanished = mine.join(plan.where("action = 'vanished'"), reconcile.KEYS, "left_semi").persist()
    gone = vanished.select(F.col("id").alias("document_id")).unionByName(fresh.select("document_id"))
    touched = _touched(fresh, vanished)
    old = store.read_parts(spark, f"{index}/chunks", CHUNKS, source_id, [b for _, b in touched])
    broken = _stored(lambda: store.publish_parts(store.replaced(old, new.select(*old.columns), gone), f"{index}/chunks", touched))
    lost = fresh.select(*reconcile.KEYS, F.lit("STORE").alias("stage"), F.lit(broken).alias("error"))
    if broken is None:
        lost = lost.limit(0)
    else:  # the index keeps what it had of all that was to change
        fresh, vanished = fresh.limit(0), vanished.limit(0)

    now = F.lit(time.time()).cast("timestamp")
    written = fresh.join(counts, "document_id", "left").select(F.col("document_id").alias("id"), "source_id", "bucket", "uri", "content_hash", "fingerprint", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), now.alias("ingested_at"))
    refreshed = same.select("id", "source_id", "bucket", "uri", "content_hash", "fingerprint", F.col("old_count").alias("chunk_count"), F.col("old_time").alias("ingested_at"))
    touched = _touched(fresh, vanished, same)
    old = store.read_parts(spark, f"{index}/documents", DOCUMENTS, source_id, [b for _, b in touched])
    store.publish_parts(store.replaced(old, written.unionByName(refreshed), vanished, "id"), f"{index}/documents", touched)

    limit = read.join(cut.join(beyond, "document_id", "left_semi").select("source_id", "uri").distinct(), reconcile.KEYS, "left_semi").select(*reconcile.KEYS, F.lit("RESOURCE_LIMIT").alias("stage"), F.lit(f"the document has more than {most_chunks} chunks").alias("error"))
    failed = read.where("stage IS NOT NULL").select(*reconcile.KEYS, "stage", "error").unionByName(limit).unionByName(lost).persist()
    before = failures.select(*reconcile.KEYS, F.col("attempts").alias("tried"))
    renewed = failed.join(before, reconcile.KEYS, "left").select(*reconcile.KEYS, store.bucket_of(F.col("uri")).alias("bucket"), (F.coalesce("tried", F.lit(0)) + 1).cast("int").alias("attempts"), "stage", "error", now.alias("failed_at"))
    # what was read now fails anew or not any more; what is neither scanned nor known is an orphan
    cleared = failures.join(read.select(*reconcile.KEYS).distinct(), reconcile.KEYS, "left_semi").unionByName(failures.join(reconcile.orphans(failures, scan, mine).select(*reconcile.KEYS), reconcile.KEYS, "left_semi"))
    cleared = cleared.unionByName(failures.join(vanished.select(*reconcile.KEYS), reconcile.KEYS, "left_semi"))
    touched = _touched(renewed, cleared)
    old = store.read_parts(spark, f"{index}/failures", FAILURES, source_id, [b for _, b in touched])
    kept = old.join(cleared.select(*reconcile.KEYS).distinct(), reconcile.KEYS, "left_anti").join(renewed.select(*reconcile.KEYS), reconcile.KEYS, "left_anti")
    store.publish_parts(kept.unionByName(renewed.select(*kept.columns)), f"{index}/failures", touched)

    actions = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    totals = {"ingested": fresh.count(), "unchanged": actions.get("unchanged", 0) + same.count(), "removed": vanished.count(), "failed": failed.count()}
    for df in (plan, fresh, vanished, failed):
        df.unpersist()
    for name in ("chunks", "documents", "failures"):
        store.vacuum(spark, f"{index}/{name}")
    return totals


def delete_source(spark: SparkSession, index: str, source_id: str) -> dict[str, int]:
    """Empty all parts of a source: its chunks first, so that no result points to a document that is gone; returns how many parts each table had."""
    out = {}
    for name, schema in (("chunks", CHUNKS), ("documents", DOCUMENTS), ("failures", FAILURES)):
        parts = store.parts_of(spark, f"{index}/{name}", source_id)
        store.publish_parts(spark.createDataFrame([], schema), f"{index}/{name}", parts)
        out[name] = len(parts)
    return out


def stats(spark: SparkSession, index: str) -> DataFrame:
    """One row: sources, documents, chunks and failures of the index."""
    documents, failures = (store.read_parts(spark, f"{index}/{n}", s) for n, s in (("documents", DOCUMENTS), ("failures", FAILURES)))
    return catalog.stats(documents.select("source_id").distinct(), documents, failures)
