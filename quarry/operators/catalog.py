"""The catalog: sources, what deleting one takes along, strict rows, and the status of all."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.errors import NotFound
from quarry.functions.text import clean_path

SOURCES = "id string, type string, uri string, created_at timestamp"


def added(sources: DataFrame, new: DataFrame) -> DataFrame:
    """sources with those of new whose uri isn't there yet; of several new ones of one uri the first (by created_at, then id) counts. Adding again changes nothing."""
    once = new.groupBy("uri").agg(F.min(F.struct("created_at", "id", "type")).alias("s")).select("s.id", "s.type", "uri", "s.created_at")
    return sources.unionByName(once.join(sources.select("uri"), "uri", "left_anti").select(*sources.columns))


def registrations(sources: DataFrame, new: DataFrame) -> DataFrame:
    """(uri, id, created): for each uri of new the source that it stands for, and whether it is a new one."""
    once = new.groupBy("uri").agg(F.min(F.struct("created_at", "id")).alias("s"))
    known = sources.groupBy("uri").agg(F.min(F.struct("created_at", "id")).alias("k"))
    return once.join(known, "uri", "left").select("uri", F.coalesce("k.id", "s.id").alias("id"), F.col("k").isNull().alias("created"))


def by_id(sources: DataFrame, source_id: str) -> DataFrame:
    return sources.where(F.col("id") == source_id)


def by_uri(sources: DataFrame, uri: str) -> DataFrame:
    return sources.where(F.col("uri") == uri)


def in_order(sources: DataFrame) -> DataFrame:
    """Oldest first."""
    return sources.orderBy("created_at", "id")


def resolve(sources: DataFrame, wanted: str) -> str:
    """The id of the source with this id or path; a path may be relative, begin with ~ or end in a slash. Otherwise an error that lists what is registered."""
    path = os.path.normpath(os.path.abspath(os.path.expanduser(wanted)))
    found = in_order(sources.where((F.col("id") == wanted) | (clean_path(F.col("uri")) == path))).limit(1).collect()
    if found:
        return found[0]["id"]
    known = [r["uri"] for r in in_order(sources).limit(20).collect()]
    raise NotFound(f"no source matches {wanted!r}; registered: {', '.join(known)}" if known else "no sources are registered")


def deleted(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables (chunks, documents, failures, sources, in this order) without the sources whose ids gone (id) holds."""
    ids = gone.select(F.col("id").alias("source_id")).distinct()
    return {name: tables[name].join(ids if name != "sources" else ids.withColumnRenamed("source_id", "id"), "source_id" if name != "sources" else "id", "left_anti").select(*tables[name].columns) for name in ("chunks", "documents", "failures", "sources") if name in tables}


def strict_time(text: Column) -> Column:
    """A time from text; text that is none is an error of the job, never a zero or null. Null stays null."""
    return F.to_timestamp(text)


def with_fingerprints(documents: DataFrame) -> DataFrame:
    """Documents of any age: a fingerprint column where there was none, empty for unknown."""
    own = F.coalesce(F.col("fingerprint"), F.lit("")) if "fingerprint" in documents.columns else F.lit("")
    return documents.withColumn("fingerprint", own)


def stats(sources: DataFrame, documents: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: sources, documents, chunks, failures."""
    chunks = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunks"))
    return sources.agg(F.count("*").alias("sources")).crossJoin(chunks).crossJoin(failures.agg(F.count("*").alias("failures")))  # one row each


def status(sources: DataFrame, documents: DataFrame, failures: DataFrame, pending_scans: Column, pending_documents: Column, document: Column, stage: Column, most: int = 1000) -> DataFrame:
    """One row: stats, activity, and the newest failures (at most so many listed, all counted)."""
    newest = failures.orderBy(F.desc("failed_at"), "source_id", "uri").limit(most)
    shown = newest.agg(F.array_sort(F.collect_list(F.struct("source_id", "uri", "attempts", "error", "failed_at")), lambda a, b: F.when(a["failed_at"] > b["failed_at"], -1).when(a["failed_at"] < b["failed_at"], 1).when(a["source_id"] < b["source_id"], -1).when(a["source_id"] > b["source_id"], 1).when(a["uri"] < b["uri"], -1).otherwise(1)).alias("newest"))
    activity = F.struct(pending_scans.alias("pending_scans"), pending_documents.alias("pending_documents"), document.alias("document"), stage.alias("stage"))
    return stats(sources, documents, failures).crossJoin(shown).withColumn("activity", activity)
