"""The scan planner: an authoritative scan against the catalog, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import clean_path

KEYS = ["source_id", "uri"]


def unchanged(scan_hash: Column, scan_print: Column, hash_: Column, print_: Column) -> Column:
    """A known hash decides alone; otherwise a known fingerprint does. Empty means unknown."""
    return F.when(scan_hash != "", scan_hash == hash_).otherwise((scan_print != "") & (scan_print == print_))


def plan(scan: DataFrame, catalog: DataFrame) -> DataFrame:
    """(source_id, uri, action): unchanged, new, changed or vanished. Both sides have content_hash and fingerprint."""
    s = scan.select(*KEYS, F.col("content_hash").alias("s_hash"), F.col("fingerprint").alias("s_print"), F.lit(True).alias("scanned"))
    c = catalog.select(*KEYS, F.col("content_hash").alias("c_hash"), F.col("fingerprint").alias("c_print"), F.lit(True).alias("known"))
    action = (
        F.when(F.col("scanned").isNull(), "vanished").when(F.col("known").isNull(), "new")
        .when(unchanged(F.col("s_hash"), F.col("s_print"), F.col("c_hash"), F.col("c_print")), "unchanged").otherwise("changed")
    )
    return s.join(c, KEYS, "full_outer").select(*KEYS, action.alias("action"))


def totals(planned: DataFrame) -> DataFrame:
    """Ingested, unchanged and removed documents of each source."""
    count = lambda *kinds: F.count_if(F.col("action").isin(*kinds))
    return planned.groupBy("source_id").agg(count("new", "changed").alias("ingested"), count("unchanged").alias("unchanged"), count("vanished").alias("removed"))


def refreshed(read: DataFrame, catalog: DataFrame) -> DataFrame:
    """Documents that were read because their fingerprint moved, but have the stored hash: only the fingerprint is new."""
    c = catalog.where("content_hash <> ''").select(*KEYS, F.col("content_hash").alias("stored"), F.col("fingerprint").alias("old_fingerprint"))
    return read.join(c, KEYS).where("content_hash = stored AND fingerprint <> old_fingerprint").select(*KEYS, "old_fingerprint", "fingerprint")


def orphans(failures: DataFrame, scan: DataFrame, catalog: DataFrame) -> DataFrame:
    """Failures whose document is neither scanned nor known."""
    return failures.join(scan.select(*KEYS).distinct(), KEYS, "left_anti").join(catalog.select(*KEYS).distinct(), KEYS, "left_anti")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catalog after an upsert: known documents keep their id, everything else is taken from new where it is there."""
    n = new.select(*KEYS, *[F.col(c).alias(f"new_{c}") for c in new.columns if c not in KEYS])
    joined = old.join(n, KEYS, "full_outer")
    return joined.select(*KEYS, F.coalesce("id", "new_id").alias("id"), *[F.coalesce(f"new_{c}", c).alias(c) for c in old.columns if c not in (*KEYS, "id")])


def _above(path: Column) -> Column:
    """The folders above a clean path, the root first."""
    parts = F.split(path, "/", -1)
    short = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when((path == "/") | ~F.contains(path, F.lit("/")), F.array().cast("array<string>")).otherwise(F.transform(short, lambda p: F.when(p == "", "/").otherwise(p)))


def nesting(sources: DataFrame) -> DataFrame:
    """(id, other, relation): for each source the first of the earlier ones, in the order of ids, that equals, contains or lies in it.

    Paths are compared clean and by whole components. Only the smallest id of each path can be the
    first of anything, so paths are reduced to it before the equi-joins on the folders above them.
    """
    own = sources.select("id", clean_path(F.col("uri")).alias("path"))
    paths = own.groupBy("path").agg(F.min("id").alias("equal"))
    above = paths.select("path", "equal", F.explode(_above(F.col("path"))).alias("folder"))
    inside = above.join(paths.select(F.col("path").alias("folder"), F.col("equal").alias("other")), "folder").groupBy("path").agg(F.min("other").alias("inside"))
    contains = above.groupBy("folder").agg(F.min("equal").alias("contains")).withColumnRenamed("folder", "path")
    found = own.join(paths, "path").join(inside, "path", "left").join(contains, "path", "left")
    earlier = [F.when(F.col(k) < F.col("id"), F.struct(F.col(k).alias("other"), F.lit(k).alias("relation"))) for k in ("equal", "inside", "contains")]
    first = found.select("id", F.array_min(F.array_compact(F.array(*earlier))).alias("first"))
    return first.where("first IS NOT NULL").select("id", "first.other", "first.relation")


def conflicts(candidates: DataFrame, registered: DataFrame) -> DataFrame:
    """(uri, id, relation): for each candidate path the first registered source (by created_at, then id) that equals, contains or lies in it.

    Equal paths are no conflict: registering again is allowed. Paths that aren't absolute conflict with nothing.
    """
    ordered = registered.where(F.startswith("uri", F.lit("/"))).select("id", clean_path(F.col("uri")).alias("path"), F.struct("created_at", "id").alias("place"))
    asked = candidates.where(F.startswith("uri", F.lit("/"))).select("uri", clean_path(F.col("uri")).alias("path")).distinct()
    paths = ordered.groupBy("path").agg(F.min("place").alias("place"))
    below = paths.select(F.explode(_above(F.col("path"))).alias("path"), "place").groupBy("path").agg(F.min("place").alias("place"))
    over = asked.select("uri", F.explode(_above(F.col("path"))).alias("path"))
    every = [asked.join(paths, "path").withColumn("relation", F.lit("equal")), over.join(paths, "path").withColumn("relation", F.lit("inside")), asked.join(below, "path").withColumn("relation", F.lit("contains"))]
    hits = every[0].unionByName(every[1]).unionByName(every[2]).groupBy("uri").agg(F.min(F.struct("place", "relation")).alias("first"))
    return hits.select("uri", F.col("first.place.id").alias("id"), "first.relation").where("relation <> 'equal'")
