"""Exact search over vectors that are laid out so that a query reads only what can hold a hit.

Vectors are filed under the nearest of a few pivots, sorted by their distance from it, and written
in files of bounded size, each of which covers a short stretch of distances (a ring) around a pivot
or a few. By the triangle inequality a ring around a pivot holds no vector nearer to the query than
the distance from the query to the ring. A first look at the rings of the best bounds gives a score that
the limit-th hit must reach; rings whose bound stays below it are never read. What is left is a
filter on two sorted columns, so Parquet's statistics skip files and row groups.

All is done on unit vectors, where cosine c and distance d agree by d * d = 2 - 2 * c. Vectors of
zeros score 0 and have a ring of their own. Vectors that are null, or hold null or non-finite
components, take no part; vectors of several lengths are an error. Keys are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.errors import InvalidArgument
from quarry.operators.search import _Nearest, _unit, nearest

#: Pivots at most; vectors that they are fitted on at most; rounds of fitting.
PIVOTS, SAMPLE, ROUNDS = 64, 4096, 5
#: Vectors of a file, and of a row group in it, about.
FILE_ROWS, GROUP_BYTES = 1 << 18, 4 << 20
#: Rings of the first look; each further look takes four times as many, as often as LOOKS.
FIRST, LOOKS = 4, 3
#: The pivot of vectors of zeros, and what distances may be off by.
ZERO, SLACK = -1, 1e-6


def fine(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))


def fit_pivots(chunks: DataFrame, vector: str = "embedding", key: str = "vec_id", pivots: int = PIVOTS) -> np.ndarray:
    """Centres of a sample of at most SAMPLE vectors, chosen by a hash of the key: only how well parts are told apart rests on them."""
    known = chunks.where(fine(vector))
    rows = known.select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(key).alias("at")).orderBy("at").limit(SAMPLE).collect()
    found = np.array([r["v"] for r in rows], dtype=np.float64)
    if not len(found):
        return np.zeros((0, 0))
    norms = np.linalg.norm(found, axis=1, keepdims=True)
    found = found[norms[:, 0] > 0] / norms[norms[:, 0] > 0]
    if not len(found):
        return np.zeros((0, 0))
    centres = found[:1]
    while len(centres) < min(pivots, len(found)):  # the one farthest from all so far
        gap = (found @ centres.T).max(axis=1)
        if gap.min() > 1 - SLACK:
            break
        centres = np.concatenate([centres, found[[int(gap.argmin())]]])
    for _ in range(ROUNDS):
        own = (found @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, found)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > SLACK, np.divide(sums, size, out=np.zeros_like(sums), where=size > 0), centres)
    return centres


def _apart(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (vectors @ pivots.T), 0))


def _filed(chunks: DataFrame, pivots: np.ndarray, vector: str) -> DataFrame:
    """chunks with the pivot of each vector and its distance from it."""
    place = chunks.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 4096) for k in range(0, batch.num_rows, 4096)):
                unit = _unit(part.column(place))
                none = ~unit.any(axis=1)
                apart = _apart(unit, pivots) if len(pivots) else np.zeros((len(unit), 1))
                own = apart.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.where(none, ZERO, own).astype(np.int32)), pa.array(np.where(none, 0.0, apart[np.arange(len(own)), own]))], names=[*part.schema.names, "pivot", "away"])

    return chunks.mapInArrow(run, chunks.withColumns({"pivot": F.lit(0), "away": F.lit(0.0)}).schema)


def write_parts(chunks: DataFrame, folder: str, vector: str = "embedding", key: str = "vec_id", pivots: int = PIVOTS, file_rows: int = FILE_ROWS) -> None:
    """Lay chunks out under folder (new): vectors, then pivots and the rings of every file, which say that it is whole."""
    spark = chunks.sparkSession
    known = chunks.where(fine(vector))
    rows, least, most = known.agg(F.count("*"), F.min(F.size(vector)), F.max(F.size(vector))).first()
    if least != most:
        raise InvalidArgument(f"vectors have {least} to {most} components")
    centres = fit_pivots(known, vector, key, pivots)
    # the key parts what is equal, so many equal vectors fill several files
    filed = _filed(known, centres, vector).repartitionByRange(max(1, -(-rows // file_rows)), "pivot", "away", key).sortWithinPartitions("pivot", "away", key)
    filed.write.option("parquet.block.size", GROUP_BYTES).parquet(f"{folder}/vectors")
    spark.createDataFrame([(n, [float(x) for x in c]) for n, c in enumerate(centres)], "pivot int, centre array<double>").coalesce(1).write.parquet(f"{folder}/pivots")
    there = spark.read.parquet(f"{folder}/vectors")
    there.groupBy(F.col("_metadata.file_path").alias("file"), "pivot").agg(F.count("*").alias("rows"), F.min("away").alias("near"), F.max("away").alias("far")).write.parquet(f"{folder}/rings")


@dataclass
class Parts:
    """Written parts: all vectors, a row for each ring of a file, and the pivots."""

    vectors: DataFrame
    rings: DataFrame
    pivots: np.ndarray

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Parts:
        rows = spark.read.parquet(f"{folder}/pivots").orderBy("pivot").collect()  # at most PIVOTS
        return cls(spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/rings"), np.array([r["centre"] for r in rows]))

    def bounds(self, query: list[float]) -> tuple[list[float], DataFrame]:
        """Distances of a query from the pivots, and the rings with the best score that each can have."""
        unit = _unit(pa.array([query], pa.list_(pa.float64())))
        if not unit.any() or not len(self.pivots):
            return [0.0] * len(self.pivots), self.rings.withColumn("bound", F.lit(0.0))
        apart = _apart(unit, self.pivots)[0].tolist()
        d = F.element_at(F.array(*[F.lit(x) for x in apart]), F.col("pivot") + 1)
        gap = F.greatest(F.col("near") - d, d - F.col("far"), F.lit(0.0))
        return apart, self.rings.withColumn("bound", F.when(F.col("pivot") == ZERO, 0.0).otherwise(1 - gap * gap / 2))


@dataclass
class Found:
    """hits, and how many of the rings (and vectors in them) their search may read, looks included."""

    hits: DataFrame
    rings: int
    all_rings: int
    rows: int
    all_rows: int


def search_parts(parts: Parts, query: list[float], limit: int, source: Column | None = None, vector: str = "embedding", tie: str = "vec_id") -> Found:
    """What search.nearest gives over all vectors that take part: the limit best by cosine, ties by the tie column."""
    apart, bounded = parts.bounds(query)
    zero = not any(query)
    best, looks = -2.0, FIRST
    for _ in range(LOOKS):
        rings = bounded.orderBy(F.desc("bound"), "file", "pivot").limit(looks + 1).collect()
        own = rings[:looks]
        if sum(r["rows"] for r in own) >= limit:
            within = F.lit(False)
            for r in own:
                within |= (F.col("pivot") == r["pivot"]) & F.col("away").between(r["near"], r["far"])
            hits = nearest(parts.vectors.where(within), query, limit, source, vector, tie).select("score").collect()
            if len(hits) == limit:
                best = max(best, min(h["score"] for h in hits))
        if len(rings) <= looks or rings[-1]["bound"] + SLACK < best:
            break
        looks *= 4
    reach = math.sqrt(max(2 - 2 * best, 0)) + SLACK
    open_ = F.lit(True)
    if best > -2 and not zero:
        open_ = (F.col("pivot") == ZERO) & F.lit(best <= SLACK)
        for n, d in enumerate(apart):
            open_ |= (F.col("pivot") == n) & F.col("away").between(d - reach, d + reach)
    # the looks read rings among those that stay open
    counts = bounded.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0)), F.count_if(F.col("bound") + SLACK >= best), F.coalesce(F.sum(F.when(F.col("bound") + SLACK >= best, F.col("rows"))), F.lit(0))).first()
    hits = nearest(parts.vectors.where(open_), query, limit, source, vector, tie).drop("pivot", "away")
    return Found(hits, int(counts[2]), int(counts[0]), int(counts[3]), int(counts[1]))


def _met(asked: DataFrame, limit: int, vector: str, key: str) -> DataFrame:
    """(query_id, vec_id, score): the limit best of each file for the queries (file, block, query_id, v) that are sent to it.

    A task reads the file from storage, a row group at a time, so no vector passes through a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(file: str, ids: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
            best = _Nearest(np.concatenate(ids), np.concatenate(vectors), limit)
            store, path = fs.FileSystem.from_uri(file)
            with store.open_input_file(path) as f:
                for rows in parquet.ParquetFile(f).iter_batches(4096, columns=[key, vector]):
                    best.meet(rows.column(key).to_numpy().astype(np.int64), _unit(rows.column(vector)))
            n = best.keys.shape[1]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(best.ids, n)), pa.array(best.keys.ravel()), pa.array(best.scores.ravel())], names=["query_id", "vec_id", "score"])

        group, ids, vectors = None, [], []
        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            cuts = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]], len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if group is not None and names[a] != group:
                    yield met(group[0], ids, vectors)
                    ids, vectors = [], []
                group = names[a]
                ids.append(batch.column(2).slice(a, b - a).to_numpy())
                vectors.append(_unit(batch.column(3).slice(a, b - a)))
        if group is not None:
            yield met(group[0], ids, vectors)

    sent = asked.select("file", "block", "query_id", "v")
    return sent.repartition("file", "block").sortWithinPartitions("file", "block").mapInArrow(run, "query_id long, vec_id long, score double")


def search_parts_each(parts: Parts, queries: DataFrame, limit: int, written, most_queries: int = 2048, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, vec_id, score, rank) of many queries, as search.nearest_each gives it.

    Each query goes first to the file of its nearest pivot that covers its distance, then to all other files
    whose rings can hold better ones. Only queries are shuffled, a row for each file that they are sent to, in blocks of
    about most_queries. written(df, name) writes a table and reads it back (jobs.scratch.written).
    """
    centres = parts.pivots
    asked = queries.where(fine(vector)).select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // most_queries)))).cast("int")), "asked")
    if not len(centres):  # nothing, or zeros alone
        first = asked.join(parts.rings.select("file").distinct().withColumn("all", F.lit(1)), F.lit(1) == F.col("all")).drop("all")
        return _ranked(_met(first, limit, vector, key), limit)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column(1))
            d = np.where(unit.any(axis=1, keepdims=True), _apart(unit, centres), np.nan)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32)), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["query_id", "v", "block", "apart"])

    placed = asked.mapInArrow(distances, "query_id long, v array<double>, block int, apart array<double>")
    placed = written(placed.withColumn("d", F.array_min("apart")).withColumn("pivot", (F.array_position("apart", F.col("d")) - 1).cast("int")), "placed")
    # the stretches of a pivot's rings, with the gaps between them: each distance lies in one
    order = Window.partitionBy("pivot").orderBy("near", "far", "file")
    rings = parts.rings.where(F.col("pivot") != ZERO).withColumns({"from": F.when(F.row_number().over(order) == 1, -1.0).otherwise(F.col("near")), "until": F.coalesce(F.lead("near").over(order), F.lit(9.0))})
    own = placed.where(~F.isnan("d")).join(rings.select("pivot", "file", "from", "until"), "pivot").where("d >= from AND d < until").select("query_id", "file", "block", "v")
    seen = written(own, "seen")
    first = written(_met(seen, limit, vector, key), "first")
    best = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).select("query_id", F.when(F.col("n") >= limit, F.col("score")).alias("best"))
    reach = placed.join(best, "query_id", "left").withColumn("best", F.coalesce("best", F.lit(-2.0))).withColumn("reach", F.sqrt(F.greatest(2 - 2 * F.col("best"), F.lit(0.0))) + SLACK)
    each = reach.select("query_id", "block", "v", "best", "reach", F.posexplode("apart").alias("pivot", "apart"))
    near = each.join(parts.rings, "pivot").where(F.isnan("apart") | (F.col("near") <= F.col("apart") + F.col("reach")) & (F.col("far") >= F.col("apart") - F.col("reach")))
    zeros = reach.where((F.col("best") <= SLACK) | F.isnan("d")).withColumn("pivot", F.lit(ZERO)).join(parts.rings.select("pivot", "file"), "pivot")
    files = near.select("query_id", "file", "block", "v").unionByName(zeros.select("query_id", "file", "block", "v")).dropDuplicates(["query_id", "file"])
    rest = files.join(seen.select("query_id", "file"), ["query_id", "file"], "left_anti")
    return _ranked(first.unionByName(_met(rest, limit, vector, key)), limit)


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
