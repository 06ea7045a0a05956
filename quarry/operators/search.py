"""Nearest neighbours and the policy on top of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.errors import InvalidArgument
from quarry.functions.text import is_test_path

#: How far a capped search reaches beyond its limit, and the most that it fetches.
SLACK, MOST = 4, 400


def fetch_limit(limit: int, per_file: int) -> int:
    """Hits to fetch so that a cap of per_file a document can still fill limit."""
    return limit if per_file <= 0 else max(limit, min(limit * SLACK, MOST))


def check_request(limit: int, per_file: int, query: str | None = None) -> None:
    if query is not None and not query.strip():
        raise InvalidArgument("the query must not be empty")
    if not 1 <= limit <= 100:
        raise InvalidArgument("limit must lie between 1 and 100")
    if not 0 <= per_file <= 100:
        raise InvalidArgument("per_file must lie between 0 and 100")


def parse_request(params: dict[str, str]) -> dict:
    """Checked arguments of a search from texts: q, limit (10), source, per_file (2), exclude_tests (only the word true)."""

    def whole(name: str, default: int) -> int:
        try:
            return int(params[name]) if params.get(name) else default
        except ValueError:
            raise InvalidArgument(f"{name} must be an integer") from None

    out = {"query": params.get("q", ""), "limit": whole("limit", 10), "per_file": whole("per_file", 2), "source": params.get("source") or None, "exclude_tests": params.get("exclude_tests") == "true"}
    check_request(out["limit"], out["per_file"], out["query"])
    return out


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is all zeros."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(F.try_divide(_dot(a, b), norms))


def nearest(chunks: DataFrame, query: list[float], limit: int, source: Column | None = None, vector: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """The limit best chunks by cosine, ties by the tie column; the source filter comes before scoring, and so reaches the scan."""
    own = chunks if source is None else chunks.where(source)
    asked = F.array(*[F.lit(float(x)) for x in query])
    return own.withColumn("score", cosine(F.col(vector), asked)).drop(vector).orderBy(F.desc("score"), tie).limit(limit)


def collapse(hits: DataFrame, document: str, per_file: int, limit: int, tie: str = "vec_id") -> DataFrame:
    """The first per_file hits of each document in the order of scores, then the first limit; per_file 0 only cuts."""
    order = [F.desc("score"), F.asc(tie)]
    if per_file > 0:
        hits = hits.withColumn("__n", F.row_number().over(Window.partitionBy(document).orderBy(*order))).where(F.col("__n") <= per_file).drop("__n")
    return hits.orderBy(*order).limit(limit)


def search(chunks: DataFrame, query: list[float], limit: int = 10, per_file: int = 2, source: Column | None = None, exclude_tests: bool = False, document: str = "label", uri: str = "uri", tie: str = "vec_id") -> DataFrame:
    """Fetch, drop tests from what was fetched, cap each document, cut."""
    check_request(limit, per_file)
    hits = nearest(chunks, query, fetch_limit(limit, per_file), source, tie=tie)
    if exclude_tests:
        hits = hits.where(~is_test_path(F.col(uri)))
    return collapse(hits, document, per_file, limit, tie)


#: What a result shows. Fixed values.
RESULT = ("document_id", "source_id", "uri", "chunk_index", "score", "text", "start_line", "end_line")
_TEXTS, _LINES = ("document_id", "source_id", "uri", "text"), ("start_line", "end_line")


def decoded(hits: DataFrame, payload: str = "payload") -> DataFrame:
    """Results from hits with a JSON payload: those that lack a required field, or have it in another type, are left out; missing lines are 0."""
    rows = hits.withColumn("__v", F.try_parse_json(payload))
    of = lambda name, kind: F.try_variant_get("__v", f"$.{name}", kind)
    whole = lambda name: F.when(F.schema_of_variant(of(name, "variant")) == "BIGINT", of(name, "bigint"))
    texts = {n: F.when(F.schema_of_variant(of(n, "variant")) == "STRING", of(n, "string")) for n in _TEXTS}
    lines = {n: F.when(F.coalesce(whole(n), F.lit(-1)).between(0, 2**31 - 1), whole(n)).otherwise(0).cast("int") for n in _LINES}
    out = rows.select(*[c.alias(n) for n, c in (texts | lines).items()], F.when(whole("chunk_index").between(0, 2**31 - 1), whole("chunk_index")).cast("int").alias("chunk_index"), "score")
    return out.dropna(subset=[*_TEXTS, "chunk_index"]).select(*RESULT)


def results(hits: DataFrame) -> DataFrame:
    return hits.select(*RESULT)


def entries(rows: DataFrame, path: Column, most: int = 200) -> DataFrame:
    """(path, line, score, text, display) of results that can be shown: those without a path, line, score or text are left out, lines begin with 1."""
    shown = rows.select(path.alias("path"), F.greatest(F.lit(1), F.floor("start_line")).cast("int").alias("line"), F.col("score").cast("double").alias("score"), F.trim(F.regexp_replace("text", "[ \\t-\\r]+", " ")).alias("text"), F.col("start_line").alias("__line"))
    fine = shown.where(F.col("path").isNotNull() & F.col("__line").isNotNull() & F.col("score").isNotNull() & F.col("text").isNotNull())
    return fine.select("path", "line", "score", "text", F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit("  "), F.format_string("%.4f", "score"), F.lit("  "), F.col("text")).alias("display"))


class _Nearest:
    """The limit best (key, score) of a block of unit query vectors over the candidates that stream past."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, limit: int):
        self.ids, self.vectors, self.limit = ids, vectors, limit
        self.keys, self.scores = np.zeros((len(ids), 0), dtype=np.int64), np.zeros((len(ids), 0))

    def meet(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        scores = np.concatenate([self.scores, self.vectors @ vectors.T], axis=1)
        keys = np.concatenate([self.keys, np.broadcast_to(keys, (len(self.ids), len(keys)))], axis=1)
        best = np.lexsort((keys, -scores), axis=1)[:, : self.limit] if scores.shape[1] <= 4 * self.limit else self._cut(keys, scores)
        self.keys, self.scores = np.take_along_axis(keys, best, 1), np.take_along_axis(scores, best, 1)

    def _cut(self, keys: np.ndarray, scores: np.ndarray) -> np.ndarray:
        least = -np.partition(-scores, self.limit - 1, axis=1)[:, self.limit - 1 : self.limit]
        open_ = int((scores >= least).sum(axis=1).max())  # more than limit where scores are equal
        some = np.argpartition(-scores, min(open_, scores.shape[1]) - 1, axis=1)[:, :open_]
        order = np.lexsort((np.take_along_axis(keys, some, 1), -np.take_along_axis(scores, some, 1)), axis=1)[:, : self.limit]
        return np.take_along_axis(some, order, 1)


def _unit(lists: pa.Array) -> np.ndarray:
    x = np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def nearest_each(chunks: DataFrame, queries: DataFrame, limit: int, most_queries: int = 2048, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, vec_id, rank, score) of many queries at once, by cosine, ties by key.

    Queries are dealt to blocks of about most_queries and chunks to shares by hash, and each block meets each share in one
    task, as a matrix product with the best limit kept; nothing is broadcast. Keys are integers,
    vectors have one length; null vectors take no part.
    """
    rows = chunks.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // most_queries))
    shares = max(1, -(-chunks.sparkSession.sparkContext.defaultParallelism // blocks))

    def dealt(df: DataFrame, own: int, other: int, number, chunk: bool) -> DataFrame:
        mine = df.select("key", "v", F.pmod(F.xxhash64("key", F.spark_partition_id()), F.lit(own)).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("other"))
        return mine.select(number(F.col("mine"), F.col("other")).alias("task"), F.lit(chunk).alias("chunk"), "key", "v")

    met = dealt(asked, blocks, shares, lambda a, b: a * shares + b, False).unionByName(dealt(rows, shares, blocks, lambda a, b: b * shares + a, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, best = [], [], None
        for batch in batches:
            chunk = batch.column(1).to_numpy(zero_copy_only=False)
            first = int(np.searchsorted(chunk, True))  # queries come before chunks
            if first:
                ids.append(np.asarray(batch.column(2))[:first])
                vectors.append(_unit(batch.column(3).slice(0, first)))
            for at in range(first, batch.num_rows, 1024):
                if not ids:
                    return
                if best is None:
                    best = _Nearest(np.concatenate(ids), np.concatenate(vectors), limit)
                part = batch.slice(at, 1024)
                best.meet(np.asarray(part.column(2)), _unit(part.column(3)))
        if best is not None:
            n = best.keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(best.ids, n)), pa.array(best.keys.ravel()), pa.array(best.scores.ravel())], names=["query_id", "vec_id", "score"])

    found = met.repartitionById(blocks * shares, F.col("task")).sortWithinPartitions("chunk").mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
