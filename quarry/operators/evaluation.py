"""Retrieval quality: recall, reciprocal rank, chunk hits, distinct files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTS = (1, 5, 10)


def outcomes(results: DataFrame) -> DataFrame:
    """One row a query, from rows (query_id, rank, file, wanted boolean, contains boolean or null): rank of the first wanted file, files among the first five, chunk hit among the first ten."""
    return results.groupBy("query_id").agg(
        F.min(F.when(F.col("wanted"), F.col("rank"))).alias("first_rank"),
        F.count_distinct(F.when(F.col("rank") <= 5, F.col("file"))).alias("distinct_files"),
        F.max(F.when(F.col("rank") <= 10, F.when(F.col("wanted"), F.col("contains")).otherwise(F.when(F.col("contains").isNotNull(), F.lit(False))))).alias("chunk_hit"),
    )


def report(scored: DataFrame) -> DataFrame:
    """One row: recall at each cut, mean reciprocal rank, chunk hit rate over the queries that have one, mean distinct files."""
    recall = [F.round(F.avg(F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in CUTS]
    return scored.agg(
        F.count("*").alias("queries"), *recall, F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.col("chunk_hit").cast("double")), 6).alias("chunk_hit_rate"), F.round(F.avg("distinct_files"), 6).alias("distinct_5"),
    )
