"""Table-generating functions: texts into chunks with the lines that they span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text

#: Words of a window, and words that two windows share.
WINDOW, OVERLAP = 220, 40
#: Chunks of a document beyond which it counts as failed.
MOST_CHUNKS = 16_384


def word_windows(docs: DataFrame, text_col: str = "text", line_col: str | None = None, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """One row a window of words: docs' other columns, chunk_index, text, start_line, end_line.

    Expressions only: words of each line, then all words and the line of each, then slices, which alone are
    exploded; a text without words has no windows. (Spark interprets functions over arrays, so this is JVM code, but
    not generated code. The outer explode keeps Spark from adding a filter that works out all words once more.)
    """
    step = max(window - overlap, 1)
    rest = [c for c in docs.columns if c != text_col]
    first = F.col(line_col) if line_col else F.lit(1)
    lines = F.split(F.col(text_col), "\n", -1)
    by_line = docs.select(*rest, F.transform(lines, text.words).alias("__lines"))
    numbers = F.flatten(F.transform("__lines", lambda words, number: F.array_repeat((number + first).cast("int"), F.size(words))))
    words = by_line.select(*rest, F.flatten("__lines").alias("__words"), numbers.alias("__line"))
    n = F.size("__words")

    def cut(k):
        end = F.least(k * step + window, n)
        return F.struct(k.alias("chunk_index"), F.array_join(F.slice("__words", k * step + 1, F.lit(window)), " ").alias("text"), F.element_at("__line", k * step + 1).alias("start_line"), F.element_at("__line", end).alias("end_line"))

    cuts = F.when(n > 0, F.transform(F.sequence(F.lit(0), (window_count(n, window, overlap) - 1).cast("int")), cut))
    return words.select(*rest, F.explode_outer(cuts).alias("__cut")).where("__cut IS NOT NULL").select(*rest, "__cut.*")


def window_indexes(docs: DataFrame, text_col: str = "text", window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """docs' other columns and chunk_index of every window that word_windows has; words are counted, not cut."""
    rest = [c for c in docs.columns if c != text_col]
    counted = docs.select(*rest, window_count(word_count(F.col(text_col)), window, overlap).cast("int").alias("__windows"))
    return counted.select(*rest, F.explode_outer(F.when(F.col("__windows") > 0, F.sequence(F.lit(0), F.col("__windows") - 1))).alias("chunk_index")).where("chunk_index IS NOT NULL")


def window_count(words: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """How many windows a text of so many words has."""
    step = max(window - overlap, 1)
    return F.when(words <= 0, 0).when(words <= window, 1).otherwise(F.ceil((words - window) / step) + 1)


def word_count(words_of: Column) -> Column:
    return F.size(text.words(words_of))


def over_limit(chunks: DataFrame, key: str, most: int = MOST_CHUNKS) -> DataFrame:
    """Documents with too many chunks, as failures."""
    return chunks.groupBy(key).agg(F.count("*").alias("chunks")).where(F.col("chunks") > most).select(key, F.lit("RESOURCE_LIMIT").alias("failure_stage"), "chunks")


def texts_over_limit(docs: DataFrame, key: str, text_col: str = "text", most: int = MOST_CHUNKS) -> DataFrame:
    """over_limit of the word windows of docs, from the number of words alone."""
    windows = docs.select(key, word_count(F.col(text_col)).alias("__words")).select(key, window_count(F.col("__words")).cast("long").alias("__windows"))
    chunks = windows.groupBy(key).agg(F.sum("__windows").alias("chunks"))
    return chunks.where(F.col("chunks") > most).select(key, F.lit("RESOURCE_LIMIT").alias("failure_stage"), "chunks")
