"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where none is set, a fresh local one in local mode, as in tests; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors, gives exact sizes to the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGED: list[str] = []


def clear_staged(spark: SparkSession) -> int:
    """Delete all tables that staged wrote in this process; to be called once the results that rest on them are written. Returns their number."""
    n = len(_STAGED)
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def ascii_lower(column):
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(column, modulus: int):
    """crc32 of the id written as decimal text, modulo modulus."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the named text column of each slice stays near max_bytes (a single longer value goes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


def text_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes of a string or binary array, row offsets); null counts as empty."""
    values = pa.compute.fill_null(values.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_KEYS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS = np.multiply.accumulate(np.append(np.uint64(1), np.full((1 << 12) - 1, 0xD6E8FEB86659FD93, dtype=np.uint64)))


def _powers(n: int) -> np.ndarray:
    if n <= len(_POWERS):
        return _POWERS[:n]
    out = np.full(n, 0xD6E8FEB86659FD93, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ASCII-lower-cased words ([^\\x20\\x09-\\x0D]+) of every row, and row offsets into them."""
    data, rows = text_bytes(values)
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(values) + 1, dtype=np.int64)
    data = _LOWER[data]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = rows[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]  # a word never crosses a row
    starts = np.flatnonzero(first)
    at = np.searchsorted(starts, rows)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), at.astype(np.int64)
    where = np.flatnonzero(inside)
    letters = data[where]
    begin = np.searchsorted(where, starts)
    lengths = np.diff(np.append(begin, len(where)))
    place = np.arange(len(where)) - np.repeat(begin, lengths)
    terms = _BYTE_KEYS[letters] * _powers(int(lengths.max()))[place]
    sums = np.add.reduceat(terms, begin)
    return mix64(sums ^ (lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), at.astype(np.int64)


def about(df: DataFrame, n: int, total: int, *columns: str) -> DataFrame:
    """About n of total rows by a hash of columns, all if there are no more: a bounded, repeatable selection for fitting, which tasks make on their own."""
    share = n / max(total, 1)
    return df if share >= 1 else df.where(F.xxhash64(*columns) < int(share * 2**64) - 2**63)
