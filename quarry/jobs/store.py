"""Tables of an index on plain Parquet: a write makes a new generation of what it touches, and readers take the newest committed one.

A small table (the manifest) is replaced as a whole. The others are laid out by source and by a
hash bucket of the document, and a generation holds only the (source, bucket) parts that a run
touched: a run without changes writes nothing, and a search of one source reads its folders only.
A generation counts once its marker is written, after its data. This stands in for MERGE, which
plain Parquet tables don't have.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import Conflict, InvalidArgument

#: Hash buckets of each source, columns that tables are laid out by, name of the marker.
BUCKETS, LAYOUT, MARKER, CLAIM = 64, ("source_id", "bucket"), "_COMMITTED", "_CLAIM"
#: A claim of a writer that is older than so many seconds is what a broken run left.
STALE_S = 6 * 3600


def bucket_of(document: Column) -> Column:
    return F.pmod(F.xxhash64(document), F.lit(BUCKETS)).cast("int")


def _fs(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def _generations(spark: SparkSession, table: str, marker: str) -> list[int]:
    fs, path = _fs(spark, table)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(int(n[4:]) for n in names if n.startswith("gen=") and fs.exists(_fs(spark, f"{table}/{n}/{marker}")[1]))


def _folder(table: str, number: int) -> str:
    return f"{table}/gen={number:08d}"


def _write_text(spark: SparkSession, path: str, text: str, overwrite: bool) -> None:
    fs, made = _fs(spark, path)
    out = fs.create(made, overwrite)
    out.write(bytearray(text.encode()))
    out.close()


def _claim(spark: SparkSession, folder: str) -> None:
    """Take a generation for this writer; if another one has it, this is an error, and not its loss."""
    fs, path = _fs(spark, f"{folder}/{CLAIM}")
    if fs.exists(path):
        if time.time() - fs.getFileStatus(path).getModificationTime() / 1000 < STALE_S:
            raise Conflict(f"{folder} is being written by another run")
        fs.delete(_fs(spark, folder)[1], True)
    try:
        _write_text(spark, f"{folder}/{CLAIM}", uuid.uuid4().hex, overwrite=False)
    except Exception as e:
        raise Conflict(f"{folder} is being written by another run") from e


@contextmanager
def _released(spark: SparkSession, folder: str) -> Iterator[None]:
    """A claimed generation that fails to be written is given up at once, with its claim."""
    try:
        yield
    except BaseException:
        discard(spark, folder)
        raise


def discard(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that this run made."""
    fs, made = _fs(spark, path)
    fs.delete(made, True)


def current(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The newest committed generation of a table that is replaced as a whole; an empty frame before the first."""
    found = _generations(spark, table, "_SUCCESS")
    return spark.read.schema(schema).parquet(_folder(table, found[-1])) if found else spark.createDataFrame([], schema)


def publish(df: DataFrame, table: str) -> int:
    """Write df as the next generation of such a table; returns its number."""
    spark = df.sparkSession
    found = _generations(spark, table, "_SUCCESS")
    number = found[-1] + 1 if found else 1
    _claim(spark, _folder(table, number))
    with _released(spark, _folder(table, number)):
        df.write.mode("append").parquet(_folder(table, number))
    discard(spark, f"{_folder(table, number)}/{CLAIM}")
    return number


def _parts(spark: SparkSession, table: str) -> dict[tuple[str, int], int]:
    """The generation that holds each part now; emptied parts have none."""
    held: dict[tuple[str, int], int] = {}
    for number in _generations(spark, table, MARKER):
        fs, path = _fs(spark, f"{_folder(table, number)}/{MARKER}")
        stream = fs.open(path)
        said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        for source, bucket, rows in said:
            held.pop((source, bucket), None)
            if rows:
                held[source, bucket] = number
    return held


def _escaped(spark: SparkSession, value: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def read_parts(spark: SparkSession, table: str, schema: str, source: str | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a table now, of all sources or of one, of all buckets or some; source_id and bucket come from the folders."""
    held = {k: n for k, n in _parts(spark, table).items() if (source is None or k[0] == source) and (buckets is None or k[1] in buckets)}
    if not held:
        return spark.createDataFrame([], schema)
    paths = [f"{_folder(table, n)}/source_id={_escaped(spark, s)}/bucket={b}" for (s, b), n in sorted(held.items())]
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.read.schema(f"{schema}, gen int").option("basePath", table).parquet(*paths).select(*names)


def parts_of(spark: SparkSession, table: str, source: str) -> list[tuple[str, int]]:
    return sorted(k for k in _parts(spark, table) if k[0] == source)


def publish_parts(df: DataFrame, table: str, touched: list[tuple[str, int]]) -> int:
    """Write df, the rows that the touched parts have from now on, as the next generation; without touched parts nothing is written."""
    spark = df.sparkSession
    found = _generations(spark, table, MARKER)
    last = found[-1] if found else 0
    if not touched:
        return last
    folder = _folder(table, last + 1)
    _claim(spark, folder)
    with _released(spark, folder):
        _write_generation(df, folder, touched)
    discard(spark, f"{folder}/{CLAIM}")
    return last + 1


def _write_generation(df: DataFrame, folder: str, touched: list[tuple[str, int]]) -> None:
    spark = df.sparkSession
    within = [c for c in ("id", "document_id", "uri", "chunk_index") if c in df.columns]  # so that look-ups can leave row groups out
    writer = df.repartition(*LAYOUT).sortWithinPartitions(*LAYOUT, *within).write.mode("append").option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.option("parquet.bloom.filter.enabled#uri", "true").partitionBy(*LAYOUT).parquet(folder)
    filled = {(s, b) for s, b in touched if _fs(spark, f"{folder}/source_id={_escaped(spark, s)}/bucket={b}")[0].exists(_fs(spark, f"{folder}/source_id={_escaped(spark, s)}/bucket={b}")[1])}
    _write_text(spark, f"{folder}/{MARKER}", json.dumps([[s, b, int((s, b) in filled)] for s, b in touched]), overwrite=True)


def vacuum(spark: SparkSession, table: str, keep: int = 2) -> int:
    """Delete the folders of parts that newer generations replace, but for those of the newest keep generations, whose readers may still be at work; returns how many."""
    numbers, held, gone = _generations(spark, table, MARKER), _parts(spark, table), 0
    for number in numbers[:-keep] if keep else numbers:
        root = _folder(table, number)
        fs, path = _fs(spark, root)
        for source in [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]:
            for part in [p.getPath() for p in fs.listStatus(source)]:
                key = (spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(source.getName()[len("source_id=") :]), int(part.getName()[len("bucket=") :]))
                if held.get(key) != number:
                    fs.delete(part, True)
                    gone += 1
    return gone


def check_manifest(spark: SparkSession, index: str, model: str, dimension: int) -> None:
    """The index was made with this model and dimension, or is new; anything else is an error."""
    own = current(spark, f"{index}/manifest", "model string, dimension int")
    row = own.first()
    if row is None:
        publish(spark.createDataFrame([(model, dimension)], "model string, dimension int").coalesce(1), f"{index}/manifest")
    elif (row["model"], row["dimension"]) != (model, dimension):
        raise InvalidArgument(f"the index holds {row['model']} with {row['dimension']} dimensions, not {model} with {dimension}")


def replaced(old: DataFrame, new: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    """old without the documents of new and of gone, and new: a document that shrinks leaves nothing behind."""
    out = new.select(key).unionByName(gone.select(key)).distinct()
    return old.join(out, key, "left_anti").unionByName(new.select(*old.columns))
