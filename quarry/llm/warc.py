"""WARC archives whose records are compressed one by one with a common Zstandard dictionary.

The dictionary is built from a bounded sample of the records and stands in a skippable frame
(0x184D2A5D) at the head of every archive; each record is a frame of its own. Tasks write
archives of bounded size into the shared folder under names of their own, and the list of
archives is committed as a table, so that archives of lost or repeated tasks are never read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import about, shared_dir, slices, staged

#: Of equal payloads of at least so many bytes, one is kept.
REVISIT_BYTES = 1000
#: Uncompressed bytes of an archive, about; records and bytes of each for the dictionary, and its size.
ARCHIVE_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 64 << 20, 400, 16 << 10, 64 << 10
DICTIONARY_MAGIC = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payloads(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("body"))


def revisits(bodies: DataFrame) -> DataFrame:
    """(page_id, digest, size, refers_to) of the pages whose payload a page of a larger id has too. A null id is smaller than any."""
    marked = bodies.where(F.length("body") >= REVISIT_BYTES).select("page_id", F.sha1("body").alias("digest"), F.length("body").alias("size"))
    kept = marked.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return marked.join(kept, ["digest", "size"]).where("page_id IS NULL AND refers_to IS NOT NULL OR page_id < refers_to").select("page_id", "digest", "size", "refers_to").distinct()


def train_dictionary(bodies: DataFrame) -> bytes:
    """A dictionary from SAMPLE_RECORDS records, taken in the order of a hash; empty where there is too little to learn from."""
    import zstandard

    sample = about(bodies, 4 * SAMPLE_RECORDS, bodies.count(), "page_id").select("page_id", F.expr(f"substring(body, 1, {SAMPLE_BYTES})").alias("body"), F.xxhash64("page_id").alias("at")).orderBy("at").limit(SAMPLE_RECORDS).collect()
    records = [b"".join(_response(r["page_id"], "", bytes(r["body"]))) for r in sample if r["body"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small samples
        return b""


def _header(kind: str, page_id: int | None, url: str | None, length: int, more: list[str]) -> bytes:
    safe = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "about:blank")
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}", *more, f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def _response(page_id: int | None, url: str | None, body: bytes, refers_to: int | None = None) -> list[bytes]:
    """Parts of a response record or, with refers_to, of a revisit record, which has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    more = ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}"]
    if refers_to is None:
        return [_header("response", page_id, url, len(head) + len(body), more), head, body, b"\r\n\r\n"]
    more += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return [_header("revisit", page_id, url, len(head), more), head, b"\r\n\r\n"]


def write_archives(bodies: DataFrame, refers: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Write a record for every page; returns the committed table (archive, records)."""
    # refers is a written table: the planner knows its size, broadcasts it if it is small and shuffles otherwise
    # an id may have several payloads, so a page is found by id and payload
    own = bodies.withColumns({"own_digest": F.sha1("body"), "own_size": F.length("body")})
    same = own["page_id"].eqNullSafe(refers["page_id"]) & (own["own_digest"] == refers["digest"]) & (own["own_size"] == refers["size"])
    rows = own.join(refers, same, "left").select(own["page_id"], "url", "body", "refers_to") if refers.take(1) else bodies.withColumn("refers_to", F.lit(None).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, place = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        out, name, records, size, done = None, "", 0, 0, []
        for batch in slices(batches, "body"):
            for page_id, url, body, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = store.open_output_stream(f"{place}/{name}")
                    if dictionary:
                        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                out.write(press.compress(b"".join(_response(page_id, url, body, refers_to))))
                records, size = records + 1, size + len(body)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    done.append((name, records))
        if out is not None:
            out.close()
            done.append((name, records))
        if done:
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{n}" for n, _ in done], "records": pa.array([r for _, r in done], pa.int64())})

    return staged(rows.mapInArrow(run, "archive string, records long"), "archives")


def _records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(": ")
            fields[key.lower()] = value
        yield fields, stream.read(int(fields["content-length"]))
        stream.read(4)


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, archive) of every record of the listed archives.

    Payloads of responses are digested anew and must agree with their record; those of revisits are not stored, so the record's own figures count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = pyarrow.fs.FileSystem.from_uri(name)
                with store.open_input_stream(path) as raw:
                    magic, length = struct.unpack("<II", raw.read(8))
                    found = None
                    if magic == DICTIONARY_MAGIC:
                        found = zstandard.ZstdCompressionDict(raw.read(length))
                        rest = raw
                    else:
                        rest = store.open_input_stream(path)
                    rows = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                    reader = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=found).stream_reader(rest, read_across_frames=True), 1 << 18)
                    for fields, block in _records(reader):
                        at = block.index(b"\r\n\r\n") + 4
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        kind = fields["warc-type"]
                        if kind == "response":
                            body = memoryview(block)[at:]
                            if hashlib.sha1(body).hexdigest() != digest:
                                raise ValueError(f"{name}: a payload does not have its record's digest")
                            size = len(body)
                        else:
                            size = int(block[:at].decode().partition("Content-Length: ")[2].partition("\r\n")[0])
                        own, other = (fields.get(k, "<urn:page:>")[len("<urn:page:") : -1] for k in ("warc-record-id", "warc-refers-to"))
                        for key, value in zip(rows, (int(own) if own else None, size, digest, kind, int(other) if other else None), strict=True):
                            rows[key].append(value)
                    n = len(rows["page_id"])
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(rows[k], pa.int64() if k in ("page_id", "payload_bytes", "refers_to") else pa.string()) for k in rows], pa.array([name] * n, pa.string())], names=[*rows, "archive"]
                    )

    # one archive is one unit of work
    tasks = max(1, min(archives.count(), 4096))
    return archives.select("archive").repartition(tasks, "archive").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string")


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages as WARC archives under folder (by default in the shared folder) and read them back.

    One record a row: a null html is an empty payload, a null url becomes about:blank, rows that
    repeat an id are written each, with the same payload or another, and of equal payloads of
    REVISIT_BYTES bytes or more all rows of the largest id are responses and the others revisits of it. An empty table writes no
    archive and gives no rows; other columns are ignored whatever their names. Ids are integers.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    bodies = payloads(pages, id_col, url_col, html_col)
    refers = staged(revisits(bodies), "revisits")
    return read_archives(write_archives(bodies, refers, folder, train_dictionary(bodies)))
