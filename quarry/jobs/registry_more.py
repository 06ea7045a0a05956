"""More queries over the driver's tables: syntax chunks and headings, sources and status, the event log as a viewer sees it, payloads and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.jobs import scratch
from quarry.jobs.registry import _register, _table
from quarry.operators import batching, catalog, chunking, events, lookups, reconcile, search, syntax
from quarry.streaming import latency

# --- chunks and headings ---------------------------------------------------------------------

# Documents become Markdown: signs that it would read go, lines turn into headings of four levels, a fence hides what looks like one.
_LINE = """CASE WHEN (i + doc_id) % 9 = 0 THEN repeat('#', CAST(1 + (i + doc_id) % 4 AS INT)) || ' ' || substr(l, 1, 30) || ' #' WHEN (i + doc_id) % 9 = 4 THEN chr(10) || '```' WHEN (i + doc_id) % 9 = 5 AND i > 0 THEN '# ' || l
WHEN (i + doc_id) % 9 = 6 AND i > 1 THEN '```' || chr(10) ELSE l END"""
_SPARK_MARKDOWN = f"array_join(transform(split(translate(replace(coalesce(text, ''), '. ', '.\\n'), '`~#=-', '     '), '\\n', -1), (l, i) -> {_LINE}), '\\n')"
_DUCK_LINES = f"""m AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS l FROM (SELECT doc_id, string_split(translate(replace(coalesce(text, ''), '. ', '.' || chr(10)), '`~#=-', '     '), chr(10)) AS ls FROM documents)),
h AS (SELECT doc_id, i, 1 + (i + doc_id) % 4 AS level, trim(substr(l, 1, 30), ' ' || chr(9) || chr(13)) AS title FROM m WHERE (i + doc_id) % 9 = 0 AND trim(substr(l, 1, 30), ' ' || chr(9) || chr(13)) <> '')"""


def _markdown(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.expr(_SPARK_MARKDOWN).alias("text"), F.lit("markdown").alias("language"))


@_register("markdown_chunks")
def markdown_chunks(spark, sf_dir):
    return syntax.chunks(_markdown(spark, sf_dir), "doc_id")


@_register("code_chunks")
def code_chunks(spark, sf_dir):
    language = F.element_at(F.array(*[F.lit(x) for x in ("go", "rust", "python", "nix", "lua")]), (F.col("page_id") % 5 + 1).cast("int"))
    return syntax.chunks(_table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"), language.alias("language")), "page_id")


@_register("chunk_limits", f"""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[^{text.SPACE}]+')) AS w FROM documents), c AS (SELECT doc_id, CASE WHEN w = 0 THEN 0 WHEN w <= 220 THEN 1 ELSE CAST(ceil((w - 220) / 180.0) AS BIGINT) + 1 END AS chunks FROM n)
SELECT doc_id, 'RESOURCE_LIMIT' AS failure_stage, chunks FROM c WHERE chunks > 4""")
def chunk_limits(spark, sf_dir):
    return chunking.texts_over_limit(_table(spark, sf_dir, "documents"), "doc_id", most=4)


# --- batches ---------------------------------------------------------------------------------

# Small limits, so that documents, bytes, deletions and sources all end batches in these tables.
_MOST, _TARGET = 16, 6000


@_register("batch_groups", f"""WITH RECURSIVE d AS (SELECT source, doc_id, octet_length(encode(coalesce(text, ''))) AS size, doc_id % 37 = 0 AS gone, row_number() OVER (ORDER BY source NULLS FIRST, doc_id) AS n FROM documents),
r AS (SELECT n, source, doc_id, size, gone, CASE WHEN gone THEN 0 ELSE 1 END AS held, CASE WHEN gone THEN 0 ELSE size END AS bytes, CAST(CASE WHEN gone THEN 0 ELSE 1 END AS BIGINT) AS batch FROM d WHERE n = 1
UNION ALL SELECT n, source, doc_id, size, gone, CASE WHEN gone THEN 0 WHEN new THEN 1 ELSE held + 1 END, CASE WHEN gone THEN 0 WHEN new THEN size ELSE bytes + size END, batch + CASE WHEN new AND NOT gone THEN 1 ELSE 0 END
FROM (SELECT d.*, r.held, r.bytes, r.batch, d.source IS DISTINCT FROM r.source OR r.held = 0 OR r.held >= {_MOST} OR r.bytes + d.size > {_TARGET} AS new FROM r JOIN d ON d.n = r.n + 1))
SELECT batch, any_value(source) AS source, count(*) AS documents, CAST(sum(size) AS BIGINT) AS bytes, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM r WHERE NOT gone GROUP BY batch""")
def batch_groups(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), (F.col("doc_id") % 37 == 0).alias("gone"))
    rows = batching.batched(docs, "source", ["doc_id"], "size", "gone", _MOST, _TARGET)
    return rows.groupBy("batch").agg(F.any_value("source").alias("source"), F.count("*").alias("documents"), F.sum("size").alias("bytes"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


# --- sources ---------------------------------------------------------------------------------

# Users are sources, their first event registered them; every third comes again under the path of another.
_SOURCES = "SELECT concat('s', user_id) AS id, 'local_dir' AS type, concat('/u/', user_id % 40) AS uri, min(ts) AS created_at FROM {events} WHERE user_id < 60 GROUP BY user_id"
_NEW = "SELECT concat('n', user_id) AS id, 'local_dir' AS type, concat('/u/', user_id % 70) AS uri, max(ts) AS created_at FROM {events} GROUP BY user_id"
_DUCK_SOURCES = f"s AS ({_SOURCES.format(events='events')}), n AS ({_NEW.format(events='events')}), f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY uri ORDER BY created_at, id) = 1)"


def _sources(spark, sf_dir):
    log = _table(spark, sf_dir, "events")
    return spark.sql(_SOURCES, events=log), spark.sql(_NEW, events=log)


@_register("add_source", f"WITH {_DUCK_SOURCES} SELECT * FROM s UNION ALL SELECT * FROM f WHERE uri NOT IN (SELECT uri FROM s)")
def add_source(spark, sf_dir):
    return catalog.added(*_sources(spark, sf_dir))


@_register("source_registrations", f"""WITH {_DUCK_SOURCES}, k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY uri ORDER BY created_at, id) = 1)
SELECT f.uri, coalesce(k.id, f.id) AS id, k.id IS NULL AS created FROM f LEFT JOIN k USING (uri)""")
def source_registrations(spark, sf_dir):
    return catalog.registrations(*_sources(spark, sf_dir))


@_register("sources_in_order", f"WITH {_DUCK_SOURCES} SELECT id, uri, CAST(row_number() OVER (ORDER BY created_at, id) AS BIGINT) AS place FROM s")
def sources_in_order(spark, sf_dir):
    return events.numbered(_sources(spark, sf_dir)[0], ["created_at", "id"], "place").select("id", "uri", "place")


@_register("source_conflicts", """WITH p AS (SELECT page_id, '/' || regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS raw FROM pages), u AS (SELECT page_id, regexp_replace(regexp_replace(raw, '/+', '/', 'g'), '(.)/$', '\\1') AS path, raw FROM p),
r AS (SELECT 'r' || page_id AS id, path, page_id % 17 AS created_at FROM u WHERE page_id % 3 = 0), a AS (SELECT CASE page_id % 3 WHEN 0 THEN raw || '//deeper/' WHEN 1 THEN raw ELSE regexp_replace(path, '/[^/]*$', '') END AS raw FROM u WHERE path <> '/'), c AS (SELECT DISTINCT raw, regexp_replace(regexp_replace(raw, '/+', '/', 'g'), '(.)/$', '\\1') AS path FROM a WHERE starts_with(raw, '/')),
m AS (SELECT c.raw AS uri, r.id, r.created_at, CASE WHEN c.path = r.path THEN 'equal' WHEN starts_with(c.path, r.path || '/') THEN 'inside' ELSE 'contains' END AS relation
FROM c JOIN r ON c.path = r.path OR starts_with(c.path, r.path || '/') OR starts_with(r.path, c.path || '/'))
SELECT uri, id, relation FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY uri ORDER BY created_at, id) = 1) WHERE relation <> 'equal'""")
def source_conflicts(spark, sf_dir):
    raw = F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1))
    pages = _table(spark, sf_dir, "pages").select("page_id", raw.alias("uri"))
    registered = pages.where("page_id % 3 = 0").select(F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("id"), "uri", (F.col("page_id") % 17).alias("created_at"))
    folder = F.regexp_replace(text.clean_path(F.col("uri")), "/[^/]*$", "")
    asked = F.when(F.col("page_id") % 3 == 0, F.concat("uri", F.lit("//deeper/"))).when(F.col("page_id") % 3 == 1, F.col("uri")).otherwise(folder)
    return reconcile.conflicts(pages.where(text.clean_path(F.col("uri")) != "/").select("page_id", asked.alias("uri")), registered)


_DOCUMENTS = "SELECT concat('d', doc_id) AS document_id, source AS source_id, CAST(doc_id % 11 AS INT) AS chunk_count FROM documents"


@_register("delete_source_cascade", f"""WITH d AS ({_DOCUMENTS}), kept AS (SELECT * FROM d WHERE source_id NOT IN ('src1', 'src4', 'none')), src AS (SELECT DISTINCT source AS id FROM documents)
SELECT 'chunks' AS part, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS n FROM kept UNION ALL SELECT 'documents', count(*) FROM kept UNION ALL SELECT 'failures', count(*) FROM kept WHERE chunk_count = 0
UNION ALL SELECT 'sources', count(*) FROM src WHERE id NOT IN ('src1', 'src4', 'none')""")
def delete_source_cascade(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").selectExpr("concat('d', doc_id) AS document_id", "source AS source_id", "CAST(doc_id % 11 AS INT) AS chunk_count")
    chunks = docs.select("document_id", "source_id", F.explode(F.expr("sequence(0, chunk_count)")).alias("k")).where("k > 0")
    tables = {"chunks": chunks, "documents": docs, "failures": docs.where("chunk_count = 0"), "sources": docs.select(F.col("source_id").alias("id")).distinct()}
    left = catalog.deleted(tables, spark.createDataFrame([("src1",), ("src4",), ("none",)], "id string"))
    out = None
    for name, df in left.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@_register("status", """WITH f AS (SELECT source, doc_id, doc_id % 3 AS attempts, n_chars FROM documents WHERE doc_id % 11 = 0)
SELECT (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT count(*) FROM documents) AS documents, (SELECT CAST(sum(doc_id % 11) AS BIGINT) FROM documents) AS chunks, (SELECT count(*) FROM f) AS failures,
(SELECT string_agg(doc_id || ':' || attempts, ',' ORDER BY n_chars DESC, source, CAST(doc_id AS VARCHAR)) FROM (SELECT * FROM f ORDER BY n_chars DESC, source, CAST(doc_id AS VARCHAR) LIMIT 20)) AS newest, 'reading /a, 2 documents queued, 1 scan queued' AS activity""")
def status(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    failures = docs.where("doc_id % 11 = 0").select(F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("uri"), (F.col("doc_id") % 3).alias("attempts"), F.lit("e").alias("error"), F.timestamp_seconds("n_chars").alias("failed_at"))
    row = catalog.status(docs.select("source").distinct(), docs.select((F.col("doc_id") % 11).alias("chunk_count")), failures, F.lit(1), F.lit(2), F.lit("/a"), F.lit("reading"), 20)
    newest = F.array_join(F.transform("newest", lambda f: F.concat_ws(":", f["uri"], f["attempts"].cast("string"))), ",")
    activity = text.activity_line(F.col("activity.document"), F.col("activity.stage"), F.col("activity.pending_documents"), F.col("activity.pending_scans"))
    return row.select("sources", "documents", "chunks", "failures", newest.alias("newest"), activity.alias("activity"))


@_register("old_catalog_rows", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS VARCHAR) ELSE '' END AS fingerprint, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS ingested_at FROM documents")
def old_catalog_rows(spark, sf_dir):
    """Rows of two ages, one without fingerprints; times are decoded strictly."""
    written = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    docs = _table(spark, sf_dir, "documents").withColumn("written", written)
    new = catalog.with_fingerprints(docs.where("doc_id % 2 = 0").select("doc_id", F.col("n_chars").cast("string").alias("fingerprint"), "written"))
    old = catalog.with_fingerprints(docs.where("doc_id % 2 <> 0").select("doc_id", "written"))
    return new.unionByName(old).select("doc_id", "fingerprint", catalog.strict_time(F.col("written")).cast("timestamp_ntz").alias("ingested_at"))


# --- the event log as a viewer sees it -------------------------------------------------------

# Events stand for those of an index: types for kinds, users for viewers.
_KIND = """CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 'snapshot' ELSE 'document_queued' END WHEN event_type = 'view' THEN CASE event_id % 3 WHEN 0 THEN 'document_queued' WHEN 1 THEN 'document_reading' ELSE 'document_embedding' END
WHEN event_type = 'purchase' THEN 'document_ingested' WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'document_deleted' ELSE 'scan_finished' END ELSE 'document_failed' END"""
_FIELDS = f"event_id, user_id, ts, {_KIND} AS kind, concat('/f/', event_id % 100) AS uri, CAST(event_id % 7 AS INT) AS chunk_count, CASE WHEN event_id % 3 = 0 THEN 'bad' ELSE '' END AS error, event_id % 900 AS took_ms, CAST(event_id % 5 AS INT) AS pending_documents"


@_register("display_fold", f"""WITH e AS (SELECT {_FIELDS} FROM events),
l AS (SELECT *, max(CASE WHEN kind = 'document_queued' THEN 1 ELSE 0 END) OVER w AS live, kind IN ('document_ingested', 'document_failed', 'document_deleted') AS ends FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
o AS (SELECT user_id, list({{'k': kind, 'p': pending_documents, 'live': live, 'ends': ends, 'u': uri, 'id': event_id}} ORDER BY ts, event_id) AS es FROM l GROUP BY user_id),
f AS (SELECT user_id, es, list_reduce(list_prepend({{'k': '', 'p': 0, 'live': 0, 'ends': false, 'u': '', 'id': CAST(0 AS BIGINT)}}, es), lambda a, x: {{'k': '', 'p': CASE WHEN x.k = 'snapshot' AND x.live = 0 THEN x.p WHEN x.k = 'document_queued' THEN a.p + 1 WHEN x.ends THEN greatest(a.p - 1, 0) ELSE a.p END, 'live': 0, 'ends': false,
  'u': CASE WHEN x.k = 'snapshot' AND x.live = 0 THEN '' WHEN x.k IN ('document_reading', 'document_embedding') THEN x.u WHEN x.ends AND greatest(a.p - 1, 0) = 0 THEN '' ELSE a.u END, 'id': x.id}}) AS last FROM o),
t AS (SELECT user_id, count(*) FILTER (WHERE kind = 'document_ingested') AS ingested_total, coalesce(sum(chunk_count) FILTER (WHERE kind = 'document_ingested'), 0) AS chunks_total, count(*) FILTER (WHERE kind = 'document_failed') AS failed_total,
  arg_max(CASE WHEN kind = 'document_failed' THEN uri || ': ' || error ELSE 'scan s: ' || error END, (ts, event_id)) FILTER (WHERE kind = 'document_failed' OR (kind = 'scan_finished' AND error <> '')) AS last_error, arg_max(took_ms, (ts, event_id)) FILTER (WHERE kind = 'scan_finished') AS last_scan_ms FROM e GROUP BY user_id)
SELECT user_id, CAST(f.last.p AS BIGINT) AS pending, f.last.u AS active_document, ingested_total, CAST(chunks_total AS BIGINT) AS chunks_total, failed_total, last_error, last_scan_ms FROM f JOIN t USING (user_id)""")
def display_fold(spark, sf_dir):
    none = F.lit(None).cast("string")
    log = _table(spark, sf_dir, "events").select(*[F.expr(x) for x in _fields()]).withColumns({"transport": none, "method": none, "worker_state": none, "active_document": none, "active_stage": none, "source_id": F.lit("s")})
    shown = events.display(log, "user_id", ["ts", "event_id"])
    fields = ("pending", "active_document", "ingested_total", "chunks_total", "failed_total", "last_error", "last_scan_ms")
    last = shown.groupBy("user_id").agg(F.max_by(F.struct(*fields), F.struct("ts", "event_id")).alias("s"))
    return last.select("user_id", *[F.col(f"s.{f}").alias(f) for f in fields])


def _fields() -> list[str]:
    return ["event_id", "user_id", "ts", f"{_KIND} AS kind", "concat('/f/', event_id % 100) AS uri", "CAST(event_id % 7 AS INT) AS chunk_count", "CASE WHEN event_id % 3 = 0 THEN 'bad' ELSE '' END AS error", "event_id % 900 AS took_ms", "CAST(event_id % 5 AS INT) AS pending_documents"]


# A view begins a call, which what comes next of another kind ends.
@_register("call_latency", """SELECT CAST(b.event_id AS VARCHAR) AS request_id, CASE WHEN b.user_id % 3 = 0 THEN 'IngestBatch' ELSE 'Search' END AS method, e.event_type AS code, CAST(floor((epoch_us(e.ts) - epoch_us(b.ts)) / 1000) AS BIGINT) AS took_ms
FROM events b LEFT JOIN events e ON e.event_id = b.event_id + 1 AND e.event_type <> 'view' AND e.ts BETWEEN b.ts AND b.ts + INTERVAL 5 MINUTE WHERE b.event_type = 'view'""")
def call_latency(spark, sf_dir):
    log = _table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    method = F.when(F.col("user_id") % 3 == 0, "IngestBatch").otherwise("Search")
    begins = log.where("event_type = 'view'").select(F.col("event_id").cast("string").alias("request_id"), F.lit("grpc").alias("transport"), method.alias("method"), "at")
    ends = log.where("event_type <> 'view'").select((F.col("event_id") - 1).cast("string").alias("request_id"), "at", F.col("event_type").alias("code"))
    return latency.calls(begins, ends).select("request_id", "method", "code", "took_ms")


@_register("numbered_events", "SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS seq FROM events")
def numbered_events(spark, sf_dir):
    return events.numbered(_table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "seq")


@_register("rates_since_start", """SELECT round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 60e6, 6) AS ingested_per_minute, round(sum(event_id % 7) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 60e6, 6) AS chunks_per_minute FROM events WHERE event_type = 'purchase'""")
def rates_since_start(spark, sf_dir):
    bought = _table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.lit(1).alias("ingested"), (F.col("event_id") % 7).alias("chunks"), F.col("ts").cast("timestamp").alias("ts"))
    span = bought.agg(F.min("ts").alias("began"), F.max("ts").alias("now")).first()
    if span["began"] is None:
        return spark.createDataFrame([(None, None)], "ingested_per_minute double, chunks_per_minute double")
    found = events.rates(bought, ["ingested", "chunks"], F.lit(span["began"]), F.lit(span["now"]))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@_register("retry_schedule", """WITH e AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = 'error' AND event_id % 4 > 0 THEN 10 * (event_id % 4) * 60000 END AS delay_ms FROM events),
k AS (SELECT user_id, ts, 0 AS kind, delay_ms FROM e WHERE delay_ms IS NOT NULL UNION ALL SELECT user_id, ts, 1, NULL FROM e WHERE event_type = 'view'),
n AS (SELECT *, ts + to_milliseconds(delay_ms) AS fires, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, kind) AS nxt FROM k)
SELECT user_id, fires FROM n WHERE kind = 0 AND (nxt IS NULL OR nxt >= fires)""")
def retry_schedule(spark, sf_dir):
    log = _table(spark, sf_dir, "events")
    runs = log.where("event_type = 'error'").select("user_id", "ts", F.when(F.col("event_id") % 4 > 0, 10 * (F.col("event_id") % 4) * 60000).alias("delay_ms"))
    found = events.scheduled_retries(runs, log.where("event_type = 'view'"), "user_id", "ts", "delay_ms", "ts")
    return found.withColumn("fires", F.col("fires").cast("timestamp_ntz"))


@_register("coalesced_scans", """WITH o AS (SELECT user_id, list(epoch_us(ts) ORDER BY ts) AS ts FROM events GROUP BY user_id),
f AS (SELECT user_id, list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(ts, lambda t: [t])), lambda a, x: CASE WHEN len(a) > 1 AND x[1] < a[-1] + 86400000000 THEN a ELSE list_append(a, x[1]) END)[2:] AS starts FROM o)
SELECT user_id, make_timestamp(unnest(starts)) AS ts FROM f""")
def coalesced_scans(spark, sf_dir):
    asked = _table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("planned", F.expr("ts + INTERVAL 24 HOURS"))
    return events.coalesced(asked, "user_id", "ts", "planned").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@_register("stream_decode", "SELECT event_id AS seq, event_type AS kind FROM events WHERE event_id % 5 NOT IN (0, 1, 2)")
def stream_decode(spark, sf_dir):
    """Lines of an event stream: comments, names of events, broken JSON and JSON that is no object are left out."""
    good = F.concat(F.lit("data: "), F.to_json(F.struct(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))))
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(": "), good)).when(F.col("event_id") % 5 == 1, F.concat(good, F.lit("}x"))).when(F.col("event_id") % 5 == 2, F.lit("data: [1]")).otherwise(good)
    return events.decoded_stream(_table(spark, sf_dir, "events").select(line.alias("value"))).select("seq", "kind")


@_register("snapshot_gauge", "SELECT 'snapshot' AS kind, (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT count(*) FROM documents) AS documents, (SELECT CAST(sum(doc_id % 11) AS BIGINT) FROM documents) AS chunks, (SELECT count(*) FROM events WHERE event_type = 'error') AS ingest_failures, 3 AS pending_scans, 0 AS pending_documents")
def snapshot_gauge(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return events.snapshot(docs.select("source").distinct(), docs.select((F.col("doc_id") % 11).alias("chunk_count")), _table(spark, sf_dir, "events").where("event_type = 'error'"), F.lit(3), F.lit(0))


# --- payloads and results --------------------------------------------------------------------


@_register("uri_lookup", "SELECT page_id, url, html FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 50 = 0)")
def uri_lookup(spark, sf_dir):
    path = scratch.fresh(spark, "pages")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    lookups.written(pages, path, "page_id", ["url"])
    return lookups.rows_of(spark, path, "url", pages.where("page_id % 50 = 0").select("url"))


@_register("payload_results", """SELECT 'd' || page_id AS document_id, 's' AS source_id, url AS uri, CAST(page_id % 9 AS INTEGER) AS chunk_index, CAST(page_id AS DOUBLE) / 4 AS score, html AS text,
CASE WHEN page_id % 4 = 0 THEN 0 ELSE CAST(page_id % 50 AS INTEGER) END AS start_line, 0 AS end_line FROM pages WHERE page_id % 6 NOT IN (1, 2) AND url IS NOT NULL AND html IS NOT NULL""")
def payload_results(spark, sf_dir):
    p = F.col("page_id")
    fields = F.struct(
        F.when(p % 6 != 1, F.concat(F.lit("d"), p.cast("string"))).alias("document_id"), F.lit("s").alias("source_id"), F.col("url").alias("uri"), F.when(p % 6 != 2, p % 9).alias("chunk_index"),
        F.col("html").alias("text"), F.when(p % 4 != 0, p % 50).alias("start_line"), F.lit("no number").alias("end_line"),
    )
    return search.decoded(_table(spark, sf_dir, "pages").select((p.cast("double") / 4).alias("score"), F.to_json(fields).alias("payload")))


@_register("result_entries", f"""WITH r AS (SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN '/r/' || page_id END AS path, CASE WHEN page_id % 5 <> 0 THEN page_id % 3 END AS l, CASE WHEN page_id % 8 <> 1 THEN page_id / 7.0 END AS score, trim(regexp_replace(html, '[ \\t-\\r]+', ' ', 'g')) AS t FROM pages)
SELECT path, CAST(greatest(1, l) AS INTEGER) AS line, round(score, 6) AS score, t AS text, path || ':' || CAST(greatest(1, l) AS INTEGER) || '  ' || printf('%.4f', CAST(score AS DOUBLE)) || '  ' || t AS display FROM r WHERE path IS NOT NULL AND l IS NOT NULL AND score IS NOT NULL AND t IS NOT NULL""")
def result_entries(spark, sf_dir):
    p = F.col("page_id")
    rows = _table(spark, sf_dir, "pages").select(F.when(p % 7 != 0, F.concat(F.lit("r/"), p.cast("string"))).alias("uri"), F.when(p % 5 != 0, p % 3).alias("start_line"), F.when(p % 8 != 1, p / 7).alias("score"), F.col("html").alias("text"))
    return search.entries(rows, text.result_path(F.col("uri"), "/")).withColumn("score", F.round("score", 6))


@_register("heading_trails", f"""WITH {_DUCK_LINES}, t AS (SELECT doc_id, min(level) AS top FROM h GROUP BY doc_id), c AS (SELECT h.doc_id, count(*) AS n FROM h JOIN t USING (doc_id) WHERE level = top GROUP BY h.doc_id),
a AS (SELECT x.doc_id, x.i, x.level, x.title, y.level AS l, y.title AS title_above, y.i AS at FROM h x JOIN h y ON x.doc_id = y.doc_id AND y.i <= x.i
      WHERE NOT EXISTS (SELECT 1 FROM h z WHERE z.doc_id = x.doc_id AND z.i > y.i AND z.i <= x.i AND z.level <= y.level)),
n AS (SELECT a.doc_id, a.i, a.level, a.title, string_agg(title_above, ' > ' ORDER BY l) FILTER (WHERE NOT (l = top AND c.n = 1)) AS trail FROM a JOIN t USING (doc_id) JOIN c USING (doc_id) GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS place, CAST(level AS INTEGER) AS level, title, coalesce(trail, '') AS trail FROM n""")
def heading_trails(spark, sf_dir):
    rows = syntax.with_trails(syntax.outlined(_markdown(spark, sf_dir)), "doc_id").where("kind = 'heading'")
    place = F.row_number().over(syntax.Window.partitionBy("doc_id").orderBy("start"))
    return rows.select("doc_id", place.alias("place"), "level", F.col("text").alias("title"), F.col("context").alias("trail"))
