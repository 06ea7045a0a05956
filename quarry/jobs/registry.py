"""Queries over the driver's tables, by name, and the SQL that each is held against.

The tables stand in for the library's own: vectors for chunks (label for the document or the
source), documents for a scan and for a catalog, events for the event log, pages for URIs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import ids, text
from quarry.jobs import scratch
from quarry.operators import catalog, chunking, evaluation, events, parts, reconcile, search, table_functions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- retrieval -------------------------------------------------------------------------------

_URI = "concat('/repo/src', label, '/', CASE vec_id % 5 WHEN 0 THEN 'tests/a' WHEN 1 THEN 'store' WHEN 2 THEN 'store_test' WHEN 3 THEN 'Test_store' ELSE 'app.spec' END, vec_id % 2, CASE vec_id % 3 WHEN 0 THEN '.go' WHEN 1 THEN '.ts' ELSE '_test.go' END)"
_COS = "list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_SCORED = f"s AS (SELECT c.vec_id, c.label, {_URI.replace('label', 'c.label').replace('vec_id', 'c.vec_id')} AS uri, {_COS} AS score FROM embeddings c, embeddings q WHERE q.vec_id = 0)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").withColumn("uri", F.expr(_URI))


def _asked(vectors: DataFrame) -> list[float]:
    return list(vectors.where("vec_id = 0").select("embedding").first()[0])


def _hits(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", F.round("score", 6).alias("score"))


@_register("knn_topk", f"WITH {_SCORED} SELECT vec_id, label, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 40")
def knn_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _hits(search.nearest(v, _asked(v), 40))


@_register("knn_source_filter", f"WITH {_SCORED} SELECT vec_id, label, round(score, 6) AS score FROM s WHERE label = 3 ORDER BY s.score DESC, vec_id LIMIT 10")
def knn_source_filter(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _hits(search.nearest(v, _asked(v), 10, F.col("label") == 3))


def _collapsed(per_file: int, fetch: int, tests: bool = True) -> str:
    out = "" if tests else f"WHERE NOT regexp_matches(lower(uri), '{text.TEST_PATTERN}')"
    capped = f"n <= {per_file}" if per_file else "true"
    return f"""WITH {_SCORED}, f AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT {fetch}), k AS (SELECT * FROM f {out}),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM k)
SELECT vec_id, label, round(score, 6) AS score FROM r WHERE {capped} ORDER BY r.score DESC, vec_id LIMIT 10"""


for _name, _per_file, _fetch, _tests in (("search_collapse", 2, 40, True), ("search_collapse_off", 0, 10, True), ("search_per_file_1", 1, 40, True), ("search_exclude_tests", 2, 40, False)):

    @_register(_name, _collapsed(_per_file, _fetch, _tests))
    def _search(spark, sf_dir, per_file=_per_file, tests=_tests):
        v = _vectors(spark, sf_dir)
        return _hits(search.search(v, _asked(v), 10, per_file, exclude_tests=not tests))


_EACH = f"""e AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, q.label AS asked, {_COS} AS score FROM embeddings c, embeddings q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM e QUALIFY rank <= 10)"""


@_register("knn_multi_query", f"WITH {_EACH} SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r")
def knn_multi_query(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return search.nearest_each(v, v.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def _laid_out(spark, sf_dir) -> parts.Parts:
    folder = scratch.fresh(spark, "vectors")
    parts.write_parts(_vectors(spark, sf_dir), folder)
    return parts.Parts.read(spark, folder)


@_register("knn_pruned", SQL["knn_topk"])
def knn_pruned(spark, sf_dir):
    return _hits(parts.search_parts(_laid_out(spark, sf_dir), _asked(_vectors(spark, sf_dir)), 40).hits)


@_register("knn_pruned_source", SQL["knn_source_filter"])
def knn_pruned_source(spark, sf_dir):
    return _hits(parts.search_parts(_laid_out(spark, sf_dir), _asked(_vectors(spark, sf_dir)), 10, F.col("label") == 3).hits)


@_register("knn_pruned_multi", SQL["knn_multi_query"])
def knn_pruned_multi(spark, sf_dir):
    found = parts.search_parts_each(_laid_out(spark, sf_dir), _vectors(spark, sf_dir).where("vec_id % 50 = 0"), 10, scratch.written)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def _outcomes(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    labels = v.select("vec_id", "label")
    found = search.nearest_each(v, v.where("vec_id % 50 = 0"), 10).where("vec_id <> query_id")
    asked = (labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked")))
    rows = found.join(labels, "vec_id").join(asked, "query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    needle = F.when(F.col("query_id") % 100 == 0, F.contains(F.col("vec_id").cast("string"), F.lit("7")))
    return evaluation.outcomes(rows.select("query_id", "rank", F.col("label").alias("file"), (F.col("label") == F.col("asked")).alias("wanted"), needle.alias("contains")))


_OUTCOMES = f"""WITH {_EACH}, w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM r WHERE vec_id <> query_id),
o AS (SELECT query_id, min(CASE WHEN label = asked THEN place END) AS first_rank, count(DISTINCT CASE WHEN place <= 5 THEN label END) AS distinct_files,
             max(CASE WHEN query_id % 100 = 0 THEN CASE WHEN label = asked AND contains(CAST(vec_id AS VARCHAR), '7') THEN 1 ELSE 0 END END) AS chunk_hit FROM w GROUP BY query_id)"""


@_register("eval_outcomes", f"{_OUTCOMES} SELECT query_id, CAST(first_rank AS INTEGER) AS first_rank, distinct_files, chunk_hit FROM o")
def eval_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).withColumn("chunk_hit", F.col("chunk_hit").cast("int"))


@_register("eval_report", f"""{_OUTCOMES} SELECT count(*) AS queries, round(avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5,
round(avg(CASE WHEN first_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / first_rank, 0.0)), 6) AS mrr, round(avg(CAST(chunk_hit AS DOUBLE)), 6) AS chunk_hit_rate, round(avg(distinct_files), 6) AS distinct_5 FROM o""")
def eval_report(spark, sf_dir):
    return evaluation.report(_outcomes(spark, sf_dir))


_PATHS = "concat('/Repo/', source, CASE doc_id % 12 WHEN 0 THEN '/a_test.go' WHEN 1 THEN '/a.go' WHEN 2 THEN '/tests/b.py' WHEN 3 THEN '/Test_c.py' WHEN 4 THEN '/latest/d.py' WHEN 5 THEN '/e.spec.TSX' WHEN 6 THEN '/spec/f.rb' WHEN 7 THEN '/edge.rs' WHEN 8 THEN '/contest_g.ts' WHEN 9 THEN '/__tests__/h.js' WHEN 10 THEN '/i_spec.lua' ELSE '/readme.md' END)"


@_register("is_test_path", f"SELECT doc_id, {_PATHS} AS uri, regexp_matches(lower({_PATHS}), '{text.TEST_PATTERN}') AS is_test FROM documents")
def is_test_path(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATHS).alias("uri")).withColumn("is_test", text.is_test_path(F.col("uri")))


# --- parsing and chunking --------------------------------------------------------------------


def _windows_sql(key: str, source: str) -> str:
    return f"""WITH w AS (SELECT {key}, flatten(list_transform(string_split(t, chr(10)), lambda l, i: list_transform(regexp_extract_all(l, '[^{text.SPACE}]+'), lambda x: {{'w': x, 'l': i}}))) AS words FROM ({source})),
c AS (SELECT {key}, unnest(range(0, CASE WHEN len(words) <= 220 THEN 1 ELSE CAST(ceil((len(words) - 220) / 180.0) AS BIGINT) + 1 END)) AS k, words FROM w WHERE len(words) > 0),
p AS (SELECT {key}, k, words[180 * k + 1 : 180 * k + 220] AS own FROM c)
SELECT {key}, CAST(k AS INTEGER) AS chunk_index, array_to_string(list_transform(own, lambda x: x.w), ' ') AS text, CAST(own[1].l AS INTEGER) AS start_line, CAST(own[-1].l AS INTEGER) AS end_line FROM p"""


_DOC_WINDOWS = _windows_sql("doc_id", "SELECT doc_id, text AS t FROM documents")


@_register("word_window_chunks", _DOC_WINDOWS)
def word_window_chunks(spark, sf_dir):
    return chunking.word_windows(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_register("chunk_function", _DOC_WINDOWS)
def chunk_function(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("language"))
    return table_functions.chunks(docs, "auto").drop("language", "context")


@_register("html_as_text_chunks", _windows_sql("page_id", "SELECT page_id, html AS t FROM pages"))
def html_as_text_chunks(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    body, _ = text.parsed(F.lit("text/html"), F.encode("html", "UTF-8"))
    return chunking.word_windows(pages.select("page_id", body.alias("text")))


@_register("chunk_stats", f"WITH x AS ({_DOC_WINDOWS}) SELECT (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM x) AS chunks, (SELECT count(*) FROM events WHERE event_type = 'error') AS failures")
def chunk_stats(spark, sf_dir):
    docs, log = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "events")
    parts = [
        docs.agg(F.count_distinct("source").alias("sources"), F.count("*").alias("documents")),
        docs.agg(F.coalesce(F.sum(chunking.window_count(chunking.word_count(F.col("text")))), F.lit(0)).cast("long").alias("chunks")),
        log.where("event_type = 'error'").agg(F.count("*").alias("failures")),
    ]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


# Closed and unclosed headers, line ends of both kinds, a fence before U+00A0, a header of some thousand lines that nothing closes.
_HEADED = """CASE doc_id % 7 WHEN 0 THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || text
WHEN 1 THEN '---' || chr(13) || chr(10) || 'a: b' || chr(13) || chr(10) || '---  ' || chr(13) || chr(10) || text
WHEN 2 THEN '---' || chr(10) || 'open' || chr(10) || text WHEN 3 THEN '---' || chr(10) || '---'
WHEN 4 THEN '---' || chr(10) || 'x' || chr(10) || '---\u00a0\u2003' || chr(10) || text
WHEN 5 THEN '---' || chr(10) || repeat('k: v' || chr(10), 5000) || text ELSE text END"""


@_register("strip_front_matter", f"""WITH h AS (SELECT doc_id, {_HEADED} AS t FROM documents), l AS (SELECT doc_id, t, string_split(t, chr(10)) AS lines FROM h),
e AS (SELECT *, CASE WHEN lines[1] IN ('---', '---' || chr(13)) THEN list_position(list_transform(lines[2:], lambda x: regexp_matches(x, '^---[{text.SPACE}]*$')), true) END AS shut FROM l)
SELECT doc_id, CASE WHEN shut > 0 THEN array_to_string(lines[shut + 2:], chr(10)) ELSE t END AS body, CASE WHEN shut > 0 THEN CAST(least(shut + 1, len(lines) - 1) + 1 AS INTEGER) ELSE 1 END AS starting_line FROM e""")
def strip_front_matter(spark, sf_dir):
    headed = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_HEADED).alias("t"))
    body, line = text.front_matter(F.col("t"))
    return headed.select("doc_id", body.alias("body"), line.alias("starting_line"))


_MIMES = "CASE doc_id % 4 WHEN 0 THEN 'text/markdown' WHEN 1 THEN ' Text/Markdown ; charset=utf-8' WHEN 2 THEN 'text/x-go' ELSE 'text/html' END"


@_register("mime_language", f"SELECT doc_id, CASE lower(trim(split_part({_MIMES}, ';', 1))) WHEN 'text/markdown' THEN 'markdown' WHEN 'text/x-go' THEN 'go' END AS language FROM documents")
def mime_language(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.language_of(F.expr(_MIMES)).alias("language"))


@_register("embed_text_labels", r"""WITH p AS (SELECT page_id, url, string_split(url, '/') AS parts, html FROM pages)
SELECT page_id, array_to_string(parts[greatest(len(parts) - 1, 1):], '/') AS label, array_to_string(parts[greatest(len(parts) - 1, 1):], '/') || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'A > B' || chr(10) ELSE '' END || html AS embedded FROM p""")
def embed_text_labels(spark, sf_dir):
    own = text.label(F.lit(""), F.col("url"))
    context = F.when(F.col("page_id") % 2 == 0, "A > B").otherwise("")
    return _table(spark, sf_dir, "pages").select("page_id", own.alias("label"), text.embed_text(own, context, F.col("html")).alias("embedded"))


@_register("snippets", f"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[{text.SPACE}]+', ' ', 'g')) AS flat FROM documents)
SELECT doc_id, CASE WHEN octet_length(encode(flat)) > 120 THEN substr(flat, 1, list_max(list_filter(range(0, 121), lambda i: octet_length(encode(substr(flat, 1, i))) <= 120))) || '…' ELSE flat END AS snippet FROM f""")
def snippets(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text"), 120).alias("snippet"))


_URIS = "CASE page_id % 6 WHEN 0 THEN concat('file:///srv//', page_id, '%20a') WHEN 1 THEN url WHEN 2 THEN '' WHEN 3 THEN concat('a//b/', page_id, '/') WHEN 4 THEN concat('/abs/', page_id) ELSE concat(page_id) END"


@_register("result_paths", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/srv/' || page_id || ' a' WHEN 3 THEN '/root/dir/a/b/' || page_id
WHEN 4 THEN '/abs/' || page_id WHEN 5 THEN '/root/dir/' || page_id END AS path FROM pages""")
def result_paths(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.result_path(F.expr(_URIS), "/root/dir/").alias("path"))


# --- identities ------------------------------------------------------------------------------


def _uuid_sql(space: str, name: str) -> str:
    return f"""(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)
FROM (SELECT sha1(unhex('{space.replace("-", "")}') || encode({name})) AS h))"""


@_register("document_ids", f"SELECT doc_id, {_uuid_sql(ids.DOCUMENT_SPACE, 'source || chr(0) || CAST(doc_id AS VARCHAR)')} AS document_id FROM documents")
def document_ids(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", ids.document_id(F.col("source"), F.col("doc_id").cast("string")).alias("document_id"))


@_register("point_ids", f"WITH x AS ({_DOC_WINDOWS}) SELECT doc_id, chunk_index, {_uuid_sql(ids.POINT_SPACE, 'CAST(doc_id AS VARCHAR) || chr(47) || CAST(chunk_index AS VARCHAR)')} AS point_id FROM x")
def point_ids(spark, sf_dir):
    chunks = chunking.window_indexes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return chunks.select("doc_id", "chunk_index", ids.point_id(F.col("doc_id").cast("string"), F.col("chunk_index")).alias("point_id"))


@_register("content_hashes", "SELECT doc_id, sha256(text) AS content_hash, CAST(n_chars AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR) AS fingerprint FROM documents")
def content_hashes(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"), ids.fingerprint(F.col("n_chars"), F.col("doc_id")).alias("fingerprint"))


# --- reconciliation and catalog --------------------------------------------------------------

# The catalog is missing some documents, the scan others; some were edited, of some only the fingerprint moved, some were hashed by the scan.
_CATALOG = "SELECT source AS source_id, CAST(doc_id AS STRING) AS uri, concat('d', doc_id) AS id, sha2(text, 256) AS content_hash, CAST(n_chars AS STRING) AS fingerprint, CAST(doc_id % 11 AS INT) AS chunk_count FROM documents WHERE doc_id % 7 <> 0"
_SCAN = "SELECT source AS source_id, CAST(doc_id AS STRING) AS uri, concat('n', doc_id) AS id, CASE WHEN doc_id % 4 = 0 THEN sha2(concat(text, CASE WHEN doc_id % 3 = 0 THEN '!' ELSE '' END), 256) ELSE '' END AS content_hash, CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 3 = 0 THEN concat(n_chars, '+') ELSE CAST(n_chars AS STRING) END AS fingerprint, CAST(doc_id % 5 AS INT) AS chunk_count FROM documents WHERE doc_id % 5 <> 0"


def _duck(sql: str) -> str:
    return sql.replace("sha2(text, 256)", "sha256(text)").replace("sha2(concat(text, CASE WHEN doc_id % 3 = 0 THEN '!' ELSE '' END), 256)", "sha256(concat(text, CASE WHEN doc_id % 3 = 0 THEN '!' ELSE '' END))").replace("AS STRING", "AS VARCHAR")


_SIDES = f"c AS ({_duck(_CATALOG)}), s AS ({_duck(_SCAN)})"
_PLAN = f"""WITH {_SIDES}, p AS (SELECT coalesce(s.source_id, c.source_id) AS source_id, coalesce(s.uri, c.uri) AS uri,
CASE WHEN s.uri IS NULL THEN 'vanished' WHEN c.uri IS NULL THEN 'new' WHEN CASE WHEN s.content_hash <> '' THEN s.content_hash = c.content_hash ELSE s.fingerprint <> '' AND s.fingerprint = c.fingerprint END THEN 'unchanged' ELSE 'changed' END AS action
FROM s FULL OUTER JOIN c ON s.source_id = c.source_id AND s.uri = c.uri)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents")
    return tuple(spark.sql(q.replace("FROM documents", "FROM {documents}"), documents=docs) for q in (_SCAN, _CATALOG))


@_register("reconcile_plan", f"{_PLAN} SELECT * FROM p")
def reconcile_plan(spark, sf_dir):
    return reconcile.plan(*_sides(spark, sf_dir))


@_register("reconcile_counts", f"{_PLAN} SELECT source_id, count(*) FILTER (WHERE action IN ('new', 'changed')) AS ingested, count(*) FILTER (WHERE action = 'unchanged') AS unchanged, count(*) FILTER (WHERE action = 'vanished') AS removed FROM p GROUP BY source_id")
def reconcile_counts(spark, sf_dir):
    return reconcile.totals(reconcile.plan(*_sides(spark, sf_dir)))


_READ = "SELECT source AS source_id, CAST(doc_id AS STRING) AS uri, sha2(text, 256) AS content_hash, CASE WHEN doc_id % 3 = 0 THEN concat(n_chars, '+') ELSE CAST(n_chars AS STRING) END AS fingerprint FROM documents WHERE doc_id % 5 <> 0"


@_register("reconcile_fingerprint_refresh", f"WITH c AS ({_duck(_CATALOG)}), r AS ({_duck(_READ)}) SELECT r.source_id, r.uri, c.fingerprint AS old_fingerprint, r.fingerprint FROM r JOIN c ON r.source_id = c.source_id AND r.uri = c.uri WHERE r.content_hash = c.content_hash AND r.fingerprint <> c.fingerprint")
def reconcile_fingerprint_refresh(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return reconcile.refreshed(spark.sql(_READ.replace("FROM documents", "FROM {documents}"), documents=docs), _sides(spark, sf_dir)[1])


@_register("orphan_failures", f"WITH {_SIDES}, f AS (SELECT DISTINCT source AS source_id, CAST(doc_id * 2 AS VARCHAR) AS uri FROM documents) SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source_id = f.source_id AND s.uri = f.uri) AND NOT EXISTS (SELECT 1 FROM c WHERE c.source_id = f.source_id AND c.uri = f.uri)")
def orphan_failures(spark, sf_dir):
    failures = _table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), (F.col("doc_id") * 2).cast("string").alias("uri")).distinct()
    return reconcile.orphans(failures, *_sides(spark, sf_dir))


@_register("upsert_documents", f"WITH {_SIDES} SELECT coalesce(c.source_id, s.source_id) AS source_id, coalesce(c.uri, s.uri) AS uri, coalesce(c.id, s.id) AS id, coalesce(s.content_hash, c.content_hash) AS content_hash, coalesce(s.fingerprint, c.fingerprint) AS fingerprint, coalesce(s.chunk_count, c.chunk_count) AS chunk_count FROM c FULL OUTER JOIN s ON s.source_id = c.source_id AND s.uri = c.uri")
def upsert_documents(spark, sf_dir):
    scan, known = _sides(spark, sf_dir)
    return reconcile.upserted(known, scan)


@_register("delete_sources", f"WITH c AS ({_duck(_CATALOG)}) SELECT source_id, count(*) AS documents, sum(chunk_count) AS chunks FROM c WHERE source_id NOT IN ('src0', 'src7') GROUP BY source_id")
def delete_sources(spark, sf_dir):
    gone = spark.createDataFrame([("src0",), ("src7",)], "id string")
    kept = catalog.deleted({"documents": _sides(spark, sf_dir)[1]}, gone)["documents"]
    return kept.groupBy("source_id").agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"))


# Hosts are folders: some whole, one the root, some with a slash at the end, some with parts that say nothing.
_ROOTS = r"""CASE WHEN page_id = 7 THEN '/' WHEN page_id % 10 = 0 THEN '/' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/'
WHEN page_id % 10 = 1 THEN '/./' || regexp_extract(url, '^[a-z]+://([^?#]*)', 1) ELSE '/' || regexp_extract(url, '^[a-z]+://([^?#]*)', 1) END"""
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(uri, '/(\./)+', '/', 'g'), '/+', '/', 'g'), '(.)/$', '\1')"


@_register("nesting_conflicts", f"""WITH u AS (SELECT page_id AS id, {_ROOTS} AS uri FROM pages), r AS (SELECT id, {_CLEAN} AS uri FROM u),
p AS (SELECT id, uri, CASE WHEN uri = '/' THEN '/' ELSE uri || '/' END AS folder FROM r),
m AS (SELECT a.id, b.id AS other, CASE WHEN a.uri = b.uri THEN 'equal' WHEN starts_with(a.uri, b.folder) THEN 'inside' ELSE 'contains' END AS relation
FROM p a JOIN p b ON b.id < a.id AND (a.uri = b.uri OR starts_with(a.uri, b.folder) OR starts_with(b.uri, a.folder)))
SELECT id, other, relation FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY other) = 1""")
def nesting_conflicts(spark, sf_dir):
    return reconcile.nesting(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.expr(_ROOTS.replace("\\", "\\\\")).alias("uri")))


# --- failures and events ---------------------------------------------------------------------

_FAILED = "SELECT user_id, count(*) AS attempts, arg_max(props, ts) AS error, max(ts) AS failed_at FROM events WHERE event_type = 'error' GROUP BY user_id"


def _failures(spark, sf_dir):
    log = _table(spark, sf_dir, "events").where("event_type = 'error'")
    return events.attempts(log, "user_id", "props", "ts")


@_register("failure_attempts", _FAILED)
def failure_attempts(spark, sf_dir):
    return _failures(spark, sf_dir)


@_register("failures_newest_first", f"WITH f AS ({_FAILED}) SELECT user_id, failed_at, CAST(row_number() OVER (ORDER BY failed_at DESC, user_id) AS INTEGER) AS place FROM f ORDER BY place LIMIT 100")
def failures_newest_first(spark, sf_dir):
    newest = events.newest_first(_failures(spark, sf_dir).select("user_id", "failed_at"), 100, tie="user_id")
    return newest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("failed_at"), "user_id")))  # a hundred rows


@_register("retry_delays", f"WITH f AS ({_FAILED}) SELECT user_id % 50 AS source, max(CASE WHEN attempts <= 3 THEN CAST(10 * power(2, attempts - 1) AS INTEGER) END) AS delay_ms FROM f GROUP BY 1")
def retry_delays(spark, sf_dir):
    return events.retry_delays(_failures(spark, sf_dir).withColumn("source", F.col("user_id") % 50), "source", "attempts", 10)


@_register("scan_summary", """WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase' AND user_id % 3 = 0) AS p, count(*) FILTER (WHERE event_type = 'signup' AND user_id % 3 = 0) AS s,
count(*) FILTER (WHERE event_type = 'error' AND user_id % 5 = 0) AS e, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS c, count(*) * 100 AS took FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN p + s + e > 0 OR took >= 750 THEN concat_ws(', ', CASE WHEN p > 0 THEN p || ' indexed' END, CASE WHEN s > 0 THEN s || ' removed' END, CASE WHEN e > 0 THEN e || ' failed' END,
CASE WHEN p + s + e = 0 THEN c || ' unchanged' END) || ' in ' || printf('%.1f', took / 1000.0) || 's' END AS summary FROM c""")
def scan_summary(spark, sf_dir):
    n = lambda when, *kinds: F.count_if(F.col("event_type").isin(*kinds) & F.expr(when))
    counted = _table(spark, sf_dir, "events").groupBy("user_id").agg(
        n("user_id % 3 = 0", "purchase").alias("p"), n("user_id % 3 = 0", "signup").alias("s"), n("user_id % 5 = 0", "error").alias("e"), n("true", "view", "click").alias("c"), (F.count("*") * 100).alias("took")
    )
    return counted.select("user_id", text.scan_summary(F.col("p"), F.col("s"), F.col("e"), F.col("c"), F.col("took")).alias("summary"))


@_register("event_rates", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(count(*) / 60.0, 6) AS per_minute FROM events GROUP BY 1, 2")
def event_rates(spark, sf_dir):
    found = events.per_minute(_table(spark, sf_dir, "events"), "ts", "event_type")
    return found.withColumns({"hour": F.col("hour").cast("timestamp_ntz"), "per_minute": F.round("per_minute", 6)})


@_register("ring_replay_512", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 512")
def ring_replay_512(spark, sf_dir):
    return events.replay(_table(spark, sf_dir, "events")).select("event_id", "event_type")


@_register("recent_15", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click') ORDER BY event_id DESC LIMIT 15")
def recent_15(spark, sf_dir):
    return events.replay(_table(spark, sf_dir, "events").where("event_type NOT IN ('view', 'click')"), 15).select("event_id", "event_type")


@_register("events_of_types", "SELECT event_id, ts, event_type FROM events WHERE event_type IN ('error', 'signup')")
def events_of_types(spark, sf_dir):
    return events.of_kinds(_table(spark, sf_dir, "events"), "error, signup", "event_type").select("event_id", "ts", "event_type")


@_register("state_transitions", "SELECT event_id, user_id, from_state, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events) WHERE from_state <> event_type")
def state_transitions(spark, sf_dir):
    return events.transitions(_table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "from_state", "event_type")


@_register("debounced_scans", """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opened FROM events),
r AS (SELECT *, sum(opened) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT user_id, min(ts) AS first, max(ts) + INTERVAL 1 HOUR AS fires, count(*) AS hints FROM r GROUP BY user_id, run""")
def debounced_scans(spark, sf_dir):
    return events.debounced(_table(spark, sf_dir, "events"), "user_id", "ts", 3_600_000_000)


@_register("idle_gaps", """SELECT user_id, ts AS idle_from, nxt AS idle_until, epoch_us(nxt) - epoch_us(ts) AS gap_us FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events) WHERE nxt - ts >= INTERVAL 5 MINUTE""")
def idle_gaps(spark, sf_dir):
    return events.idle_gaps(_table(spark, sf_dir, "events"), "user_id", "ts", 300_000_000)


_STEP = "CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 WHEN 'click' THEN -1 ELSE 0 END"


@_register("pending_gauge", f"""WITH s AS (SELECT event_id, user_id, ts, sum({_STEP}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM events)
SELECT event_id, user_id, CAST(total - least(0, min(total) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS level FROM s""")
def pending_gauge(spark, sf_dir):
    return events.gauge(_table(spark, sf_dir, "events"), "user_id", F.expr(_STEP), ["ts", "event_id"]).select("event_id", "user_id", "level")


@_register("fifo_dedup", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def fifo_dedup(spark, sf_dir):
    return events.first_in_line(_table(spark, sf_dir, "events"), "user_id", "event_id")


@_register("phase_meters", """WITH p AS (SELECT event_id, event_id % 37 AS done, event_id % 41 AS total FROM events), q AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor(done / total * 100) AS BIGINT) END AS percent FROM p),
f AS (SELECT *, CAST(floor(least(1.0, percent / 100) * 14 + 0.5) AS INTEGER) AS cells FROM q)
SELECT event_id, percent, CASE WHEN total > 0 THEN '▕' || repeat('█', cells) || repeat('░', 14 - cells) || '▏' END AS bar FROM f""")
def phase_meters(spark, sf_dir):
    p = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 37).alias("done"), (F.col("event_id") % 41).alias("total"))
    return p.select("event_id", text.percent(F.col("done"), F.col("total")).alias("percent"), text.meter(F.col("done"), F.nullif(F.col("total"), F.lit(0))).alias("bar"))


@_register("event_lines", """SELECT event_id, '{"seq":' || event_id || ',"kind":"' || event_type || '"' || CASE WHEN user_id % 4 = 0 THEN '' ELSE ',"user_id":' || user_id END ||
CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"detail":"<a & b>"' END || '}' AS line FROM events""")
def event_lines(spark, sf_dir):
    detail = F.when(F.col("event_id") % 3 == 0, "").otherwise("<a & b>")
    shaped = _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.when(F.col("user_id") % 4 == 0, 0).otherwise(F.col("user_id")).alias("user_id"), detail.alias("detail"))
    return events.lines(shaped).withColumn("event_id", F.get_json_object("line", "$.seq").cast("long")).select("event_id", "line")


@_register("hashing_search", f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^{text.SPACE}]+')) AS word FROM documents),
b AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 7) AS BIGINT) % 384 AS bucket, count(*) AS n FROM w GROUP BY 1, 2),
v AS (SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS weight FROM b),
s AS (SELECT v.doc_id, round(sum(v.weight * q.weight), 9) AS s FROM v JOIN v q ON q.doc_id = 1 AND q.bucket = v.bucket GROUP BY v.doc_id)
SELECT doc_id, round(s, 6) AS score FROM s ORDER BY s.s DESC, doc_id LIMIT 40""")
def hashing_search(spark, sf_dir):
    from quarry.operators import embedding

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return embedding.nearest_by_hash(docs, docs.where("doc_id = 1"), "doc_id", 40)


from quarry.jobs import registry_more  # noqa: E402, F401  (registers the rest)
