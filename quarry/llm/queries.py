"""Registered queries of this subpackage, and the SQL that their rows are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, jaccard, language, minhash, pieces, recurrent, repair, secrets, suffixes, topk, trie, url_rules, warc
from quarry.llm.common import staged, table

URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return recurrent.fit_and_score(docs, ~recurrent.held_out()).withColumn("held_out", recurrent.held_out())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("archive")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()))
    return language.predict(docs.select("doc_id", "text", language.held_out().alias("held_out")), model).drop("text")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, prefix string, verdict string")
    return url_rules.filter_urls(table(spark, sf_dir, "pages"), rules)


def op11_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.rebuilt(staged(trie.signed(trie.ordered(table(spark, sf_dir, "conversations"))), "turns")))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    turns = repair.damaged(conversations)
    return repair.repair_report(conversations, turns, staged(repair.audits(turns), "audits"))


def _sql_spans(rule: secrets.Rule, rank: int) -> str:
    quoted = rule.pattern.replace("'", "''")
    own = f"regexp_extract_all(t, '{quoted}', {rule.group})"
    return f"""
    SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind,
           list_sum(gaps[1:i]) + coalesce(list_sum(whole[1:i - 1]), 0) AS s,
           list_sum(gaps[1:i]) + list_sum(whole[1:i]) AS e
    FROM (SELECT doc_id, unnest(range(1, len(whole) + 1)) AS i, whole, own, gaps FROM (
            SELECT doc_id,
                   list_transform(regexp_extract_all(t, '{quoted}'), lambda x: length(x)) AS whole,
                   list_transform({own}, lambda x: length(x)) AS own,
                   list_transform(regexp_split_to_array(t, '{quoted}'), lambda x: length(x)) AS gaps
            FROM texts WHERE regexp_matches(t, '{quoted}')))
    WHERE own[i] >= {rule.least}"""


OP1_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_sql_spans(r, n) for n, r in enumerate(secrets.RULES))})
SELECT d.doc_id,
       count(*) FILTER (WHERE rank = 0) AS n_assign,
       count(*) FILTER (WHERE rank = 1) AS n_access,
       count(*) FILTER (WHERE rank = 2) AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank), '') AS spans
FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""

OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

OP10_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(h, p, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
m AS (SELECT page_id, h || p AS rule, v FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT page_id, rule, v FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, rule DESC) = 1)
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN best USING (page_id)"""

OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN kept END AS refers_to FROM k"""

OP12_SQL = r"""
WITH own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (SELECT conv_id, l, xor(list_reduce(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
        lambda acc, b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(acc, b)), 4294967295), 4294967295) % 4 AS h FROM own),
full_ AS (SELECT c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) AS s FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
sequences AS (SELECT s, min(conv_id) AS conv_id, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM full_ GROUP BY s),
nodes AS (SELECT s[1:d] AS p, d, min(conv_id) AS conv_id, CAST(sum(n) AS BIGINT) AS n_convs, max(CASE WHEN len(s) = d THEN ends END) AS ends
          FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM sequences) GROUP BY ALL),
valued AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) END AS saved,
                  (SELECT count(*) FROM nodes c WHERE c.d = nodes.d + 1 AND c.p[1:nodes.d] = nodes.p) AS n_children FROM nodes),
above AS (SELECT p[1:a] AS p, a AS d, saved, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM valued)),
totals AS (SELECT p, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM above GROUP BY p)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, t.n_leaves, t.saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v JOIN totals t ON t.p = v.p LEFT JOIN nodes u ON v.d > 0 AND u.d = v.d - 1 AND u.p = v.p[1:v.d - 1]"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_decontamination": op5_decontamination,
    "op6_recurrent_lm": op6_recurrent_lm,
    "op7_warc": op7_warc,
    "op8_language": op8_language,
    "op9_exact_topk": op9_exact_topk,
    "op10_url_filter": op10_url_filter,
    "op11_circulant_minhash": op11_circulant_minhash,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_structure_repair": op13_structure_repair,
}
SQL: dict[str, str] = {"op1_secret_scan": OP1_SQL, "op7_warc": OP7_SQL, "op9_exact_topk": OP9_SQL, "op10_url_filter": OP10_SQL, "op12_prefix_trie": OP12_SQL}
