"""Queries on texts: tokens, hashes, lines, sections, search, terms, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.functions import text
from lodeglass.operators import chunk, projectmap, search
from lodeglass.plans import samples
from lodeglass.plans import sqltext as q
from lodeglass.session import spread, table
from lodeglass.sources.files import distinct_files, file_lines, file_records

PATTERN = r"\b(?:token|budget)s?\b"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _code(spark: SparkSession, d: str) -> DataFrame:
    return distinct_files(table(spark, d, "code_files").select("root", "path", "content").unionByName(samples.frame(spark)))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(text.lines_of("text")).cast("bigint")
    return _docs(spark, d).select("doc_id", text.text_tokens("text").alias("tokens"), text.code_tokens("text").alias("code_tokens"), text.lines_tokens(n).alias("line_tokens"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.content_hash("text").alias("hash"))


def line_explode(spark: SparkSession, d: str) -> DataFrame:
    return file_lines(_docs(spark, d), ["doc_id"], "text")


def tumbling_sections(spark: SparkSession, d: str) -> DataFrame:
    found = chunk.chunks(_code(spark, d), ["root", "path"], chunk.section_spans)
    return found.select("root", "path", "chunk_no", "start_line", "end_line", F.md5("text").alias("digest"))


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "file_chunks").where("content IS NOT NULL").select("path", F.col("chunk_no").alias("part"), "content").distinct()
    found = chunk.chunks(chunks, ["path", "part"], chunk.window_spans)
    return found.select("path", "part", "chunk_no", "start_line", "end_line", F.md5("text").alias("digest"))


def bulk_search_context(spark: SparkSession, d: str) -> DataFrame:
    found = search.first_matches(search.matching_lines(_docs(spark, d), PATTERN, key="doc_id", content="text"), "doc_id")
    return found.select("doc_id", "line_no", "line", F.array_join("context", "\n").alias("context"))


def bulk_search_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.matching_lines(_docs(spark, d), PATTERN, key="doc_id", content="text", context_lines=0).select("doc_id", "line_no", "line")


def bulk_search_files(spark: SparkSession, d: str) -> DataFrame:
    return search.matches_by_file(search.matching_lines(_docs(spark, d), PATTERN, key="doc_id", content="text", context_lines=0), "doc_id")


def bulk_search_totals(spark: SparkSession, d: str) -> DataFrame:
    return search.match_totals(search.matching_lines(_docs(spark, d), PATTERN, key="doc_id", content="text", context_lines=0), "doc_id")


def identifier_tokens(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "file_chunks").where("identifier IS NOT NULL").select("identifier").distinct()
    names = names.union(table(spark, d, "customer").select("c_name")).distinct()
    return names.select("identifier", F.explode(text.identifier_tokens("identifier")).alias("token"))


def document_terms(spark: SparkSession, d: str) -> DataFrame:
    from lodeglass.operators.rank import term_table

    return term_table(spread(_docs(spark, d).select("doc_id", "text")), "doc_id", "text")


def file_summary(spark: SparkSession, d: str) -> DataFrame:
    return _code(spark, d).select("root", "path", "language", text.summary_of("content", "language").alias("summary"))


def file_records_query(spark: SparkSession, d: str) -> DataFrame:
    files = _code(spark, d).withColumn("path", F.concat_ws("/", "root", "path"))
    return file_records(files, F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")).drop("last_read_at", "summary")


def redact_private(spark: SparkSession, d: str) -> DataFrame:
    """Every other line of each document marked private, then redacted."""
    marked = F.array_join(F.transform(text.lines_of("text"), lambda x, k: F.when(k % 2 == 1, F.concat(F.lit("<PRIVATE>"), x, F.lit("</private>"))).otherwise(x)), "\n")
    return _docs(spark, d).select("doc_id", F.md5(text.redacted(marked)).alias("digest"))


def savings_report(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", text.code_tokens("text").alias("before"), text.text_tokens(text.truncated("text", 200)).alias("after"))
    return docs.select("doc_id", "before", "after", text.percent_saved("before", "after").alias("percent"), text.token_label("before").alias("label"))


def project_map_language(spark: SparkSession, d: str) -> DataFrame:
    return projectmap.by_language(projectmap.scanned_entries(table(spark, d, "project_map")))


def project_map_directory(spark: SparkSession, d: str) -> DataFrame:
    return projectmap.by_directory(projectmap.scanned_entries(table(spark, d, "project_map")))


def project_map_totals(spark: SparkSession, d: str) -> DataFrame:
    return projectmap.totals(projectmap.scanned_entries(table(spark, d, "project_map")))


def project_map_entries(spark: SparkSession, d: str) -> DataFrame:
    return projectmap.map_entries(_code(spark, d))


_P = "(?i)" + PATTERN
_LINES = q.lines("documents", "doc_id", "text")
_CTX = f"""
WITH l AS ({_LINES}), t AS (SELECT doc_id, n, {q.trim('line')} AS s FROM l),
m AS (SELECT doc_id, n, {q.trim('line')} AS line FROM l WHERE regexp_matches(line, '{_P}') ORDER BY doc_id, n LIMIT 50)
SELECT m.doc_id, m.n AS line_no, any_value(m.line) AS line, coalesce(string_agg(t.s, chr(10) ORDER BY t.n) FILTER (t.s <> ''), '') AS context
FROM m LEFT JOIN t ON t.doc_id = m.doc_id AND t.n BETWEEN m.n - 2 AND m.n + 2 AND t.n <> m.n GROUP BY m.doc_id, m.n
"""
_SPANS = "SELECT {keys}, generate_subscripts(s, 1) AS chunk_no, unnest(s) AS i, ls FROM (SELECT {keys}, ls, range(0, len(ls), {step}) AS s FROM (SELECT {keys}, string_split(content, chr(10)) AS ls FROM {src}))"
_CUT = "SELECT {keys}, chunk_no, (i + 1)::INT AS start_line, least(i + {size}, len(ls))::INT AS end_line, md5(array_to_string(ls[i + 1:i + {size}], chr(10))) AS digest FROM ({spans})"
_ENTRIES = f"""
e AS (SELECT root_path AS root, path, {q.language('path', 'other')} AS language, max(line_count) AS line_count, max(line_count) * 10 AS token_estimate
      FROM project_map WHERE root_path IS NOT NULL AND path IS NOT NULL GROUP BY root_path, path)
"""
_SUMS = "count(*) AS files, coalesce(sum(line_count), 0)::BIGINT AS lines, coalesce(sum(token_estimate), 0)::BIGINT AS tokens"
_NAME = "regexp_extract(path, '[^/]*$')"
_LANG = q.language("path")
_FLAT = f"list_transform(string_split(content, chr(10)), lambda x: {q.trim('x')})"
_SUMMARY = f"""
WITH {q.CF}, f AS (SELECT root, path, content, {_LANG} AS language, len(string_split(content, chr(10))) AS n, {_FLAT} AS flat FROM cf),
g AS (SELECT *, list_transform(list_filter(flat, lambda x: regexp_matches(x, '^export\\s+(function|class|const|interface|type|enum)'))[:8], lambda x: {q.trim("regexp_replace(x, '[{].*', '')")}) AS ex,
      list_transform(list_filter(flat, lambda x: regexp_matches(x, '^(def|class)\\s+'))[:8], lambda x: regexp_replace(string_split(x, '(')[1], '^(def|class)\\s+', '')) AS df FROM f)
SELECT root, path, language, n || ' lines. ' || CASE WHEN language IN ('typescript', 'javascript') AND len(ex) > 0 THEN 'Exports: ' || array_to_string(ex, ', ')
  WHEN language = 'python' AND len(df) > 0 THEN 'Defines: ' || array_to_string(df, ', ')
  ELSE 'Starts: ' || left({q.trim("array_to_string(string_split(content, chr(10))[:5], chr(10))")}, 100) END AS summary FROM g
"""

QUERIES = {
    "token_estimate": token_estimate, "content_hash": content_hash, "line_explode": line_explode, "tumbling_sections": tumbling_sections,
    "sliding_windows": sliding_windows, "bulk_search_context": bulk_search_context, "bulk_search_lines": bulk_search_lines,
    "bulk_search_files": bulk_search_files, "bulk_search_totals": bulk_search_totals, "identifier_tokens": identifier_tokens, "document_terms": document_terms,
    "file_summary": file_summary, "file_records": file_records_query, "redact_private": redact_private, "savings_report": savings_report,
    "project_map_language": project_map_language, "project_map_directory": project_map_directory, "project_map_totals": project_map_totals,
    "project_map_entries": project_map_entries,
}
ORACLES = {
    "token_estimate": f"SELECT doc_id, cast(ceil(length(text) / 4.0) AS BIGINT) AS tokens, {q.code_tokens('text')} AS code_tokens, len(string_split(text, chr(10))) * 10 AS line_tokens FROM documents",
    "content_hash": "SELECT doc_id, left(sha256(text), 16) AS hash FROM documents",
    "line_explode": f"SELECT doc_id, n AS line_no, line FROM ({_LINES})",
    "tumbling_sections": f"WITH {q.CF} " + _CUT.format(keys="root, path", size=30, spans=_SPANS.format(keys="root, path", step=30, src="cf")),
    "sliding_windows": "WITH c AS (SELECT DISTINCT path, chunk_no AS part, content FROM file_chunks WHERE content IS NOT NULL) "
    + _CUT.format(keys="path, part", size=60, spans=_SPANS.format(keys="path, part", step=50, src="c")),
    "bulk_search_context": _CTX,
    "bulk_search_lines": f"SELECT doc_id, n AS line_no, {q.trim('line')} AS line FROM ({_LINES}) WHERE regexp_matches(line, '{_P}')",
    "bulk_search_files": f"SELECT doc_id, count(*) AS matches FROM ({_LINES}) WHERE regexp_matches(line, '{_P}') GROUP BY doc_id",
    "bulk_search_totals": f"SELECT count(*) AS matches, count(DISTINCT doc_id) AS files FROM ({_LINES}) WHERE regexp_matches(line, '{_P}')",
    "identifier_tokens": f"SELECT identifier, unnest({q.identifier_tokens('identifier')}) AS token FROM (SELECT identifier FROM file_chunks WHERE identifier IS NOT NULL UNION SELECT c_name FROM customer)",
    "document_terms": f"SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest({q.document_terms('text')}) AS term FROM documents) GROUP BY doc_id, term",
    "file_summary": _SUMMARY,
    "file_records": f"WITH {q.CF} SELECT root || '/' || path AS path, left(sha256(content), 16) AS hash, {_LANG} AS language, len(string_split(content, chr(10))) AS line_count, {q.code_tokens('content')} AS token_estimate FROM cf",
    "redact_private": "SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 2 = 0 THEN '<private>[redacted]</private>' ELSE x END), chr(10))) AS digest FROM documents",
    "savings_report": f"""
        WITH s AS (SELECT doc_id, {q.code_tokens('text')} AS before, cast(ceil(least(length(text), 200) / 4.0) AS BIGINT) AS after FROM documents)
        SELECT doc_id, before, after, CASE WHEN before = 0 THEN 0 ELSE cast(floor((before - after) * 100.0 / before + 0.5) AS BIGINT) END AS percent,
               CASE WHEN before >= 1000 THEN printf('%.1fk', floor(before / 100.0 + 0.5) / 10) ELSE before::VARCHAR END AS label FROM s""",
    "project_map_language": f"WITH {_ENTRIES} SELECT language, {_SUMS} FROM e GROUP BY language",
    "project_map_directory": f"WITH {_ENTRIES} SELECT root, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS folder, {_SUMS} FROM e GROUP BY ALL",
    "project_map_totals": f"WITH {_ENTRIES} SELECT {_SUMS} FROM e",
    "project_map_entries": f"""
        WITH {q.CF}, f AS (SELECT root, path, {q.language('path', 'other')} AS language, {_NAME} AS name, len(string_split(content, chr(10))) AS line_count FROM cf)
        SELECT root, path, language, line_count, line_count * 10 AS token_estimate, CASE WHEN name IN ('index.ts', 'index.js') THEN 'entry point'
          WHEN name SIMILAR TO '.*(test|spec).*' THEN 'tests' WHEN contains(name, 'config') THEN 'configuration' WHEN name SIMILAR TO '.*(type|model).*' THEN 'types/models'
          WHEN name SIMILAR TO '.*(util|helper).*' THEN 'utilities' WHEN contains(name, 'service') THEN 'service' WHEN contains(name, 'controller') THEN 'controller'
          WHEN contains(name, 'route') THEN 'routes' WHEN name IN ('README.md', 'readme.md') THEN 'documentation' WHEN name = 'package.json' THEN 'npm package config'
          WHEN language <> 'other' THEN language ELSE 'file' END AS description FROM f""",
}
