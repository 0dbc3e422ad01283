"""Queries on logs: levels, deduplication, condensing, display, line kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.functions import logs as f
from lodeglass.functions.text import line_tokens, percent_saved, text_tokens
from lodeglass.operators import logs
from lodeglass.plans import sqltext as q
from lodeglass.session import table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "log_lines")


def log_levels(spark: SparkSession, d: str) -> DataFrame:
    return logs.trouble_lines(_lines(spark, d))


def log_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return logs.deduplicated(logs.trouble_lines(_lines(spark, d)))


def log_compress(spark: SparkSession, d: str) -> DataFrame:
    found = logs.condensed(_lines(spark, d))
    return found.select("path", "line_no", "level", f.display_message(F.col("message")).alias("message"), "occurrences")


def log_compress_all(spark: SparkSession, d: str) -> DataFrame:
    """Every group of alike trouble lines, however many, alike in their whole text."""
    found = logs.condensed(_lines(spark, d), entries=None, per_level=None, key_chars=None)
    return found.select("path", "line_no", "level", f.display_message(F.col("message")).alias("message"), "occurrences")


def log_left_out(spark: SparkSession, d: str) -> DataFrame:
    """What the condensed report leaves out of each log; a report of twenty groups, five of a level, which the logs exceed."""
    return logs.left_out(logs.deduplicated(logs.trouble_lines(_lines(spark, d))), entries=20, per_level=5)


def log_context(spark: SparkSession, d: str) -> DataFrame:
    found = logs.with_context(logs.condensed(_lines(spark, d)), _lines(spark, d))
    return found.select("path", "line_no", "level", "occurrences", F.array_join("context", "\n").alias("context"))


def log_normalize(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(f.display_message(F.col("text"))).alias("digest"))


def log_line_kinds(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    fields = f.json_fields(line)
    return _lines(spark, d).select(
        "path", "line_no", f.is_stack_line(line).alias("stack"), f.is_repetition(line).alias("repetition"), f.has_time(line).alias("timed"), f.line_format(line).alias("format"),
        F.coalesce(fields["level"], F.lit("")).alias("json_level"), F.coalesce(fields["message"], F.lit("")).alias("json_message"),
    ).distinct()


def log_level_counts(spark: SparkSession, d: str) -> DataFrame:
    return logs.trouble_lines(_lines(spark, d)).groupBy("level").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("path").alias("files"))


def log_savings(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each log before and after condensing."""
    before = _lines(spark, d).select("path", "line_no", "line").distinct().groupBy("path").agg(F.sum(line_tokens(F.col("line"))).alias("before"))
    after = log_compress(spark, d).groupBy("path").agg(F.sum(text_tokens("message")).alias("after"))
    both = before.join(after, "path", "left").fillna(0, ["after"])
    return both.select("path", "before", "after", percent_saved("before", "after").alias("percent"))


_LEVEL = r"""CASE WHEN regexp_matches(line, '(?i)\b(FATAL|CRITICAL|EMERGENCY)\b') THEN 'FATAL'
 WHEN regexp_matches(line, '(?i)\b(ERROR|ERR|Exception|Traceback|Error:|SEVERE)\b') THEN 'ERROR'
 WHEN regexp_matches(line, '(?i)\b(WARN|WARNING|DEPRECAT|DEPRECATED)\b') THEN 'WARN' END"""
_FOUND = f"found AS (SELECT DISTINCT path, line_no, {_LEVEL} AS level, {q.trim('line')} AS message FROM log_lines WHERE ({_LEVEL}) IS NOT NULL)"
_TIME = r"'\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.,\d]*', '<TIME>', 'g'"
_UUID = r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
_KEY = rf"left(regexp_replace(regexp_replace(regexp_replace(message, {_TIME}), '{_UUID}', '<UUID>', 'g'), '\b\d+\b', '<N>', 'g'), 120)"
_DEDUP = f"""{_FOUND}, dedup AS (
  SELECT path, min(line_no) AS line_no, arg_min(level, line_no) AS level, arg_min(message, line_no) AS message, count(*) AS occurrences, max(line_no) AS last_line_no
  FROM (SELECT *, {_KEY} AS k FROM found) GROUP BY path, k)"""


def _display(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, {_TIME}), '(?i){_UUID}', '<UUID>', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '\b\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\b', '<IP>', 'g'), 'https?://[^\s]+', '<URL>', 'g')"
    return rf"trim(regexp_replace(regexp_replace({out}, '/(?:[\w./\-]*/)([\w.\-]*)|/([\w.\-]+)', '\1\2', 'g'), '[\s\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+', ' ', 'g'))"


_COND = f"""{_DEDUP}, first AS (SELECT * FROM dedup QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) <= 200),
cond AS (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY path, level ORDER BY line_no) <= 100)"""
_ALL = _DEDUP.replace(", 120)", ", 1000000000)")
_STACK = "|".join(f"(?:{p})" for p in f.STACK_LINES)

QUERIES = {
    "log_levels": log_levels, "log_dedupe": log_dedupe, "log_compress": log_compress, "log_compress_all": log_compress_all, "log_left_out": log_left_out, "log_context": log_context, "log_normalize": log_normalize,
    "log_line_kinds": log_line_kinds, "log_level_counts": log_level_counts, "log_savings": log_savings,
}
ORACLES = {
    "log_levels": f"WITH {_FOUND} SELECT * FROM found",
    "log_dedupe": f"WITH {_DEDUP} SELECT * FROM dedup",
    "log_compress": f"WITH {_COND} SELECT path, line_no, level, {_display('message')} AS message, occurrences FROM cond",
    "log_compress_all": f"WITH {_ALL} SELECT path, line_no, level, {_display('message')} AS message, occurrences FROM dedup",
    "log_left_out": f"""WITH {_DEDUP}, a AS (SELECT * FROM dedup QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) <= 20), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY path, level ORDER BY line_no) <= 5)
        SELECT d.path, groups, shown, groups - shown AS dropped, lines - shown_lines AS dropped_lines FROM (SELECT path, count(*) AS groups, sum(occurrences)::BIGINT AS lines FROM dedup GROUP BY path) d
        JOIN (SELECT path, count(*) AS shown, sum(occurrences)::BIGINT AS shown_lines FROM b GROUP BY path) s ON s.path = d.path""",
    "log_context": f"""
        WITH {_COND}, t AS (SELECT DISTINCT path, line_no AS n, {q.trim('line')} AS s FROM log_lines)
        SELECT c.path, c.line_no, any_value(c.level) AS level, any_value(c.occurrences) AS occurrences, coalesce(string_agg(t.s, chr(10) ORDER BY t.n) FILTER (t.s <> ''), '') AS context
        FROM cond c LEFT JOIN t ON t.path = c.path AND t.n BETWEEN c.line_no - 3 AND c.line_no + 3 AND t.n <> c.line_no GROUP BY c.path, c.line_no""",
    "log_normalize": f"SELECT doc_id, md5({_display('text')}) AS digest FROM documents",
    "log_line_kinds": rf"""
        SELECT DISTINCT path, line_no, regexp_matches(line, '{_STACK}') AS stack, regexp_matches(line, '(?i)(\.\.\.|repeated|again|above|similar|same error)') AS repetition,
               regexp_matches(line, '\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}|\[\d{{2}}:\d{{2}}:\d{{2}}\]') AS timed,
               CASE WHEN json_valid(line) THEN 'json' WHEN regexp_matches(line, '\w+=\S+') THEN 'logfmt' ELSE 'plain' END AS format,
               CASE WHEN json_valid(line) THEN coalesce(line->>'$.level', line->>'$.severity', line->>'$.lvl', '') ELSE '' END AS json_level,
               CASE WHEN json_valid(line) THEN coalesce(line->>'$.message', line->>'$.msg', line->>'$.text', '') ELSE '' END AS json_message FROM log_lines""",
    "log_level_counts": f"WITH {_FOUND} SELECT level, count(*) AS lines, count(DISTINCT path) AS files FROM found GROUP BY level",
    "log_savings": f"""
        WITH {_COND}, b AS (SELECT path, sum({q.code_tokens('line')})::BIGINT AS before FROM (SELECT DISTINCT path, line_no, line FROM log_lines) GROUP BY path),
        a AS (SELECT path, sum(ceil(length({_display('message')}) / 4.0))::BIGINT AS after FROM cond GROUP BY path)
        SELECT b.path, before, coalesce(after, 0) AS after, CASE WHEN before = 0 THEN 0 ELSE floor((before - coalesce(after, 0)) * 100.0 / before + 0.5)::BIGINT END AS percent FROM b LEFT JOIN a USING (path)""",
}
