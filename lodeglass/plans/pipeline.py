"""Queries on new and changed files (problem 2) and on log entries (problem 4)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.operators import incremental, logentries
from lodeglass.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    listing = incremental.present_files(table(spark, d, "file_cache"))
    manifest = incremental.indexed_files(table(spark, d, "symbol_files"), table(spark, d, "index_runs"))
    return incremental.pending(listing, manifest).select("path", "hash")


def p2_removed(spark: SparkSession, d: str) -> DataFrame:
    listing = incremental.present_files(table(spark, d, "file_cache"))
    manifest = incremental.indexed_files(table(spark, d, "symbol_files"), table(spark, d, "index_runs"))
    return incremental.removed(listing, manifest)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return logentries.log_entries(table(spark, d, "log_lines")).select("path", "line_no", "end_line_no", "logged_at", "level", "component")


def p4_messages(spark: SparkSession, d: str) -> DataFrame:
    """Every entry with its whole message, as a checksum and a length beside the first line."""
    entries = logentries.log_entries(table(spark, d, "log_lines"))
    first = F.split_part("message", F.lit("\n"), F.lit(1))
    return entries.select("path", "line_no", first.alias("first_line"), F.length("message").alias("n_chars"), F.md5("message").alias("digest"))


def p4_scanned(spark: SparkSession, d: str) -> DataFrame:
    """What the project's own scan guessed, beside level and time of the entry that each finding belongs to."""
    return logentries.scanned_entries(table(spark, d, "log_entries"), table(spark, d, "log_lines"))


_LISTING = """
listing AS (SELECT path, max_by(lower(hash), (last_read_at, lower(hash))) AS hash FROM file_cache
            WHERE hash IS NOT NULL AND path IS NOT NULL AND last_read_at IS NOT NULL GROUP BY path),
good AS (SELECT run_id FROM index_runs WHERE run_id IS NOT NULL AND noted_at IS NOT NULL
         GROUP BY run_id HAVING max_by(status, (noted_at, status)) = 'ok'),
manifest AS (SELECT file_path AS path, arg_max(lower(hash), indexed_at) AS hash
             FROM symbol_files JOIN good USING (run_id)
             WHERE file_path IS NOT NULL AND indexed_at IS NOT NULL GROUP BY file_path)
"""

QUERIES = {"p2_found": p2_found, "p2_removed": p2_removed, "p4_found": p4_found, "p4_messages": p4_messages, "p4_scanned": p4_scanned}
ORACLES = {
    "p2_found": f"WITH {_LISTING} SELECT l.path, l.hash FROM listing l LEFT JOIN manifest m ON l.path = m.path WHERE m.hash IS NULL OR m.hash <> l.hash",
    "p2_removed": f"WITH {_LISTING} SELECT path FROM manifest WHERE path NOT IN (SELECT path FROM listing)",
}


# -- SQL of the log entries: the same rule, said line by line ---------------------------------------------------------
_LEVELS = "CASE upper({0}) " + " ".join(
    f"WHEN '{w}' THEN '{level}'" for level, words in (logentries.LEVEL_WORDS | {"": []}).items() for w in words
) + " WHEN 'F' THEN 'FATAL' WHEN 'E' THEN 'ERROR' WHEN 'W' THEN 'WARN' WHEN 'I' THEN 'INFO' WHEN 'D' THEN 'DEBUG' WHEN '60' THEN 'FATAL' WHEN '50' THEN 'ERROR' WHEN '40' THEN 'WARN' WHEN '30' THEN 'INFO' WHEN '20' THEN 'DEBUG' ELSE '' END"
_W = "(?i:" + "|".join(w for words in logentries.LEVEL_WORDS.values() for w in words) + ")"
#: pattern with groups named in the second place, and the time as SQL over g and path
_FORMS = [
    (rf"^(\d{{4}}-\d\d-\d\dT\S+)\s+({_W})\s+(?:\[([^\]]*)\])?", "tlc",
     r"left(g.t, 19)::TIMESTAMP - to_minutes(CASE WHEN regexp_matches(g.t, '[+-]\d\d:\d\d$') THEN (g.t[-6:-6] || '1')::INT * (g.t[-5:-4]::INT * 60 + right(g.t, 2)::INT) ELSE 0 END)"),
    (rf"^(\d{{4}}-\d\d-\d\d [\d:]+),\d+ - (\S+) - ({_W}) - ", "tcl", "left(g.t, 19)::TIMESTAMP"),
    (rf"^(\d\d\.\d\d\.\d{{4}} [\d:]+) (\S+) ({_W}) ", "tcl", "strptime(g.t, '%d.%m.%Y %H:%M:%S')"),
    (rf"^\[(\d\d/\w+/\d{{4}}:[\d:]+ [+-]\d{{4}})\] ({_W}) ([^\s:]+): ", "tlc",
     "strptime(g.t[:20], '%d/%b/%Y:%H:%M:%S') - to_minutes((g.t[22:22] || '1')::INT * (g.t[23:24]::INT * 60 + g.t[25:26]::INT))"),
    (rf"^([A-Z][a-z]{{2}} [ \d]\d [\d:]+) \S+ ([^\s\[:]+)\[\d+\]: (?:({_W}): )?", "tcl", r"strptime(regexp_extract(path, '/(\d{4})/', 1) || ' ' || g.t, '%Y %b %d %H:%M:%S')"),
    (r"^([FEWID])(\d{4} [\d:]+)\.\d+ \d+ (\S+)\.\w+:\d+\]", "ltc", r"strptime(regexp_extract(path, '/(\d{4})/', 1) || g.t, '%Y%m%d %H:%M:%S')"),
    (rf"^({_W})\s*\| (\d{{4}}-\d\d-\d\d [\d:]+) \| (\S+) \| ", "ltc", "left(g.t, 19)::TIMESTAMP"),
    (r"^(\d{10})\.\d+ ([FEWID])/([^\s(]+)\(\d+\): ", "tlc", "make_timestamp(g.t::BIGINT * 1000000)"),
    (r"^ts=(\S+) lvl=(\S+) comp=(\S+) ", "tlc", "left(g.t, 19)::TIMESTAMP"),
    (r'^level=(\S+) component=(\S+) time="([^"]*)"', "lct", "left(g.t, 19)::TIMESTAMP"),
    (r'^\{"ts":"([^"]*)","level":"([^"]*)","component":"([^"]*)"', "tlc", "left(g.t, 19)::TIMESTAMP"),
    (r'^\{"level":(\d+),"time":(\d{10})\d{3},"pid":\d+,"name":"([^"]*)"', "ltc", "make_timestamp(g.t::BIGINT * 1000000)"),
    (r'^\{"message": ".*", "severity": "([^"]*)", "logger": "([^"]*)", "timestamp": "([^"]*)"', "lct", "left(g.t, 19)::TIMESTAMP"),
]
_PAIR = r"regexp_extract(line, '(?:^|\s)msg=(\"(?:[^\"\\]|\\.)*\"|[^\s\"]+)', 1)"


def _message(p: str) -> str:
    """What a header says behind its fields; a key in JSON lines and lines of pairs."""
    if p.startswith(r"^\{"):
        return "coalesce(line->>'$.msg', line->>'$.message', line->>'$.text', '')"
    return f"regexp_replace({_PAIR}, '^\"|\"$', '', 'g')" if re.match(r"\^\w+=", p) else f"ltrim(regexp_replace(line, '{p}', ''))"


_HEADS = " UNION ALL ".join(
    f"SELECT path, line_no, {_message(p)} AS m, strftime({t}, '%Y-%m-%d %H:%M:%S') AS logged_at, {_LEVELS.format('g.l')} AS level, g.c AS component FROM (SELECT path, line_no, line, regexp_extract(line, '{p}', [{', '.join(repr(x) for x in order)}]) AS g FROM l WHERE regexp_matches(line, '{p}'))"
    for p, order, t in _FORMS
)
_ENTRIES = f"""
WITH l AS MATERIALIZED (SELECT DISTINCT path, line_no, regexp_replace(regexp_replace(coalesce(line, ''), '^\\x{{FEFF}}|\\x1b\\[[0-9;]*m', '', 'g'), '\\r+$', '') AS line FROM log_lines), h AS MATERIALIZED ({_HEADS}),
s AS MATERIALIZED (SELECT l.path, l.line_no AS n, max(h.line_no) OVER (PARTITION BY l.path ORDER BY l.line_no ROWS UNBOUNDED PRECEDING) AS start_no FROM l LEFT JOIN h ON l.path = h.path AND l.line_no = h.line_no)
"""
ORACLES |= {
    "p4_messages": f"""{_ENTRIES}, j AS (SELECT h.path, h.line_no, string_agg(CASE WHEN s.n = h.line_no THEN h.m ELSE l.line END, chr(10) ORDER BY s.n) AS msg
        FROM h JOIN s ON s.path = h.path AND s.start_no = h.line_no JOIN l ON l.path = s.path AND l.line_no = s.n GROUP BY h.path, h.line_no)
        SELECT path, line_no, split_part(msg, chr(10), 1) AS first_line, length(msg) AS n_chars, md5(msg) AS digest FROM j""",
    "p4_found": f"{_ENTRIES} SELECT h.path, h.line_no, max(n) AS end_line_no, any_value(logged_at) AS logged_at, any_value(level) AS level, any_value(component) AS component FROM h JOIN s ON s.path = h.path AND s.start_no = h.line_no GROUP BY h.path, h.line_no",
    "p4_scanned": f"""{_ENTRIES}, f AS (SELECT path, line_no, max(level) AS guessed_level FROM log_entries WHERE path IS NOT NULL AND line_no IS NOT NULL GROUP BY path, line_no)
        SELECT f.path, f.line_no, guessed_level, h.line_no AS entry_line_no, logged_at, level, component FROM f JOIN s ON s.path = f.path AND s.n = f.line_no JOIN h ON h.path = f.path AND h.line_no = s.start_no""",
}
