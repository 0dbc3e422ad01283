"""Queries on source trees and keyed tables: both are first written into the shared folder, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass import config
from lodeglass.plans import sqltext as q
from lodeglass.schema import open_table
from lodeglass.session import ensure_checkpoint_dir, table
from lodeglass.sources import files

#: A small tree that has what the scans' rules tell apart: (path, size); a file of no given size holds its own path.
TREE: list[tuple[str, int]] = [
    ("README.md", 0), ("index.ts", 0), ("src/app.ts", 0), ("src/deep/er/still/more/six.py", 0), ("a/b/c/d/e/f/g/h/nine.go", 0), ("a/b/c/d/e/f/g/h/i/ten.rs", 0), ("a/b/c/d/e/f/g/h/i/j/k/twelve.rb", 0),
    ("node_modules/x/index.js", 0), ("src/vendor/y.ts", 0), ("build/out.js", 0), (".github/ci.yml", 0), (".claude/notes.md", 0), (".config/z.ts", 0), (".hidden.ts", 0), ("src/.secret/k.ts", 0), ("src/.env", 0),
    ("package-lock.json", 0), ("src/yarn.lock", 0), ("src/data.csv", 0), ("src/Upper.TS", 0), ("src/two_mib.ts", 2 * 1024 * 1024), ("src/over_two_mib.ts", 2 * 1024 * 1024 + 1), ("src/five_mib.py", 5 * 1024 * 1024),
]
RULES = {"search": files.SEARCH_SCAN, "map": files.MAP_SCAN, "symbols": files.SYMBOL_SCAN, "graph": files.GRAPH_SCAN}


def _written_tree(spark: SparkSession) -> str:
    root = f"{ensure_checkpoint_dir(spark)}/tree-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, size in TREE:
        out = system.create(path(f"{root}/{name}"))
        out.write(bytearray(b"x" * size if size else name.encode()))
        out.close()
    return root


def scan_walks(spark: SparkSession, d: str) -> DataFrame:
    """Which files each kind of scan takes of a tree, with size and checksum of what it reads."""
    root, found = _written_tree(spark), None
    for name, rules in RULES.items():
        rows = files.scan_tree(spark, root, rules).select(F.lit(name).alias("rule"), "path", "size", F.md5("content").alias("digest"))
        found = rows if found is None else found.unionByName(rows)
    return found


def store_sessions(spark: SparkSession, d: str) -> DataFrame:
    """A keyed table of sessions after two upserts, a deletion by key and one by condition, and after it was compacted."""
    sessions = open_table(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}", "sessions")
    reads = table(spark, d, "events").withColumn("late", F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    halves = reads.groupBy(F.col("user_id").cast("string").alias("session_id"), "late").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_active_at"), F.sum(F.floor("value").cast("bigint")).alias("total_tokens_used")
    )
    sessions.upsert(halves.where("NOT late"))
    sessions.upsert(halves.where("late"))
    sessions.delete(halves.where("session_id LIKE '%7'"))
    sessions.delete_where(F.col("last_active_at") < F.lit("2024-01-20").cast("timestamp_ntz"))
    sessions.compact()
    return sessions.read()


def _sql() -> dict[str, str]:
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    values = ", ".join(f"('{p}', {n})" for p, n in TREE)
    bars = f"starts_with(x, '.') OR x IN ({quoted(config.IGNORED_DIRECTORIES)})"
    clean = lambda xs: f"NOT list_bool_or(list_transform({xs}, lambda x: {bars}))"
    rest, top = f"(len(p) = 1 OR {clean('p[2:]')})", "list_transform(p[1:1], lambda x: " + bars + ")[1]"
    named = f"p[-1] NOT IN ({quoted(config.IGNORED_FILES)})"
    lang = q.language("path", "")
    tests = {
        "search": f"depth <= 8 AND {clean('p')} AND {named} AND size < 5242880",
        "map": f"depth <= 10 AND {rest} AND (NOT {top} OR p[1] IN ('.github', '.claude')) AND {named} AND size <= 10485760",
        "symbols": f"depth <= 10 AND {rest} AND p[1] NOT IN ({quoted(config.IGNORED_DIRECTORIES)}) AND {named} AND size <= 2097152 AND {lang} IN ({quoted(config.CODE_LANGUAGES)})",
        "graph": f"depth <= 5 AND {clean('p')} AND {lang} <> ''",
    }
    taken = " UNION ALL ".join(f"SELECT '{k}' AS rule, path, size, digest FROM t WHERE {test}" for k, test in tests.items())
    return {
        "scan_walks": f"""WITH v(path, n) AS (VALUES {values}), t AS (SELECT path, CASE WHEN n = 0 THEN length(path) ELSE n END::BIGINT AS size, CASE WHEN n = 0 THEN md5(path) ELSE md5(repeat('x', n)) END AS digest,
            string_split(path, '/') AS p, len(string_split(path, '/')) - 1 AS depth FROM v) {taken}""",
        "store_sessions": """WITH h AS (SELECT user_id::VARCHAR AS session_id, ts >= TIMESTAMP '2024-01-15' AS late, min(ts) AS started_at, max(ts) AS last_active_at, sum(floor(value)::BIGINT)::BIGINT AS total_tokens_used FROM events GROUP BY ALL),
            k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY late DESC) = 1)
            SELECT session_id, started_at, last_active_at, total_tokens_used FROM k WHERE session_id NOT LIKE '%7' AND last_active_at >= TIMESTAMP '2024-01-20'""",
    }


QUERIES = {"scan_walks": scan_walks, "store_sessions": store_sessions}
ORACLES = _sql()
