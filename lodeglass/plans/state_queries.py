"""Queries on sessions, freshness, budgets, tasks and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass import config
from lodeglass.functions.text import code_tokens, minutes_ago
from lodeglass.operators import budget, incremental, sessions, tasks
from lodeglass.session import table

AS_OF = "2024-01-28 00:00:00"


def _reads(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.select(F.col("user_id").alias("owner"), F.col("event_type").alias("item"), F.col("ts").alias("read_at"), F.floor("value").cast("bigint").alias("tokens"), "event_id")


def sessionize_24h(spark: SparkSession, d: str) -> DataFrame:
    return sessions.with_sessions(_reads(spark, d), "owner", "read_at").select("event_id", "owner", "session_no")


def session_totals(spark: SparkSession, d: str) -> DataFrame:
    return sessions.session_totals(_reads(spark, d), "owner", "read_at", "item", "tokens")


def session_latest_read(spark: SparkSession, d: str) -> DataFrame:
    return sessions.latest_reads(_reads(spark, d), ["owner", "item"], "read_at", ["tokens"])


def session_files(spark: SparkSession, d: str) -> DataFrame:
    return sessions.session_files(_reads(spark, d), "owner", "read_at", "item", "tokens")


def cache_latest(spark: SparkSession, d: str) -> DataFrame:
    return sessions.latest_reads(table(spark, d, "file_cache"), ["path"], "last_read_at", ["hash", "line_count"])


def purge_expired(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each owner's reads after owners idle for more than a day have gone with theirs."""
    reads = _reads(spark, d)
    owners = reads.groupBy("owner").agg(F.max("read_at").alias("last_active_at"))
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    left, rows = sessions.purge(owners, reads, ["owner"], "last_active_at", now)
    return rows.groupBy("owner").agg(F.count(F.lit(1)).alias("reads")).join(left.select("owner", "last_active_at"), "owner")


def cache_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Cached files that nobody has read for seven days, and for how many minutes."""
    now = F.lit("2025-02-20 00:00:00").cast("timestamp_ntz")
    latest = cache_latest(spark, d)
    return sessions.expired(latest, "last_read_at", now, config.CACHE_DAYS * 24).select("path", minutes_ago("last_read_at", now).alias("minutes"))


def freshness_check(spark: SparkSession, d: str) -> DataFrame:
    now = incremental.present_files(table(spark, d, "file_cache"))
    known = incremental.indexed_files(table(spark, d, "symbol_files"), table(spark, d, "index_runs"))
    return sessions.freshness(now, known)


def recall_files(spark: SparkSession, d: str) -> DataFrame:
    """What the first read of each file in a month tells of its present state, and what a further read would give."""
    reads = table(spark, d, "file_cache").where("hash IS NOT NULL")
    now = incremental.present_files(reads)
    early = reads.where(F.col("last_read_at") < F.lit("2025-02-20").cast("timestamp_ntz"))
    cache = early.groupBy("path").agg(F.max(F.struct("last_read_at", F.lower("hash").alias("hash"), "summary", "token_estimate")).alias("_r")).select("path", "_r.*")
    found = sessions.recalled(now, cache)
    return found.withColumn("plan", sessions.read_plan(F.col("status"), F.coalesce("tokens", F.lit(0))))


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """All documents as items of a conversation; those without path have an empty label."""
    docs = table(spark, d, "documents")
    items = docs.select(F.coalesce("path", F.lit("")).alias("label"), (code_tokens("text") * 10).alias("tokens"), F.pmod("doc_id", F.lit(10)).cast("int").alias("priority"))
    return budget.judged_items(items)


def context_budget_totals(spark: SparkSession, d: str) -> DataFrame:
    return budget.budget_totals(_source_items(spark, d), ["source"])


def context_recommendation(spark: SparkSession, d: str) -> DataFrame:
    """What the contexts of sources that are too full could save, with their first three items to remove, largest first."""
    found = budget.recommended(_source_items(spark, d, 40), ["source"], [(-F.col("tokens")).alias("a"), F.col("doc_id").alias("b")])
    return found.withColumn("names", F.array_join("names", ","))


def _source_items(spark: SparkSession, d: str, times: int = 1) -> DataFrame:
    """All documents as items of their sources' contexts; those without source are one context of their own."""
    docs = table(spark, d, "documents")
    items = docs.select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), F.coalesce("path", F.lit("")).alias("label"), (code_tokens("text") * times).alias("tokens"), F.lit(5).alias("priority"))
    return budget.judged_items(items)


def budget_session_merge(spark: SparkSession, d: str) -> DataFrame:
    """Every owner's items of all types at their greatest size, completed by what of the latest sessions none of them names."""
    files = session_files(spark, d).select(F.concat_ws("/", F.col("owner").cast("string"), "item").alias("item"), "tokens")
    items = _reads(spark, d).groupBy("owner", "item").agg(F.max("tokens").alias("tokens"))
    items = items.select(F.concat_ws("/", F.col("owner").cast("string"), "item").alias("label"), "tokens", F.lit(9).alias("priority"))
    return budget.with_session_files(items, files)


def context_watchdog(spark: SparkSession, d: str) -> DataFrame:
    totals = _reads(spark, d).groupBy("owner").agg((F.sum("tokens") * 40).alias("tokens"))
    return budget.watched(totals, extra=1_000)


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "done").when(kind == "view", "pending").when(kind == "click", "in_progress").when(kind == "error", "blocked").otherwise("skipped")
    return table(spark, d, "events").select(F.col("user_id").alias("project"), "event_id", status.alias("status"), "ts", "event_type")


def task_progress(spark: SparkSession, d: str) -> DataFrame:
    return tasks.progress(_tasks(spark, d), ["project"])


def task_checkpoint_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each project's first half of a month merged with its second."""
    halves = _tasks(spark, d).withColumn("late", F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "event_type", "status")))
    each = halves.groupBy("project", "late").agg(ordered.alias("es")).select(
        "project", "late", F.array_distinct("es.event_type").alias("decisions"), F.col("es.status").alias("observations"),
        F.array_distinct("es.status").alias("files_changed"), F.when(F.size("es") > 30, F.element_at("es", -1)["event_type"]).alias("notes"),
    )
    merged = tasks.merged_checkpoints(each.where("NOT late"), each.where("late"), "project")
    return merged.select("project", *[F.array_join(c, ",").alias(c) for c in ("decisions", "observations", "files_changed")], "notes")


def observation_groups(spark: SparkSession, d: str) -> DataFrame:
    return tasks.first_per_type(_tasks(spark, d), ["project"], [F.col("event_id")], kind="event_type").select("project", "event_type", "event_id")


def session_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot of every owner's latest session."""
    made = tasks.snapshots(_reads(spark, d), "owner", "read_at", "item", "tokens")
    return made.withColumn("files", F.array_join("files", ","))


def snapshot_list(spark: SparkSession, d: str) -> DataFrame:
    """The ten latest of these snapshots."""
    return tasks.most_recent(session_snapshots(spark, d), "created_at", "owner")


def startup_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """What one cleaning at the start leaves: reads of owners who were active within a day, and cached files read within seven."""
    left = purge_expired(spark, d).agg(F.lit("sessions").alias("store"), F.count(F.lit(1)).alias("kept"))
    now = F.lit("2025-02-20 00:00:00").cast("timestamp_ntz")
    latest = cache_latest(spark, d)
    fresh = latest.where(F.col("last_read_at") >= now - F.make_dt_interval(days=F.lit(config.CACHE_DAYS)))
    return left.unionByName(fresh.agg(F.lit("cache").alias("store"), F.count(F.lit(1)).alias("kept")))


def snapshots_latest(spark: SparkSession, d: str) -> DataFrame:
    return tasks.latest_per(_tasks(spark, d), ["project"], "ts", "event_id").select("project", "event_id", "status")


_R = "r AS (SELECT user_id AS owner, event_type AS item, ts AS read_at, floor(value)::BIGINT AS tokens, event_id FROM events)"
_S = """m AS (SELECT *, CASE WHEN lag(read_at) OVER w IS NULL OR read_at - lag(read_at) OVER w >= INTERVAL 24 HOURS THEN 1 ELSE 0 END AS b FROM {src} WINDOW w AS (PARTITION BY owner ORDER BY read_at, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY owner ORDER BY read_at, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM m)"""
_ALL = f"WITH {_R}, {_S.format(src='r')}"
_FILES = f"""{_R}, {_S.format(src="r")}, sf AS (SELECT owner, item, max(read_at) AS read_at, arg_max(tokens, (read_at, tokens)) AS tokens
 FROM (SELECT * FROM s QUALIFY session_no = max(session_no) OVER (PARTITION BY owner)) GROUP BY owner, item)"""
_T = """t AS (SELECT user_id AS project, event_id, ts, event_type, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'in_progress' WHEN 'error' THEN 'blocked' ELSE 'skipped' END AS status FROM events)"""
_KT = "CASE WHEN tokens >= 1000 THEN printf('%.1fk', floor(tokens / 100.0 + 0.5) / 10) ELSE tokens::VARCHAR END"
_ADVICE = "CASE WHEN coalesce(priority, 5) >= 8 THEN 'keep' WHEN tokens > 10000 OR lower(label) LIKE '%log%' THEN 'consider-removing' WHEN lower(label) LIKE '%lock%' THEN 'remove' ELSE 'keep' END"
_LATEST = "c AS (SELECT path, max(last_read_at) AS last_read_at, arg_max({'hash': hash, 'line_count': line_count}, (last_read_at, coalesce(hash, ''), coalesce(line_count, -1))) AS v FROM file_cache GROUP BY path)"
_SNAP = """sn AS (SELECT owner, 'checkpoint' AS label, summary, ceil(length(summary) / 4.0)::BIGINT AS token_count, files, created_at FROM (
 SELECT owner, count(DISTINCT item) || ' files, ' || coalesce(sum(tokens), 0)::BIGINT || ' tokens' AS summary, string_agg(DISTINCT item, ',' ORDER BY item) AS files, max(read_at) AS created_at FROM sf GROUP BY owner))"""
_SUMS = ", ".join(f"sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END)::BIGINT AS {s}" for s in tasks.STATUSES)


def _oracles() -> dict[str, str]:
    from lodeglass.plans import pipeline
    from lodeglass.plans import sqltext as q

    items = f"SELECT coalesce(path, '') AS label, {q.code_tokens('text')} * 10 AS tokens, (doc_id % 10)::INT AS priority FROM documents"
    reason = f"""CASE WHEN tokens > 20000 THEN 'Very large (' || {_KT} || ' tokens)' WHEN tokens > 10000 THEN 'Large (' || {_KT} || ' tokens)'
        WHEN lower(label) LIKE '%log%' THEN 'log' WHEN lower(label) LIKE '%lock%' THEN 'lock' ELSE {_KT} || ' tokens' END"""
    source = f"SELECT doc_id, coalesce(lower(trim(source)), '') AS source, coalesce(path, '') AS label, {q.code_tokens('text')} AS tokens, 5 AS priority FROM documents"
    return {
        "sessionize_24h": f"{_ALL} SELECT event_id, owner, session_no FROM s",
        "session_totals": f"{_ALL} SELECT owner, session_no, min(read_at) AS started_at, max(read_at) AS last_active_at, count(*) AS reads, count(DISTINCT item) AS items, sum(tokens)::BIGINT AS tokens FROM s GROUP BY owner, session_no",
        "session_latest_read": f"WITH {_R} SELECT owner, item, max(read_at) AS read_at, arg_max(tokens, (read_at, tokens)) AS tokens FROM r GROUP BY owner, item",
        "session_files": f"WITH {_FILES} SELECT owner, item, read_at, tokens FROM sf",
        "purge_expired": f"WITH {_R} SELECT owner, count(*) AS reads, max(read_at) AS last_active_at FROM r GROUP BY owner HAVING max(read_at) >= TIMESTAMP '2024-01-29 12:00:00'",
        "cache_expiry": f"WITH {_LATEST} SELECT path, floor(epoch_us(TIMESTAMP '2025-02-20 00:00:00' - last_read_at) / 60e6 + 0.5)::BIGINT AS minutes FROM c WHERE last_read_at < TIMESTAMP '2025-02-13 00:00:00'"
        .replace("epoch_us(TIMESTAMP '2025-02-20 00:00:00' - last_read_at)", "(epoch_us(TIMESTAMP '2025-02-20 00:00:00') - epoch_us(last_read_at))"),
        "freshness_check": f"WITH {pipeline._LISTING} SELECT l.path, CASE WHEN m.path IS NULL THEN 'unread' WHEN m.hash IS NOT DISTINCT FROM l.hash THEN 'fresh' ELSE 'changed' END AS status FROM listing l LEFT JOIN manifest m ON l.path = m.path",
        "recall_files": """
            WITH n AS (SELECT path, arg_max(lower(hash), (last_read_at, lower(hash))) AS hash FROM file_cache WHERE hash IS NOT NULL AND path IS NOT NULL AND last_read_at IS NOT NULL GROUP BY path),
            c AS (SELECT path, lower(hash) AS hash, summary, token_estimate FROM file_cache WHERE hash IS NOT NULL AND last_read_at < TIMESTAMP '2025-02-20'
                  QUALIFY row_number() OVER (PARTITION BY path ORDER BY last_read_at DESC, lower(hash) DESC, summary DESC NULLS LAST, token_estimate DESC NULLS LAST) = 1),
            s AS (SELECT n.path, CASE WHEN c.path IS NULL THEN 'unread' WHEN c.hash = n.hash THEN 'fresh' ELSE 'changed' END AS status, c.summary, c.token_estimate FROM n LEFT JOIN c ON n.path = c.path)
            SELECT path, status, CASE WHEN status = 'fresh' THEN summary END AS summary, CASE WHEN status = 'fresh' THEN token_estimate END AS tokens,
                   CASE WHEN status = 'fresh' AND token_estimate > 2000 THEN 'chunks' WHEN status = 'fresh' THEN 'summary' ELSE 'whole' END AS plan FROM s""",
        "context_budget": f"SELECT label, tokens, priority, {_ADVICE} AS advice, {reason} AS reason FROM ({items})",
        "context_budget_totals": f"""WITH i AS ({source})
            SELECT source, sum(tokens)::BIGINT AS tokens, floor(sum(tokens) / 150000.0 * 100 + 0.5)::BIGINT AS percent, CASE WHEN sum(tokens) >= 150000 THEN 'critical' WHEN sum(tokens) >= 80000 THEN 'warning' ELSE 'ok' END AS status,
                   coalesce(sum(tokens) FILTER (({_ADVICE}) <> 'keep'), 0)::BIGINT AS removable FROM i GROUP BY source""",
        "budget_session_merge": f"""WITH {_FILES}, i AS (SELECT owner || '/' || item AS label, max(tokens) AS tokens, 9 AS priority FROM r GROUP BY owner, item)
            SELECT * FROM i UNION ALL SELECT owner || '/' || item, tokens, 5 FROM sf WHERE owner || '/' || item NOT IN (SELECT label FROM i)""",
        "context_recommendation": f"""WITH i AS (SELECT * REPLACE (tokens * 40 AS tokens) FROM ({source})), j AS (SELECT *, {_ADVICE} AS advice FROM i),
            t AS (SELECT source, sum(tokens)::BIGINT AS tokens, coalesce(sum(tokens) FILTER (advice <> 'keep'), 0)::BIGINT AS removable FROM j GROUP BY source HAVING sum(tokens) >= 80000),
            n AS (SELECT source, string_agg(label, ',' ORDER BY tokens DESC, doc_id) AS names FROM (SELECT * FROM j WHERE advice <> 'keep' QUALIFY row_number() OVER (PARTITION BY source ORDER BY tokens DESC, doc_id) <= 3) GROUP BY source)
            SELECT t.source, CASE WHEN tokens >= 150000 THEN 'critical' ELSE 'warning' END AS status, removable, floor(removable * 100.0 / tokens + 0.5)::BIGINT AS percent, coalesce(names, '') AS names FROM t LEFT JOIN n ON n.source = t.source""",
        "session_snapshots": f"WITH {_FILES}, {_SNAP} SELECT * FROM sn",
        "snapshot_list": f"WITH {_FILES}, {_SNAP} SELECT * FROM sn ORDER BY created_at DESC, owner DESC LIMIT 10",
        "cache_latest": f"WITH {_LATEST} SELECT path, last_read_at, v.hash AS hash, v.line_count AS line_count FROM c",
        "startup_cleanup": f"""WITH {_R}, {_LATEST} SELECT 'sessions' AS store, count(*) AS kept FROM (SELECT owner FROM r GROUP BY owner HAVING max(read_at) >= TIMESTAMP '2024-01-29 12:00:00')
            UNION ALL SELECT 'cache', count(*) FROM c WHERE last_read_at >= TIMESTAMP '2025-02-13 00:00:00'""",
        "context_watchdog": f"""WITH {_R}, o AS (SELECT owner, sum(tokens)::BIGINT * 40 AS tokens FROM r GROUP BY owner)
            SELECT owner, tokens, tokens + 1000 AS used, floor((tokens + 1000) / 180000.0 * 100 + 0.5)::BIGINT AS percent,
                   CASE WHEN (tokens + 1000) / 180000.0 >= 0.95 THEN 'emergency' WHEN (tokens + 1000) / 180000.0 >= 0.85 THEN 'critical' WHEN (tokens + 1000) / 180000.0 >= 0.7 THEN 'warning' ELSE 'safe' END AS level FROM o""",
        "task_progress": f"WITH {_T} SELECT project, count(*) AS total, {_SUMS}, floor(100.0 * sum(CASE WHEN status = 'done' THEN 1 ELSE 0 END) / count(*) + 0.5)::BIGINT AS percent FROM t GROUP BY project",
        "task_checkpoint_merge": f"""WITH {_T}, e AS (SELECT *, ts >= TIMESTAMP '2024-01-15' AS late FROM t),
            fd AS (SELECT project, event_type, min((late, event_id)) AS k FROM e GROUP BY project, event_type), fs AS (SELECT project, status, min((late, event_id)) AS k FROM e GROUP BY project, status),
            n AS (SELECT project, late, CASE WHEN count(*) > 30 THEN arg_max(event_type, event_id) END AS note FROM e GROUP BY project, late)
            SELECT p.project, (SELECT string_agg(event_type, ',' ORDER BY k) FROM fd WHERE fd.project = p.project) AS decisions,
                   (SELECT string_agg(status, ',' ORDER BY late, event_id) FROM e WHERE e.project = p.project) AS observations,
                   (SELECT string_agg(status, ',' ORDER BY k) FROM fs WHERE fs.project = p.project) AS files_changed,
                   coalesce((SELECT note FROM n WHERE n.project = p.project AND late), (SELECT note FROM n WHERE n.project = p.project AND NOT late)) AS notes
            FROM (SELECT DISTINCT project FROM t) p""",
        "observation_groups": f"WITH {_T} SELECT project, event_type, event_id FROM t QUALIFY row_number() OVER (PARTITION BY project, event_type ORDER BY event_id) <= 3",
        "snapshots_latest": f"WITH {_T} SELECT project, event_id, status FROM t QUALIFY row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_id DESC) = 1",
    }


QUERIES = {
    "sessionize_24h": sessionize_24h, "session_totals": session_totals, "session_latest_read": session_latest_read, "session_files": session_files,
    "cache_latest": cache_latest, "purge_expired": purge_expired, "cache_expiry": cache_expiry, "freshness_check": freshness_check, "recall_files": recall_files, "context_budget": context_budget, "context_budget_totals": context_budget_totals,
    "budget_session_merge": budget_session_merge, "context_watchdog": context_watchdog, "task_progress": task_progress, "task_checkpoint_merge": task_checkpoint_merge,
    "context_recommendation": context_recommendation, "session_snapshots": session_snapshots, "snapshot_list": snapshot_list, "startup_cleanup": startup_cleanup,
    "observation_groups": observation_groups, "snapshots_latest": snapshots_latest,
}
ORACLES = _oracles()
