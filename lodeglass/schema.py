"""Schemas of the records that tables of this engine hold."""

from __future__ import annotations

def _nested(schema: str) -> str:
    """Fields of a struct in the notation of nested types."""
    return ", ".join(": ".join(f.split(" ", 1)) for f in schema.split(", "))


FILE_RECORD = "path string, hash string, summary string, language string, line_count bigint, token_estimate bigint, last_read_at timestamp_ntz"
FILE_CHUNK = "path string, chunk_no bigint, content string, start_line bigint, end_line bigint, relevance_score double, chunk_type string, identifier string"
SYMBOL = "path string, language string, name string, kind string, line int, end_line int, signature string, container string"
SYMBOL_FILE = "file_path string, root_path string, hash string, language string, symbol_count bigint, indexed_at timestamp_ntz, run_id bigint"
SESSION = "session_id string, started_at timestamp_ntz, last_active_at timestamp_ntz, total_tokens_used bigint"
SESSION_FILE = "session_id string, path string, hash string, read_at timestamp_ntz, tokens bigint"
SNAPSHOT = "snapshot_id string, session_id string, label string, summary string, token_count bigint, files array<string>, created_at timestamp_ntz"
TASK = "id string, description string, status string, outcome string, blocked_by string"
OBSERVATION = "type string, content string"
CHECKPOINT = (
    f"id string, title string, project_path string, created_at timestamp_ntz, updated_at timestamp_ntz, tasks array<struct<{_nested(TASK)}>>, decisions array<string>, "
    f"observations array<struct<{_nested(OBSERVATION)}>>, files_changed array<string>, notes string"
)
LOG_LINE = "path string, line_no bigint, line string"
LOG_ENTRY = "path string, line_no bigint, level string, message string, context_lines array<string>, occurrences bigint, first_seen timestamp_ntz, last_seen timestamp_ntz"
PROJECT_MAP = "root_path string, path string, language string, line_count bigint, token_estimate bigint, description string"
SEARCH_MATCH = "path string, line_no bigint, line string, context array<string>"
BUDGET_ITEM = "label string, tokens bigint, priority int, advice string, reason string"

#: Tables with their keys, for `lodeglass.sources.store.KeyedTable`.
TABLES = {
    "file_cache": (["path"], FILE_RECORD),
    "sessions": (["session_id"], SESSION),
    "session_files": (["session_id", "path"], SESSION_FILE),
    "snapshots": (["snapshot_id"], SNAPSHOT),
    "tasks": (["id"], CHECKPOINT),
    "symbols": (["path", "name", "line"], SYMBOL),
    "symbol_files": (["file_path"], SYMBOL_FILE),
}


def open_table(spark, warehouse: str, name: str):
    """The keyed table of that name below a warehouse folder."""
    from lodeglass.sources.store import KeyedTable

    key, schema = TABLES[name]
    return KeyedTable(spark, f"{warehouse.rstrip('/')}/{name}", key, schema)
