"""Roll-ups of task lists and merging of checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeglass.functions.text import js_round, text_tokens
from lodeglass.operators.search import top_per_group
from lodeglass.operators.sessions import session_files

# States of a task.
STATUSES = ["pending", "in_progress", "done", "blocked", "skipped"]


def progress(tasks: DataFrame, groups: list[str], status: str = "status") -> DataFrame:
    """(groups, total, a count per status, percent done)"""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in STATUSES]
    sums = tasks.groupBy(*groups).agg(F.count(F.lit(1)).alias("total"), *counts)
    return sums.withColumn("percent", js_round(F.col("done") / F.greatest("total", F.lit(1)) * 100))


def latest_per(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Each key's latest row, the one with the greatest `tie` among equals."""
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(tie).desc())
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def most_recent(rows: DataFrame, at: str, tie: str, limit: int | None = 10) -> DataFrame:
    """The `limit` latest rows, latest first; None for all. The greatest `tie` comes first among equals."""
    ordered = rows.orderBy(F.col(at).desc(), F.col(tie).desc())
    return ordered if limit is None else ordered.limit(limit)


def snapshots(reads: DataFrame, owner: str, at: str, item: str, tokens: str, label: str = "checkpoint") -> DataFrame:
    """A snapshot of each owner's latest session: owner, label, summary, token_count, files, created_at.

    The summary counts files and tokens; token_count is what the summary costs.
    """
    files = session_files(reads, owner, at, item, tokens)
    each = files.groupBy(owner).agg(F.array_sort(F.collect_set(item)).alias("files"), F.coalesce(F.sum(tokens), F.lit(0)).alias("_n"), F.max(at).alias("created_at"))
    summary = F.concat(F.size("files").cast("string"), F.lit(" files, "), F.col("_n").cast("string"), F.lit(" tokens"))
    made = each.withColumn("summary", summary)
    return made.select(owner, F.lit(label).alias("label"), "summary", text_tokens("summary").alias("token_count"), "files", "created_at")


def set_union(old: Column, new: Column) -> Column:
    """Both lists' entries, each once, in order of first appearance."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(old, empty), F.coalesce(new, empty)))


def appended(old: Column, new: Column) -> Column:
    return F.concat(F.coalesce(old, F.array()), F.coalesce(new, F.array()))


def merged_checkpoints(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, decisions, observations, files_changed, notes): checkpoints after an update; keys of either side stay.

    Decisions and files are sets, observations a list that grows, and notes
    are replaced where the update has some.
    """
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key), set_union(F.col("a.decisions"), F.col("b.decisions")).alias("decisions"),
        appended(F.col("a.observations"), F.col("b.observations")).alias("observations"),
        set_union(F.col("a.files_changed"), F.col("b.files_changed")).alias("files_changed"), F.coalesce("b.notes", "a.notes").alias("notes"),
    )


def first_per_type(observations: DataFrame, groups: list[str], order: list[Column], limit: int = 3, kind: str = "type") -> DataFrame:
    return top_per_group(observations, [*groups, kind], order, limit)
