"""Sessions of file reads: splitting by idle time, totals, latest reads, freshness and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeglass import config

_DAY = 86_400_000_000


def _micros(c: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone, the latter as UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(`{c}` AS TIMESTAMP_NTZ))")


def day_sessions(reads: DataFrame, owner: str, at: str, gap_hours: int = config.SESSION_GAP_HOURS) -> DataFrame:
    """(owner, stretch, session_no): which session each stretch of an owner's time belongs to.

    A new session begins after an idle time of `gap_hours` or more. Reads in
    one stretch of that length can't be that far apart; so they are brought
    down to a row per owner and stretch before any window sees them, and one
    owner with a third of all reads is no hot spot.
    """
    gap = gap_hours * 3_600_000_000
    each = reads.where(F.col(owner).isNotNull() & F.col(at).isNotNull()).select(owner, _micros(at).alias("_at"))
    days = each.groupBy(owner, F.floor(F.col("_at") / gap).alias("stretch")).agg(F.min("_at").alias("first"), F.max("_at").alias("last"))
    along = Window.partitionBy(owner).orderBy("stretch")
    before = F.lag("last").over(along)
    begins = F.when(before.isNull() | (F.col("first") - before >= gap), 1).otherwise(0)
    return days.withColumn("_b", begins).select(owner, "stretch", F.sum("_b").over(along).alias("session_no"))


def with_sessions(reads: DataFrame, owner: str, at: str, gap_hours: int = config.SESSION_GAP_HOURS) -> DataFrame:
    """`reads` with session_no, counted from 1 for each owner; rows without owner or time are left out."""
    numbered = day_sessions(reads, owner, at, gap_hours)
    marked = reads.withColumn("stretch", F.floor(_micros(at) / (gap_hours * 3_600_000_000)))
    return marked.join(numbered, [owner, "stretch"]).drop("stretch")


def session_totals(reads: DataFrame, owner: str, at: str, item: str, tokens: str, gap_hours: int = config.SESSION_GAP_HOURS) -> DataFrame:
    """(owner, session_no, started_at, last_active_at, reads, items, tokens): every read counts its tokens again."""
    return with_sessions(reads, owner, at, gap_hours).groupBy(owner, "session_no").agg(
        F.min(at).alias("started_at"), F.max(at).alias("last_active_at"), F.count(F.lit(1)).alias("reads"), F.count_distinct(item).alias("items"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"),
    )


def latest_reads(reads: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """Each key's row with the latest time, the greatest other columns among equals."""
    latest = reads.groupBy(*keys).agg(F.max(F.struct(at, *columns)).alias("_r"))
    return latest.select(*keys, "_r.*")


def expired(rows: DataFrame, at: str, as_of: Column, hours: int) -> DataFrame:
    return rows.where(F.col(at) < as_of - F.make_dt_interval(hours=F.lit(hours)))


def purge(parents: DataFrame, children: DataFrame, key: list[str], at: str, as_of: Column, hours: int = config.SESSION_GAP_HOURS) -> tuple[DataFrame, DataFrame]:
    """(parents, children) without parents idle for more than `hours`, and without the children of those."""
    gone = expired(parents, at, as_of, hours).select(*key)
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def freshness(files: DataFrame, cache: DataFrame, key: str = "path") -> DataFrame:
    """(key, status): ``unread`` if the cache doesn't know a file, else ``changed`` or ``fresh`` by its hash."""
    known = cache.select(key, F.lower("hash").alias("_known"), F.lit(True).alias("_there"))
    joined = files.select(key, F.lower("hash").alias("_now")).join(known, key, "left")
    same = F.col("_now").eqNullSafe(F.col("_known"))
    return joined.select(key, F.when(F.col("_there").isNull(), "unread").when(same, "fresh").otherwise("changed").alias("status"))


def read_plan(status: Column, tokens: Column, budget: int = config.SNIPPET_BUDGET) -> Column:
    """What a read of a file gives: ``summary`` if it is fresh and small, ``whole`` if it is small, else ``chunks``."""
    return F.when(tokens > budget, "chunks").when(status == "fresh", "summary").otherwise("whole")


def recalled(now: DataFrame, cache: DataFrame, key: str = "path") -> DataFrame:
    """(key, status, summary, tokens): what is known of files read before; summary and tokens of fresh ones only.

    `cache` has key, hash, summary and token_estimate, one row per key. Files
    that the cache doesn't know are ``unread``.
    """
    status = freshness(now, cache, key)
    known = cache.select(key, "summary", F.col("token_estimate").alias("tokens"))
    fresh = F.col("status") == "fresh"
    return status.join(known, key, "left").select(key, "status", F.when(fresh, F.col("summary")).alias("summary"), F.when(fresh, F.col("tokens")).alias("tokens"))


def session_files(reads: DataFrame, owner: str, at: str, item: str, tokens: str, gap_hours: int = config.SESSION_GAP_HOURS) -> DataFrame:
    """(owner, item, read_at, tokens): what each owner has read in the latest session, at its last read."""
    marked = with_sessions(reads, owner, at, gap_hours)
    last = marked.groupBy(owner).agg(F.max("session_no").alias("session_no"))
    return latest_reads(marked.join(last, [owner, "session_no"]), [owner, item], at, [tokens])
