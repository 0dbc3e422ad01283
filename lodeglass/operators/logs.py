"""Logs condensed: trouble lines, alike ones counted once, with context and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass import config
from lodeglass.functions.logs import dedupe_key, line_level
from lodeglass.functions.text import trimmed
from lodeglass.operators.search import top_per_group
from lodeglass.session import spread


def trouble_lines(lines: DataFrame, file: str = "path") -> DataFrame:
    """(file, line_no, level, message): lines at FATAL, ERROR or WARN, trimmed; a line delivered twice counts once."""
    found = spread(lines.select(file, "line_no", "line")).select(file, "line_no", line_level(F.col("line")).alias("level"), trimmed("line").alias("message"))
    return found.where("level IS NOT NULL").distinct()


def deduplicated(found: DataFrame, file: str = "path", key_chars: int | None = config.DEDUPE_CHARS) -> DataFrame:
    """(file, line_no, level, message, occurrences, last_line_no): the first of each group of alike messages.

    Aggregates before it shuffles, so that one message that fills a third of
    all lines costs a row per task.
    """
    first = F.min(F.struct("line_no", "level", "message")).alias("first")
    groups = found.groupBy(file, dedupe_key(F.col("message"), key_chars).alias("_key")).agg(first, F.count(F.lit(1)).alias("occurrences"), F.max("line_no").alias("last_line_no"))
    return groups.select(file, "first.line_no", "first.level", "first.message", "occurrences", "last_line_no")


def with_context(entries: DataFrame, lines: DataFrame, size: int = config.LOG_CONTEXT, file: str = "path") -> DataFrame:
    """Entries with `context`: the trimmed, non-blank lines around each, in order."""
    wanted = entries.select(file, F.col("line_no").alias("_entry"), F.explode(F.sequence(F.col("line_no") - size, F.col("line_no") + size)).alias("line_no"))
    wanted = wanted.where("line_no <> _entry")
    # only lines that an entry wants are told apart by their text
    asked = lines.select(file, "line_no", "line").join(wanted.select(file, "line_no").distinct(), [file, "line_no"], "left_semi")
    text = asked.select(file, "line_no", trimmed("line").alias("_line")).distinct().where("_line <> ''")
    near = wanted.join(text, [file, "line_no"]).groupBy(file, F.col("_entry").alias("line_no")).agg(F.sort_array(F.collect_list(F.struct("line_no", "_line"))).alias("_c"))
    return entries.join(near, [file, "line_no"], "left").withColumn("context", F.coalesce(F.col("_c._line"), F.array().cast("array<string>"))).drop("_c")


def condensed(
    lines: DataFrame, file: str = "path", entries: int | None = config.LOG_ENTRIES, per_level: int | None = config.LOG_LEVEL_ENTRIES,
    key_chars: int | None = config.DEDUPE_CHARS,
) -> DataFrame:
    """The report of each file: its first `entries` groups, of which at most `per_level` of each level; None for all of them."""
    groups = deduplicated(trouble_lines(lines, file), file, key_chars)
    first = groups if entries is None else top_per_group(groups, [file], [F.col("line_no")], entries)
    return first if per_level is None else top_per_group(first, [file, "level"], [F.col("line_no")], per_level)


def left_out(groups: DataFrame, file: str = "path", entries: int = config.LOG_ENTRIES, per_level: int = config.LOG_LEVEL_ENTRIES) -> DataFrame:
    """(file, groups, shown, dropped, dropped_lines): what a report of so many entries leaves out of a file's groups.

    By counts alone: a group is left out if `entries` groups of the file or
    `per_level` of its level, among the first `entries`, come before it.
    """
    shown = top_per_group(top_per_group(groups, [file], [F.col("line_no")], entries), [file, "level"], [F.col("line_no")], per_level)
    sums = lambda df, p: df.groupBy(file).agg(F.count(F.lit(1)).alias(f"{p}groups"), F.sum("occurrences").alias(f"{p}lines"))
    both = sums(groups, "_all_").join(sums(shown, "_shown_"), file)
    return both.select(file, F.col("_all_groups").alias("groups"), F.col("_shown_groups").alias("shown"), (F.col("_all_groups") - F.col("_shown_groups")).alias("dropped"), (F.col("_all_lines") - F.col("_shown_lines")).alias("dropped_lines"))
