"""Regular-expression search over all lines, with context."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeglass import config
from lodeglass.functions.text import context_around, extension, lines_of, trimmed


def checked_pattern(pattern: str, case_sensitive: bool = False) -> str:
    """The pattern for ``rlike``; ValueError if the engine that will run it, Java's, doesn't take it."""
    jvm = SparkSession.active()._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise ValueError(f"invalid pattern: {pattern}") from e
    return pattern if case_sensitive else f"(?i){pattern}"


def matching_lines(
    files: DataFrame, pattern: str, key: str = "path", content: str = "content", extensions: list[str] | None = None,
    case_sensitive: bool = False, context_lines: int = config.SEARCH_CONTEXT,
) -> DataFrame:
    """(key, line_no, line, context): every line that holds the pattern, trimmed.

    Only matches leave the scan: lines are tested within the row, so that a
    text without match gives no rows at all.
    """
    test = checked_pattern(pattern, case_sensitive)
    kept = files.where(F.col(content).isNotNull())
    if extensions is not None:
        kept = kept.where(extension(key).isin(extensions))
    lines = lines_of(content)
    hits = kept.where(F.col(content).rlike(f"(?m){test}")) if _single_line(pattern) else kept
    # the context is taken before the matches part, so that no match carries a copy of all lines
    split = hits.select(key, lines.alias("_lines"))
    numbered = F.transform("_lines", lambda line, k: F.struct((k + 1).alias("n"), line.alias("l")))
    found = F.filter(numbered, lambda x: x["l"].rlike(test))
    around = lambda n: context_around(F.col("_lines"), n, context_lines) if context_lines else F.array().cast("array<string>")
    told = F.transform(found, lambda x: F.struct(x["n"].cast("bigint").alias("line_no"), trimmed(x["l"]).alias("line"), around(x["n"]).alias("context")))
    return split.select(key, F.inline(told))


def _single_line(pattern: str) -> bool:
    """Whether testing the whole text first can't miss a line: no anchors to the text's ends, no look-around, nothing that a line feed could stand for."""
    return not re.search(r"\\[AzZGQE]|\(\?(?!:)|\^|\$|\[\^", pattern)


def first_matches(matches: DataFrame, key: str = "path", limit: int = config.SEARCH_RESULTS) -> DataFrame:
    """The first `limit` matches by key and line: the report's cap."""
    return matches.orderBy(key, "line_no").limit(limit)


def matches_by_file(matches: DataFrame, key: str = "path") -> DataFrame:
    return matches.groupBy(key).agg(F.count(F.lit(1)).alias("matches"))


def match_totals(matches: DataFrame, key: str = "path") -> DataFrame:
    return matches.agg(F.count(F.lit(1)).alias("matches"), F.count_distinct(key).alias("files"))


def top_per_group(rows: DataFrame, groups: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first rows of each group. Spark keeps only `limit` rows of a group per task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
