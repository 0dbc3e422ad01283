"""Project maps: files with size estimates, by language and folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.functions.text import describe, directory, language_of, lines_of, lines_tokens


def map_entries(files: DataFrame) -> DataFrame:
    """(root, path, language, line_count, token_estimate, description) of files with content."""
    n = F.size(lines_of("content")).cast("bigint")
    language = language_of("path", "other")
    return files.select("root", "path", language.alias("language"), n.alias("line_count"), lines_tokens(n).alias("token_estimate"), describe("path", language).alias("description"))


def scanned_entries(project_map: DataFrame) -> DataFrame:
    """The same from a table of scans: one row per file, the greatest line count of several scans."""
    each = project_map.where("root_path IS NOT NULL AND path IS NOT NULL").groupBy(F.col("root_path").alias("root"), "path").agg(F.max("line_count").alias("line_count"))
    language = language_of("path", "other")
    return each.select("root", "path", language.alias("language"), "line_count", lines_tokens("line_count").alias("token_estimate"), describe("path", language).alias("description"))


def _sums(groups) -> DataFrame:
    return groups.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("tokens"))


def by_language(entries: DataFrame) -> DataFrame:
    return _sums(entries.groupBy("language"))


def by_directory(entries: DataFrame) -> DataFrame:
    return _sums(entries.groupBy("root", directory("path").alias("folder")))


def totals(entries: DataFrame) -> DataFrame:
    return _sums(entries.groupBy())
