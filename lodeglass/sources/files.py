"""Source trees and tables of files as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass import config
from lodeglass.functions.text import code_tokens, content_hash, extension, language_of, lines_of, summary_of


@dataclass(frozen=True)
class ScanRules:
    """Which files of a tree a scan takes; all of it is decided on the listing, before any file is read."""

    max_depth: int
    max_bytes: int | None = None
    skip_files: bool = True
    dotted: str = "never"  # never | top (named ones at the top) | below (everything that starts with a dot, below the top)
    dotted_top: tuple[str, ...] = config.DOTTED_TOP
    languages: tuple[str, ...] | None = None
    extensions: tuple[str, ...] | None = None


SEARCH_SCAN = ScanRules(max_depth=8, max_bytes=5 * 1024 * 1024)
MAP_SCAN = ScanRules(max_depth=10, max_bytes=10 * 1024 * 1024 + 1, dotted="top")
SYMBOL_SCAN = ScanRules(max_depth=10, max_bytes=2 * 1024 * 1024 + 1, dotted="below", languages=tuple(config.CODE_LANGUAGES))
GRAPH_SCAN = ScanRules(max_depth=5, skip_files=False, languages=tuple(config.LANGUAGE_EXTENSIONS))


def taken(path: Column, size: Column, rules: ScanRules) -> Column:
    """Whether a scan takes the file at a path relative to its root."""
    parts = F.split(path, "/")
    folders, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    ok = F.size(folders) <= rules.max_depth
    top, below = F.slice(parts, 1, 1), F.slice(parts, 2, 100_000)
    barred = lambda x: x.startswith(".") | x.isin(config.IGNORED_DIRECTORIES)
    ignored = lambda x: x.isin(config.IGNORED_DIRECTORIES)
    ok &= ~F.exists(below, barred)
    if rules.dotted == "top":
        ok &= ~F.exists(top, lambda x: barred(x) & ~x.isin(*rules.dotted_top))
    elif rules.dotted == "below":
        ok &= ~F.exists(top, ignored)
    else:
        ok &= ~F.exists(top, barred)
    if rules.skip_files:
        ok &= ~name.isin(config.IGNORED_FILES)
    if rules.max_bytes is not None:
        ok &= size < rules.max_bytes
    if rules.extensions is not None:
        ok &= extension(path).isin(*rules.extensions)
    if rules.languages is not None:
        ok &= language_of(path, "").isin(*rules.languages)
    return ok


def _dotted(spark: SparkSession, base: str, rules: ScanRules) -> tuple[list[str], list[tuple]]:
    """Folders and files at the top that begin with a dot and may be taken; Spark's own listing leaves such names out."""
    if rules.dotted == "never":
        return [], []
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    wanted = [s for s in found if (n := s.getPath().getName()).startswith(".") and (n in rules.dotted_top if rules.dotted == "top" else n not in config.IGNORED_DIRECTORIES)]
    folders = sorted(base + s.getPath().getName() for s in wanted if s.isDirectory())
    return folders, [(base + s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in wanted if s.isFile()]


def _read_files(spark: SparkSession, files: list[tuple]) -> DataFrame:
    """The rows that Spark's binary source would give for these files (path, length, time in milliseconds)."""

    def read(batches):
        from pyarrow import fs

        for pdf in batches:
            data = []
            for path in pdf["path"]:
                system, at = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
                with system.open_input_file(at) as f:
                    data.append(f.read())
            yield pd.DataFrame({"path": pdf["path"], "modificationTime": pd.to_datetime(pdf["ms"], unit="ms"), "length": pdf["length"], "content": data})

    listed = spark.createDataFrame(files, "path string, length bigint, ms bigint")
    return listed.mapInPandas(read, "path string, modificationTime timestamp, length bigint, content binary")


def scan_tree(spark: SparkSession, root: str, rules: ScanRules = SEARCH_SCAN) -> DataFrame:
    """(root, path, content, size, modified) of the files of a tree that `rules` take.

    The filters are on path and length, so that Spark reads only files that
    pass. Undecodable bytes become replacement characters.
    """
    base = root.rstrip("/") + "/"
    folders, dot_files = _dotted(spark, base, rules)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load([base, *folders])
    if dot_files:
        found = found.unionByName(_read_files(spark, dot_files))
    # whatever scheme Spark puts before it, the root ends where its own text ends
    relative = F.expr(f"substring_index(path, '{base.split('://')[-1].removeprefix('file:')}', -1)")
    return (
        found.withColumn("_rel", relative)
        .where(taken(F.col("_rel"), F.col("length"), rules))
        .select(F.lit(root).alias("root"), F.col("_rel").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )


def distinct_files(files: DataFrame) -> DataFrame:
    """(root, path, language, content): one row per file of a table that may hold files twice.

    The greatest content counts; files without content are left out; byte
    order marks are cut off; the language is that of the path's ending.
    """
    each = files.where("path IS NOT NULL AND content IS NOT NULL").groupBy("root", "path").agg(F.max("content").alias("content"))
    return each.select("root", "path", language_of("path").alias("language"), F.regexp_replace("content", "^\ufeff", "").alias("content"))


def file_lines(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, line_no, line), one row per line."""
    return files.where(F.col(content).isNotNull()).select(*keys, F.posexplode(lines_of(content)).alias("_p", "line")).select(*keys, (F.col("_p") + 1).cast("bigint").alias("line_no"), "line")


def file_records(files: DataFrame, as_of: Column) -> DataFrame:
    """The cache rows that reading the files gives: path, hash, summary, language, line_count, token_estimate, last_read_at."""
    return files.select(
        "path", content_hash("content").alias("hash"), summary_of("content", "language").alias("summary"), "language",
        F.size(lines_of("content")).cast("bigint").alias("line_count"), code_tokens("content").alias("token_estimate"), as_of.alias("last_read_at"),
    )

