"""The symbol catalogue: extraction, lookup, outline, statistics and incremental refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.functions.text import content_hash, identifier_tokens, lines_of, query_terms
from lodeglass.operators import parse, units

# Fixed value: kinds that a lookup can be limited to.
KINDS = ["function", "class", "method", "interface", "type", "enum", "const", "block"]


#: An entry of the catalogue, without its file.
ENTRY = "name: string, kind: string, line: int, end_line: int, signature: string, container: string"


def symbols_of(lines: Column, language: Column, indented: bool = True, reach: units.Reach = units.REPORTED) -> Column:
    """ARRAY of entries of a file, in the order in which they are found.

    With `indented`, signatures of other languages count wherever they stand;
    without, only at the left margin. `units.WHOLE` as `reach` lets functions
    and classes end where they end, however long they are.
    """
    return parse.per_file(lines, ENTRY, lambda x, lang: units.symbols(x, lang, reach, indented), language)


def catalogue(files: DataFrame, keys: list[str], content: str = "content", language: str = "language", reach: units.Reach = units.REPORTED) -> DataFrame:
    """(keys, language, name, kind, line, end_line, signature, container): one row per name and line of a file, the last found counts.

    A method thus takes the place of the function that it was first taken
    for. `files` has one row per file, so that this is settled within the row
    and nothing is shuffled.
    """
    last = lambda x, lang: list({(e[0], e[2]): e for e in units.symbols(x, lang, reach)}.values())
    found = files.where(F.col(content).isNotNull()).select(*keys, F.col(language).alias("language"), parse.per_file(lines_of(content), ENTRY, last, F.col(language)).alias("_found"))
    return found.select(*keys, "language", F.inline("_found"))


def find(symbols: DataFrame, name: str, kind: str | None = None, language: str | None = None, root: str | None = None, limit: int = 20) -> DataFrame:
    """The best `limit` symbols for a name: equal ones, then ones that hold it, then ones that share a part; methods last in each.

    An unknown kind doesn't limit. `root` limits to paths below a folder.
    """
    lower = F.lower("name")
    terms = query_terms(name)
    shares = F.arrays_overlap(identifier_tokens("name"), F.array(*map(F.lit, terms))) if terms else F.lit(False)
    bucket = F.when(lower == name.lower(), 0).when(F.contains(lower, F.lit(name.lower())), 1).when(shares, 2)
    found = symbols
    if kind in KINDS:
        found = found.where(F.col("kind") == kind)
    if language:
        found = found.where(F.col("language") == language)
    if root:
        found = found.where(F.col("path").startswith(root.rstrip("/") + "/"))
    found = found.withColumn("bucket", bucket).where("bucket IS NOT NULL")
    return found.orderBy("bucket", F.col("kind") == "method", "path", "line", "name").limit(limit)


def outline(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("path") == path).orderBy("line")


def counts(symbols: DataFrame) -> DataFrame:
    """(kind, language, symbols, files): by kind, by language, and in all, in one pass."""
    sets = symbols.groupingSets([["kind"], ["language"], []], "kind", "language")
    return sets.agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("path").alias("files"))


def file_stats(rows: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, files, symbols, last_indexed): of the latest row of each file; `rows` has file_path, symbol_count and indexed_at."""
    latest = rows.where("file_path IS NOT NULL").groupBy(*groups, "file_path").agg(F.max(F.struct("indexed_at", "symbol_count")).alias("_r"))
    return latest.groupBy(*groups).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("_r.symbol_count"), F.lit(0)).alias("symbols"), F.max("_r.indexed_at").alias("last_indexed"))


def index_state(files: DataFrame, symbols: DataFrame, as_of: Column) -> DataFrame:
    """The rows that indexing files leaves: file_path, root_path, hash, language, symbol_count, indexed_at."""
    n = symbols.groupBy("root", "path").agg(F.count(F.lit(1)).alias("symbol_count"))
    joined = files.join(n, ["root", "path"], "left")
    return joined.select(
        F.concat_ws("/", "root", "path").alias("file_path"), F.col("root").alias("root_path"), content_hash("content").alias("hash"), "language",
        F.coalesce("symbol_count", F.lit(0).cast("bigint")).alias("symbol_count"), as_of.alias("indexed_at"),
    )


def refresh(files: DataFrame, symbols: DataFrame, manifest: DataFrame, reach: units.Reach = units.REPORTED) -> tuple[DataFrame, DataFrame]:
    """(symbols, pending files) after indexing what is new or changed.

    `manifest` has path and hash as of the last run, `files` one row per path.
    Symbols of changed and of removed files go, those of unchanged files stay
    as they are. One join of hashes tells them apart; contents stay where they
    were read.
    """
    known = manifest.select(F.col("path").alias("_path"), F.lower("hash").alias("_known"))
    state = files.withColumn("hash", content_hash("content")).join(known, F.col("path") == F.col("_path"), "left")
    same = F.coalesce(F.col("hash") == F.col("_known"), F.lit(False))
    todo = state.where(~same).drop("_path", "_known")
    kept = symbols.join(state.where(same).select("path"), "path", "left_semi")
    return kept.unionByName(catalogue(todo, ["path"], reach=reach)), todo


def changed_counts(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(scanned, indexed, added, changed, unchanged, removed), one row: what a refresh finds.

    `files` has path and hash, or path and content; `manifest` path and hash.
    """
    now = files if "hash" in files.columns else files.withColumn("hash", content_hash("content"))
    each = now.select("path", F.lower("hash").alias("_now"), F.lit(True).alias("_here")).join(
        manifest.select("path", F.lower("hash").alias("_known"), F.lit(True).alias("_there")), "path", "full_outer"
    )
    here, there = F.col("_here").isNotNull(), F.col("_there").isNotNull()
    same = F.coalesce(F.col("_now") == F.col("_known"), F.lit(False))
    return each.agg(
        F.count_if(here).alias("scanned"), F.count_if(here & ~same).alias("indexed"), F.count_if(here & ~there).alias("added"),
        F.count_if(here & there & ~same).alias("changed"), F.count_if(same).alias("unchanged"), F.count_if(there & ~here).alias("removed"),
    )


def without_file(symbols: DataFrame, path: str) -> DataFrame:
    """The catalogue after a file was invalidated."""
    return symbols.where(~F.col("path").eqNullSafe(F.lit(path)))
