"""Chunks of files: sections, sliding windows, and code units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass import config
from lodeglass.functions.text import code_tokens, lines_of
from lodeglass.operators import parse, rank, units

SPAN = "start_line: int, end_line: int, chunk_type: string, identifier: string"


def _span(start: Column, end: Column, kind: str, identifier: Column | None = None) -> Column:
    name = F.lit(None).cast("string") if identifier is None else identifier
    return F.struct(start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), F.lit(kind).alias("chunk_type"), name.alias("identifier"))


def section_spans(lines: Column, size: int = config.SECTION_LINES) -> Column:
    n = F.size(lines)
    return F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda i: _span(i + 1, F.least(i + size, n), "block"))


def window_spans(lines: Column, size: int = config.WINDOW_LINES, overlap: int = config.WINDOW_OVERLAP) -> Column:
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size must hold")
    n = F.size(lines)
    return F.transform(F.sequence(F.lit(0), n - 1, F.lit(size - overlap)), lambda i: _span(i + 1, F.least(i + size, n), "lines"))


def unit_spans(lines: Column, language: Column, reach: units.Reach = units.REPORTED) -> Column:
    """Functions, then classes that no function and no class before holds; sections where there are none.

    A signature of a language without a parser stands for the lines up to
    `reach.signature`, or, where that is None, up to the next signature.
    """
    found = parse.per_file(lines, SPAN, lambda x, lang: units.unit_spans(x, lang, reach), language)
    return F.when(F.size(found) > 0, found).otherwise(section_spans(lines))


def chunks(files: DataFrame, keys: list[str], spans, content: str = "content") -> DataFrame:
    """(keys, chunk_no, start_line, end_line, chunk_type, identifier, text); `spans` maps the lines array to spans.

    Each file becomes its chunks within its row: nothing is shuffled, and the
    file's lines aren't copied for each of its chunks.
    """
    lines = F.col("_lines")
    cut = files.where(F.col(content).isNotNull()).withColumn("_lines", lines_of(content))
    cut = cut.select(*keys, "_lines", spans(lines).alias("_spans"))
    text = lambda s: F.array_join(F.slice(lines, s["start_line"], s["end_line"] - s["start_line"] + 1), "\n")
    each = F.transform("_spans", lambda s, k: F.struct((k + 1).alias("chunk_no"), *[s[c].alias(c) for c in ("start_line", "end_line", "chunk_type", "identifier")], text(s).alias("text")))
    return cut.select(*keys, F.inline(each))


def index_chunks(files: DataFrame, keys: list[str], content: str = "content", language: str = "language", reach: units.Reach = units.REPORTED) -> DataFrame:
    """Code units of code files, sliding windows of all others."""
    code = F.col(language).isin(config.CODE_LANGUAGES)
    parts = files.withColumn("_lang", F.col(language))
    coded = chunks(parts.where(code), [*keys, "_lang"], lambda x: unit_spans(x, F.col("_lang"), reach), content).drop("_lang")
    windows = chunks(parts.where(~F.coalesce(code, F.lit(False))), keys, window_spans, content)
    return coded.unionByName(windows)


def extract_by_name(found: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The first chunk of each file whose identifier is `name`, in any case."""
    hits = found.where(F.lower("identifier") == name.lower())
    return hits.groupBy(*keys).agg(F.min_by(F.struct("chunk_no", "start_line", "end_line", "identifier", "text"), "chunk_no").alias("_c")).select(*keys, "_c.*")


def extract(found: DataFrame, name: str, keys: list[str], budget: int = config.SNIPPET_BUDGET) -> DataFrame:
    """(keys, chunk_no, start_line, end_line, identifier, exact): the unit of that name in each file, else the best chunk for it.

    Where no unit bears the name, the file's chunks are ranked for it and
    packed into the budget; the first one kept stands in, `exact` being false.
    """
    spans = ["chunk_no", "start_line", "end_line", "identifier"]
    named = extract_by_name(found, name, keys).select(*keys, *spans, F.lit(True).alias("exact"))
    others = found.join(named.select(*keys), keys, "left_anti").select(*keys, *spans, "text")
    scores = rank.chunk_scores(others, keys, [*spans, "tokens"], "text", name, tokens=code_tokens("text")).where("score > 0")
    order = [F.col("score").desc(), F.col("chunk_no")]
    kept = rank.packed(scores.withColumn("score", F.round("score", 9)), keys, order, "tokens", budget)
    best = kept.groupBy(*keys).agg(F.min_by(F.struct(*spans), F.struct(-F.col("score"), "chunk_no")).alias("_c")).select(*keys, "_c.*", F.lit(False).alias("exact"))
    return named.unionByName(best)
