"""Functions, classes and imports of source files, as expressions over a file's array of lines.

What needs extents is worked out by `lodeglass.operators.units`, in one pass
per file and a batch of files at a time; the rest stays in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass import config
from lodeglass.functions.text import trimmed
from lodeglass.operators import units
from lodeglass.operators.patterns import (  # noqa: F401
    BRACE_CLASS, BRACE_FUNCTIONS, BRACE_METHOD, DOCSTRING, ENUM, IMPORTS, INDENT_CLASS, INDENT_FUNCTION, INDENT_METHOD, INTERFACE, PYTHON_IMPORT, PYTHON_MODULE, SCRIPT_IMPORT, SIGNATURES, TYPE,
)

UNIT = "name: string, start_line: int, end_line: int, signature: string"
#: A class, with the names of its methods.
CLASS = f"{UNIT}, methods: array<string>"


def per_file(lines: Column, fields: str, make: Callable[[list[str]], list[tuple]], language: Column | None = None) -> Column:
    """ARRAY<STRUCT<fields>> of what `make` says of each file's lines (and language); null for null lines."""
    names = [f.split(":")[0].strip() for f in fields.split(", ")]
    rows = lambda found: [dict(zip(names, x)) for x in found]
    if language is None:

        @F.pandas_udf(f"array<struct<{fields}>>")
        def each(texts: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else rows(make(list(x))) for x in texts], dtype=object)

        return each(lines)

    @F.pandas_udf(f"array<struct<{fields}>>")
    def both(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else rows(make(list(x), lang)) for x, lang in zip(texts, languages)], dtype=object)

    return both(lines, language)


def _flat(found: list[units.Unit]) -> list[tuple]:
    return [(u.name, u.start_line, u.end_line, u.signature, list(u.methods)) for u in found]


def brace_functions(lines: Column, reach: int | None = config.BRACE_LINES) -> Column:
    """ARRAY<STRUCT(name, start_line, end_line, signature)>; a function reaches over at most `reach` lines, None for all."""
    return per_file(lines, UNIT, lambda x: _flat(units.brace_functions(x, units.Braces(x), reach)))


def brace_classes(lines: Column, reach: int | None = config.BRACE_LINES) -> Column:
    """The same with `methods`, each name once."""
    return per_file(lines, CLASS, lambda x: _flat(units.brace_classes(x, units.Braces(x), reach)))


def indent_functions(lines: Column, reach: int | None = config.INDENT_LINES) -> Column:
    return per_file(lines, UNIT, lambda x: _flat(units.indent_functions(x, units.Indents(x), reach)))


def indent_classes(lines: Column, reach: int | None = config.INDENT_LINES) -> Column:
    return per_file(lines, CLASS, lambda x: _flat(units.indent_classes(x, units.Indents(x), reach)))


def named_lines(lines: Column, pattern: str) -> Column:
    """ARRAY<STRUCT(at, name, line)> of the lines that fit a pattern with one group."""
    name = lambda x: F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))
    marked = F.transform(lines, lambda x, k: F.struct((k + 1).alias("at"), name(x).alias("name"), x.alias("line")))
    return F.filter(marked, lambda h: h["name"].isNotNull())


def docstring(content: Column) -> Column:
    """The first triple-quoted text that begins a line."""
    return F.when(content.rlike(DOCSTRING), trimmed(F.concat(F.regexp_extract(content, DOCSTRING, 1), F.regexp_extract(content, DOCSTRING, 2))))


def all_signatures(lines: Column, language: Column) -> Column:
    """Trimmed signature lines of languages without a parser."""

    @F.pandas_udf("array<string>")
    def each(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [s for _, s in units.signatures(list(x), lang)] for x, lang in zip(texts, languages)], dtype=object)

    return each(lines, language)


def signatures(lines: Column, language: Column, limit: int | None = config.SIGNATURES) -> Column:
    """The first `limit` of them, as a report lists them; None for all."""
    found = all_signatures(lines, language)
    return found if limit is None else F.slice(found, 1, limit)


def _fits(pattern: str):
    return lambda line: line.rlike(pattern)


def imports(lines: Column, language: Column) -> Column:
    """Modules of import lines (script and Python files), or the lines themselves."""
    script = F.transform(lines, lambda x: F.regexp_extract(x, SCRIPT_IMPORT, 1))
    python = F.transform(lines, lambda x: F.regexp_extract(x, PYTHON_IMPORT, 0))
    python = F.transform(python, lambda x: F.regexp_extract(x, PYTHON_MODULE, 1))
    flat = F.transform(lines, trimmed)
    out = F.when(language.isin("typescript", "javascript"), F.filter(script, lambda x: x != "")).when(language == "python", F.filter(python, lambda x: x != ""))
    for lang, pattern in IMPORTS.items():
        out = out.when(language == lang, F.filter(flat, _fits(pattern)))
    return out.otherwise(F.array().cast("array<string>"))
