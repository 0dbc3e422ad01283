"""Pieces of DuckDB SQL that several oracles share, written independently of the Spark expressions."""

from __future__ import annotations

from lodeglass import config
from lodeglass.plans import samples

BLANKS = r"e' \t\r\n\f\x0b'"
CF = (
    r"cf AS (SELECT root, path, regexp_replace(max(content), '^\x{FEFF}', '') AS content FROM (SELECT root, path, content FROM code_files UNION ALL ("
    + samples.sql_values() + ")) WHERE path IS NOT NULL AND content IS NOT NULL GROUP BY root, path)"
)


def trim(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def language(path: str, default: str = "plaintext") -> str:
    ext = f"lower(regexp_extract(regexp_extract({path}, '[^/]*$'), '^.+(\\.[^.]*)$', 1))"
    arms = " ".join(f"WHEN '{e}' THEN '{lang}'" for lang, es in config.LANGUAGE_EXTENSIONS.items() for e in es)
    return f"(CASE {ext} {arms} ELSE '{default}' END)"


def code_tokens(x: str) -> str:
    t = trim("l")
    return (
        f"list_sum(list_transform(string_split({x}, chr(10)), lambda l: CASE WHEN {t} = '' OR {t} LIKE '//%' OR {t} LIKE '#%' THEN 2 "
        "ELSE cast(ceil(length(l) / 4.0) AS BIGINT) END))::BIGINT"
    )


def identifier_tokens(m: str) -> str:
    return (
        f"list_distinct_keep(list_concat([lower({m})], flatten(list_transform(list_filter(regexp_split_to_array({m}, '[^A-Za-z0-9]+'), lambda s: s <> ''), "
        "lambda s: list_concat([lower(s)], list_filter(list_transform(string_split(regexp_replace(regexp_replace(s, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), "
        "'([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), ' '), lambda p: lower(p)), lambda p: length(p) >= 2))))))"
    ).replace("list_distinct_keep", "list_distinct")


def document_terms(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in config.STOP_WORDS)
    names = f"list_filter(regexp_extract_all({x}, '[A-Za-z_]\\w*'), lambda m: length(m) >= 2)"
    return f"list_filter(flatten(list_transform({names}, lambda m: {identifier_tokens('m')})), lambda t: length(t) >= 2 AND t NOT IN ({stop}))"


def lines(source: str, keys: str, content: str = "content") -> str:
    """SELECT keys, n, line"""
    return f"SELECT {keys}, generate_subscripts(ls, 1) AS n, unnest(ls) AS line FROM (SELECT {keys}, string_split({content}, chr(10)) AS ls FROM {source} WHERE {content} IS NOT NULL)"
