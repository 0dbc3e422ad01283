"""Scalar functions on texts, lines, identifiers and paths, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass import config

#: White space as the reference's string functions understand it; Java's ``\s`` is ASCII only.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), f"^{SPACE}+|{SPACE}+$", "")


def lines_of(x: Column | str) -> Column:
    """Array of lines; what line feeds separate, empty ones included, one empty line for an empty text."""
    return F.split(_col(x), "\n", -1)


def js_round(x: Column) -> Column:
    """Half goes up, also below zero."""
    return F.floor(x + 0.5)


# -- tokens ------------------------------------------------------------------
def text_tokens(x: Column | str) -> Column:
    return F.ceil(F.length(_col(x)) / config.CHARS_PER_TOKEN)


def line_tokens(line: Column) -> Column:
    cheap = line.rlike(rf"^{SPACE}*(?:\z|//|#)")
    return F.when(cheap, F.lit(config.BLANK_LINE_TOKENS).cast("bigint")).otherwise(F.ceil(F.length(line) / config.CHARS_PER_TOKEN))


def code_tokens(x: Column | str) -> Column:
    """Tokens of code: blank and comment lines cost two, others a token per four characters."""
    return F.aggregate(lines_of(x), F.lit(0).cast("bigint"), lambda acc, line: acc + line_tokens(line))


def lines_tokens(n: Column | str) -> Column:
    """Tokens of so many lines of usual length."""
    return F.ceil(_col(n) * config.LINE_CHARS / config.CHARS_PER_TOKEN)


def token_label(n: Column | str) -> Column:
    n = _col(n)
    return F.when(n >= 1000, F.concat(F.format_string("%.1f", F.floor(n / 100 + 0.5) / 10), F.lit("k"))).otherwise(n.cast("string"))


def percent_saved(before: Column | str, after: Column | str) -> Column:
    before, after = _col(before), _col(after)
    return F.when(before == 0, F.lit(0).cast("bigint")).otherwise(js_round((before - after) / before * 100))


# -- hashes ------------------------------------------------------------------
def content_hash(x: Column | str) -> Column:
    return F.substring(F.sha2(_col(x), 256), 1, 16)


def stat_hash(modified_ms: Column | str, size: Column | str) -> Column:
    """Hash of a file's time and size, without reading it."""
    return content_hash(F.concat_ws(":", _col(modified_ms).cast("string"), _col(size).cast("string")))


def is_changed(old_stat: Column, new_stat: Column, old_hash: Column, new_hash: Column) -> Column:
    """Whether a file changed: not if time and size are as they were, else if its content's hash differs; null hashes differ from all."""
    return ~old_stat.eqNullSafe(new_stat) & ~F.coalesce(F.lower(old_hash) == F.lower(new_hash), F.lit(False))


# -- identifiers -------------------------------------------------------------
def identifier_tokens(x: Column | str) -> Column:
    """The identifier in lower case and its parts by signs, case changes and acronyms, each once, in order."""
    x = _col(x)

    def parts(segment: Column) -> Column:
        spaced = F.regexp_replace(F.regexp_replace(segment, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
        small = F.filter(F.split(F.lower(spaced), " "), lambda p: F.length(p) >= 2)
        return F.concat(F.array(F.lower(segment)), small)

    segments = F.filter(F.split(x, "[^A-Za-z0-9]+"), lambda s: s != "")
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(F.lower(x)), F.flatten(F.transform(segments, parts)))))


def document_terms(x: Column | str) -> Column:
    """All identifiers of a text with their parts, repeats kept, without short ones and stop words."""
    names = F.regexp_extract_all(_col(x), F.lit(r"([A-Za-z_]\w+)"), F.lit(1))

    def tokens(name: Column) -> Column:
        # most words have nothing to split, which one look tells
        return F.when(name.rlike(r"^[A-Za-z][a-z0-9]*$"), F.array(F.lower(name))).otherwise(identifier_tokens(name))

    return F.filter(F.flatten(F.transform(names, tokens)), lambda t: (F.length(t) >= 2) & ~t.isin(config.STOP_WORDS))


def identifier_tokens_of(name: str) -> list[str]:
    """`identifier_tokens` of one literal, on the driver."""
    if not name:
        return []
    out = [name.lower()]
    for segment in filter(None, re.split(r"[^A-Za-z0-9]+", name)):
        spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", segment))
        out += [segment.lower(), *(p for p in spaced.lower().split(" ") if len(p) >= 2)]
    return list(dict.fromkeys(out))


def query_terms(query: str) -> list[str]:
    """Terms of a query, on the driver: words without stop words, then their parts."""
    words = [w for w in re.sub(r"[^\w\s]", " ", query.lower(), flags=re.ASCII).split() if len(w) > 1 and w not in config.STOP_WORDS]
    return list(dict.fromkeys([*words, *(p for w in words for p in identifier_tokens_of(w) if len(p) > 1)]))


# -- paths -------------------------------------------------------------------
def base_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def directory(path: Column | str) -> Column:
    """Folder of a path; ``.`` if there is none."""
    found = F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)
    return F.when(found == "", F.lit(".")).otherwise(found)


def extension(path: Column | str) -> Column:
    """Lower-case ending with its dot; empty for none and for names that begin with their only dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def language_of(path: Column | str, default: str = "plaintext") -> Column:
    table = {e: lang for lang, endings in config.LANGUAGE_EXTENSIONS.items() for e in endings}
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit(default))


def describe(path: Column | str, language: Column | str) -> Column:
    name, language = base_name(path), _col(language)
    out = None
    for words, how, text in config.DESCRIPTIONS:
        test = name.isin(words) if how == "is" else name.rlike("|".join(map(re.escape, words)))
        out = F.when(test, text) if out is None else out.when(test, text)
    return out.when(language != "other", language).otherwise("file")


def relative_path(path: Column | str, root: Column | str) -> Column:
    """The path below a root, or the path itself where it isn't below it."""
    path, root = _col(path), F.rtrim(_col(root), F.lit("/"))
    below = path.startswith(F.concat(root, F.lit("/")))
    return F.when(below, F.substr(path, F.length(root) + 2)).otherwise(path)


def normal_path(path: Column | str) -> Column:
    """A path with slashes only and without ``.`` and ``..`` steps; ``..`` above the top is dropped."""
    x = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(x, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.when(x.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def resolved_path(path: Column | str, base: Column | str) -> Column:
    """The path seen from a base folder: itself if it begins with a slash, else below the base; without ``.`` and ``..`` steps."""
    path = _col(path)
    return normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(_col(base), F.lit("/"), path)))


def compound_key(*parts: Column | str) -> Column:
    """One text for several key columns; null if any of them is."""
    cols = [_col(p).cast("string") for p in parts]
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known &= c.isNotNull()
    return F.when(known, F.concat_ws("|", *cols))


# -- contents ----------------------------------------------------------------
def redacted(x: Column | str) -> Column:
    """Private blocks replaced by a mark."""
    return F.regexp_replace(_col(x), r"(?is)<private>.*?</private>", "<private>[redacted]</private>")


def truncated(x: Column | str, n: int) -> Column:
    x = _col(x)
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.substring(x, 1, n - 1), F.lit("…")))


def summary_of(content: Column | str, language: Column | str) -> Column:
    """Line count with a file's first exports, definitions or beginning."""
    content, language = _col(content), _col(language)
    lines = lines_of(content)
    flat = F.transform(lines, trimmed)
    count = F.concat(F.size(lines).cast("string"), F.lit(" lines. "))
    exports = F.slice(F.filter(flat, lambda x: x.rlike(r"^export\s+(function|class|const|interface|type|enum)")), 1, 8)
    exports = F.transform(exports, lambda x: trimmed(F.regexp_replace(x, r"\{.*", "")))
    defs = F.slice(F.filter(flat, lambda x: x.rlike(r"^(def|class)\s+")), 1, 8)
    defs = F.transform(defs, lambda x: F.regexp_replace(F.split_part(x, F.lit("("), F.lit(1)), r"^(def|class)\s+", ""))
    start = F.substring(trimmed(F.array_join(F.slice(lines, 1, 5), "\n")), 1, 100)
    return (
        F.when(language.isin("typescript", "javascript") & (F.size(exports) > 0), F.concat(count, F.lit("Exports: "), F.array_join(exports, ", ")))
        .when((language == "python") & (F.size(defs) > 0), F.concat(count, F.lit("Defines: "), F.array_join(defs, ", ")))
        .otherwise(F.concat(count, F.lit("Starts: "), start))
    )


def context_around(lines: Column, at: Column, size: int) -> Column:
    """Trimmed, non-blank lines within `size` of line `at` (from 1), without it."""
    before = F.slice(lines, F.greatest(at - size, F.lit(1)), at - F.greatest(at - size, F.lit(1)))
    after = F.slice(lines, at + 1, F.lit(size))
    return F.filter(F.transform(F.concat(before, after), trimmed), lambda x: x != "")


def minutes_ago(then: Column | str, as_of: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return js_round((micros(as_of) - micros(_col(then))) / 60e6)
