"""Scalar functions on log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass import config
from lodeglass.functions.text import SPACE

# Both ends of a match are word characters; Java's \b would see accented letters as such too.
_OPEN, _CLOSE = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_TIME = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.,\d]*"
_UUID = rf"{_OPEN}[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}{_CLOSE}"


def line_level(line: Column) -> Column:
    """FATAL, ERROR or WARN by the first pattern that a line holds, else null."""
    out = None
    for level, pattern in config.LEVEL_PATTERNS.items():
        test = line.rlike("(?i)" + pattern.replace(r"\b", _OPEN, 1).removesuffix(r"\b") + r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")
        out = F.when(test, level) if out is None else out.when(test, level)
    return out


def dedupe_key(message: Column, chars: int | None = config.DEDUPE_CHARS) -> Column:
    """Messages that differ in times, UUIDs and numbers only, in their first `chars` characters or (None) at all, have the same key."""
    x = F.regexp_replace(message, _TIME, "<TIME>")
    x = F.regexp_replace(x, _UUID, "<UUID>")
    x = F.regexp_replace(x, rf"{_OPEN}\d+{_CLOSE}", "<N>")
    return x if chars is None else F.substring(x, 1, chars)


def display_message(message: Column) -> Column:
    """Times, UUIDs, addresses and URLs by their kind, paths by their last part, white space as one blank."""
    x = F.regexp_replace(message, _TIME, "<TIME>")
    x = F.regexp_replace(x, f"(?i){_UUID}", "<UUID>")
    x = F.regexp_replace(x, rf"{_OPEN}\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}{_CLOSE}", "<IP>")
    x = F.regexp_replace(x, rf"https?://[^\s ]+", "<URL>")
    x = F.regexp_replace(x, r"/(?:[\w./\-]*/)([\w.\-]*)|/([\w.\-]+)", "$1$2")
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


# Lines of stack traces.
STACK_LINES = [
    r"^\s+at\s+", r'^\s+File\s+"[^"]+",\s+line\s+\d+', r"^\s+\w+\.\w+\([\w.]+:\d+\)", r"^\s+\[\d+\]\s+0x[0-9a-f]+",
    r"^\s+#\d+\s+0x[0-9a-f]+", r"goroutine\s+\d+\s+\[", r"^\s+from\s+[\w/]+\.rb:\d+",
]


def is_stack_line(line: Column) -> Column:
    return line.rlike("|".join(f"(?:{p})" for p in STACK_LINES))


def is_repetition(line: Column) -> Column:
    return line.rlike(r"(?i)(?:\.\.\.|repeated|again|above|similar|same error)")


def has_time(text: Column) -> Column:
    return text.rlike(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|\[\d{2}:\d{2}:\d{2}\]")


def is_json(line: Column) -> Column:
    """Whether a line is one JSON value; the parser alone would be content with a line that begins with one."""
    shape = r"""(?s)^\s*(?:\{.*\}|\[.*\]|"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)\s*\z"""
    return line.rlike(shape) & F.try_parse_json(line).isNotNull()


def line_format(line: Column) -> Column:
    return F.when(is_json(line), "json").when(line.rlike(r"\w+=\S+"), "logfmt").otherwise("plain")


def json_fields(line: Column) -> Column:
    """STRUCT(level, message) of a JSON line by the usual keys; null for other lines."""
    at = lambda keys: F.coalesce(*[F.get_json_object(line, f"$.{k}") for k in keys], F.lit(""))
    fields = F.struct(at(["level", "severity", "lvl"]).alias("level"), at(["message", "msg", "text"]).alias("message"))
    return F.when(is_json(line), fields)
