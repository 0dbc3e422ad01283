"""Raw log lines into entries with time, level, component and message.

Three steps. A cascade of header layouts is tried on each line; the first that
fits makes the line a start and names its fields. Continuation lines get the
number of the last start before them, by a running window over stretches of
`STRETCH` lines of a file, so that a file of any length is spread over many
tasks. Last, the few entries that reach over the end of a stretch are put
together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeglass.session import spread

#: Lines of a file that one window handles at most (by line number).
STRETCH = 1 << 14

# Level words of the project and what they count as.
LEVEL_WORDS = {
    "FATAL": ["FATAL", "CRITICAL", "EMERGENCY"],
    "ERROR": ["ERROR", "ERR", "EXCEPTION", "TRACEBACK", "SEVERE"],
    "WARN": ["WARN", "WARNING", "DEPRECAT", "DEPRECATED"],
    "INFO": ["INFO", "INFORMATION"],
    "DEBUG": ["DEBUG", "TRACE", "VERBOSE"],
}
# Levels as first letters and as numbers.
LEVEL_LETTERS = {"F": "FATAL", "E": "ERROR", "W": "WARN", "I": "INFO", "D": "DEBUG", "V": "DEBUG", "T": "DEBUG"}
LEVEL_NUMBERS = {"60": "FATAL", "50": "ERROR", "40": "WARN", "30": "INFO", "20": "DEBUG", "10": "DEBUG"}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_WORD = "(?:" + "|".join(w for ws in LEVEL_WORDS.values() for w in sorted(ws, key=len, reverse=True)) + ")"
_DAY = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}:\d{2}"
_FRACTION = r"(?:[.,]\d+)?"
_ZONE = r"(?:\s?(?:Z|[+-]\d{2}:?\d{2}))?"
_MONTH = "(?:" + "|".join(m.capitalize() for m in MONTHS) + ")"

#: name, kind of time, pattern; the groups are time, level, component and message, in the order given last.
LAYOUTS: list[tuple[str, str, str, str]] = [
    ("iso", "iso", rf"^({_DAY}[T ]{_CLOCK}{_FRACTION}{_ZONE})\s+(?i:({_WORD}))\b:?\s+(?:\[([^\]]*)\]\s*)?(.*)$", "tlcm"),
    ("dashed", "iso", rf"^({_DAY}[T ]{_CLOCK}{_FRACTION}{_ZONE})\s+-\s+(\S+)\s+-\s+(?i:({_WORD}))\s+-\s(.*)$", "tclm"),
    ("dotted", "dmy", rf"^(\d{{2}}\.\d{{2}}\.\d{{4}}\s+{_CLOCK}{_FRACTION})\s+(\S+)\s+(?i:({_WORD}))\s+(.*)$", "tclm"),
    ("clf", "clf", rf"^\[(\d{{2}}/{_MONTH}/\d{{4}}:{_CLOCK}(?:\s[+-]\d{{4}})?)\]\s+(?i:({_WORD}))\s+([^\s:]+):\s?(.*)$", "tlcm"),
    ("syslog", "mdc", rf"^({_MONTH}\s+\d{{1,2}}\s+{_CLOCK})\s+\S+\s+([^\s\[:]+)(?:\[\d+\])?:\s+(?:(?i:({_WORD})):\s+)?(.*)$", "tclm"),
    ("glog", "mmdd", rf"^([FEWIDVT])(\d{{4}}\s+{_CLOCK}{_FRACTION})\s+\d+\s+([^\s\]:]+?)(?:\.\w+)?:\d+\]\s?(.*)$", "ltcm"),
    ("piped", "iso", rf"^(?i:({_WORD}))\s*\|\s*({_DAY}[T ]{_CLOCK}{_FRACTION}{_ZONE})\s*\|\s*([^|]*?)\s*\|\s?(.*)$", "ltcm"),
    ("android", "epoch", r"^(\d{9,10}(?:\.\d+)?|\d{12,13})\s+([FEWIDVT])/([^\s(:]+)(?:\(\s*\d+\))?:\s?(.*)$", "tlcm"),
]

#: Keys of JSON and key=value lines, in order of precedence. Fixed values.
TIME_KEYS = ["ts", "time", "timestamp", "@timestamp"]
LEVEL_KEYS = ["level", "lvl", "severity"]
COMPONENT_KEYS = ["component", "comp", "logger", "name"]
MESSAGE_KEYS = ["msg", "message", "text"]


def _first(values: list[Column]) -> Column:
    return F.coalesce(*values, F.lit(""))


def canonical_level(raw: Column) -> Column:
    """FATAL, ERROR, WARN, INFO or DEBUG for a level word, letter or number; empty text for anything else."""
    word = F.upper(F.trim(raw))
    named = {w: level for level, words in LEVEL_WORDS.items() for w in words} | LEVEL_LETTERS | LEVEL_NUMBERS
    table = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    return F.coalesce(F.try_element_at(table, word), F.lit(""))


def _offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC of '+hh:mm' or '+hhmm'; 0 for anything else."""
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    return F.coalesce(F.when(zone.startswith("-"), -minutes).otherwise(minutes), F.lit(0))


def logged_at(kind: Column, raw: Column, path: Column) -> Column:
    """Text ``YYYY-MM-DD HH:MM:SS`` in UTC of a raw time; null if it names no moment.

    Free of the session's time zone: all arithmetic is on TIMESTAMP_NTZ.
    """
    sub = lambda start, n: F.substring(raw, start, n)
    month = lambda name: F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name)).cast("string"), 2, "0")
    year = F.regexp_extract(path, r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)", 1)
    clock = F.regexp_extract(raw, rf"(?<!\d)({_CLOCK})", 1)
    # the layouts fix where the parts of most times stand
    local = (
        F.when(kind == "iso", F.concat(sub(1, 10), F.lit(" "), sub(12, 8)))
        .when(kind == "dmy", F.concat(sub(7, 4), F.lit("-"), sub(4, 2), F.lit("-"), sub(1, 2), F.lit(" "), clock))
        .when(kind == "clf", F.concat(sub(8, 4), F.lit("-"), month(sub(4, 3)), F.lit("-"), sub(1, 2), F.lit(" "), sub(13, 8)))
        .when(kind == "mdc", F.concat(year, F.lit("-"), month(sub(1, 3)), F.lit("-"), F.lpad(F.regexp_extract(raw, r"^\w{3}\s+(\d{1,2})", 1), 2, "0"), F.lit(" "), clock))
        .when(kind == "mmdd", F.concat(year, F.lit("-"), sub(1, 2), F.lit("-"), sub(3, 2), F.lit(" "), clock))
    ).try_cast("timestamp_ntz")
    zone = F.when(kind == "iso", F.regexp_extract(F.substring(raw, 20, 100), r"([+-]\d{2}:?\d{2})$", 1)).when(kind == "clf", F.trim(F.substring(raw, 21, 100)))
    moved = F.when(F.coalesce(zone, F.lit("")) == "", local).otherwise(local - F.expr("INTERVAL '1' MINUTE") * _offset_minutes(zone))
    whole = F.split_part(raw, F.lit("."), F.lit(1))
    number = whole.try_cast("bigint")
    seconds = F.when(F.length(whole) >= 12, F.floor(number / 1000)).otherwise(number)
    # beyond these bounds (years 0001 to 9999) no text of this form exists
    seconds = F.when(seconds.between(-62135596800, 253402300799), seconds)
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.expr("INTERVAL '1' SECOND") * seconds
    return F.substring(F.when(kind == "epoch", epoch).otherwise(moved).cast("string"), 1, 19)


def _matched(line: Column, layout: tuple[str, str, str, str]) -> Column:
    """ARRAY(kind, t, l, c, m) of a line that fits the layout, else null; the pattern runs once.

    A line that fits becomes its fields with marks between them, which no cleaned line holds.
    """
    _, kind, pattern, order = layout
    wanted = "\u0001".join([kind, *(f"${order.index(g) + 1}" for g in "tlcm")])
    joined = F.regexp_replace(line, f"(?s){pattern}", wanted)
    return F.when(joined.contains("\u0001"), F.split(joined, "\u0001", 5))


def _json_record(line: Column) -> Column:
    keys = TIME_KEYS + LEVEL_KEYS + COMPONENT_KEYS + MESSAGE_KEYS
    return F.when(line.startswith("{"), F.from_json(line, ", ".join(f"`{k}` string" for k in keys)))


def _keyed_fields(line: Column, record: Column) -> Column:
    """ARRAY(t, l, c, m) of a JSON line, given its record, or of a line of key=value pairs with a time; else null."""

    def pair(key: str) -> Column:
        found = F.regexp_extract(line, rf'(?:^|\s){key}=("(?:[^"\\]|\\.)*"|[^\s"]+)', 1)
        return F.nullif(F.regexp_replace(found, '^"|"$', ""), F.lit(""))

    def fields(value) -> Column:
        t = F.coalesce(*[value(k) for k in TIME_KEYS])
        return F.array(t, *[_first([value(k) for k in keys]) for keys in (LEVEL_KEYS, COMPONENT_KEYS, MESSAGE_KEYS)])

    pairs = line.rlike(r"^\w+=") & line.rlike(r"(?:^|\s)(?:" + "|".join(TIME_KEYS) + ")=")
    return F.when(line.startswith("{"), F.when(record.isNotNull(), fields(lambda k: record[k]))).when(pairs, fields(pair))


def _with_kind(fields: Column) -> Column:
    """ARRAY(kind, t, l, c, m) of ARRAY(t, l, c, m); null if the time is none."""
    t = fields[0]
    kind = F.when(t.rlike(r"^\d{9,13}(\.\d+)?$"), "epoch").when(t.rlike(f"^{_DAY}[T ]{_CLOCK}{_FRACTION}{_ZONE}$"), "iso")
    return F.when(kind.isNotNull(), F.concat(F.array(kind), fields))


def clean_line(line: Column) -> Column:
    """Without byte order mark, colour codes, a carriage return at the end, and the sign that marks fields here."""
    return F.regexp_replace(line, "^\ufeff|\u001b\\[[0-9;]*m|\u0001|\r+$", "")


#: Fields of a header, in the order in which the cascade gives them.
HEAD = ["kind", "t", "l", "c", "m"]


def parsed_lines(lines: DataFrame) -> DataFrame:
    """(path, line_no, line, kind, t, l, c, m): `kind` is null for a line that starts no entry."""
    raw = spread(lines.where("path IS NOT NULL AND line_no IS NOT NULL").select("path", "line_no", "line"))
    kept = raw.select("path", F.col("line_no").cast("bigint").alias("line_no"), clean_line(F.coalesce("line", F.lit(""))).alias("line"))
    line = F.col("line")
    start = line.rlike(r"^[^\s}]") & line.rlike(r"\d{2}")
    # step by step, so that each record is parsed and each pattern run once whatever refers to it
    recorded = kept.withColumn("_j", _json_record(line))
    keyed = recorded.select("path", "line_no", "line", F.when(start, _keyed_fields(line, F.col("_j"))).alias("_k"))
    cascade = F.when(start & ~line.startswith("{"), F.coalesce(*[_matched(line, x) for x in LAYOUTS]))
    headed = keyed.select("path", "line_no", "line", F.coalesce(_with_kind(F.col("_k")), cascade).alias("_h"))
    return headed.select("path", "line_no", "line", *[F.get("_h", F.lit(k)).alias(g) for k, g in enumerate(HEAD)])


def entry_lines(lines: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(path, line_no, line, kind, t, l, c, m, stretch, start_no): each line with the start it belongs to within its stretch.

    `start_no` is null before the first start of a stretch. A line delivered
    again counts once (of differing texts the one with the least hash).
    """
    # ordered by hash, not by text, so that a result without messages shuffles no texts
    within = Window.partitionBy("path", "stretch").orderBy("line_no", "_tie")
    return (
        parsed_lines(lines)
        .withColumn("stretch", F.expr(f"line_no div {int(stretch)}"))
        .withColumn("_tie", F.xxhash64("line"))
        .withColumn("_before", F.lag("line_no").over(within))
        .where("_before IS NULL OR _before <> line_no")
        .withColumn("start_no", F.last(F.when(F.col("kind").isNotNull(), F.col("line_no")), ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_before", "_tie")
    )


def log_entries(lines: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(path, line_no, end_line_no, logged_at, level, component, message), one row per entry.

    `lines` has path, line_no and line. An entry starts at an unindented line
    with its own time and ends at the last delivered line before the next
    start. `message` is the header's message followed by the continuation
    lines. Lines before a file's first start belong to no entry. Null paths
    and line numbers are left out, a null line counts as empty; level and
    component are empty text where the entry states none, `logged_at` is null
    where its time names no moment. Other columns of `lines` are ignored.
    """
    text = F.when(F.col("line_no") == F.col("start_no"), F.col("m")).otherwise(F.col("line"))
    head = [F.first(g, ignorenulls=True).alias(g) for g in HEAD if g != "m"]
    parts = (
        entry_lines(lines, stretch)
        .groupBy("path", "stretch", "start_no")
        .agg(F.max("line_no").alias("end_no"), *head, F.sort_array(F.collect_list(F.struct("line_no", text.alias("text")))).alias("texts"))
    )
    in_stretch = Window.partitionBy("path", "stretch")
    # What crosses the end of a stretch: its last entry, and the lines before its first start. At most two rows a
    # stretch get the key -1 and meet in one window per file; all other entries are whole as they are.
    last = F.col("start_no") == F.max("start_no").over(in_stretch)
    seam = F.when(F.col("start_no").isNull() | last, F.lit(-1)).otherwise(F.col("stretch"))
    along = Window.partitionBy("path", "seam").orderBy("stretch", F.col("start_no").asc_nulls_first())
    whole = (
        parts.withColumn("seam", seam)
        .withColumn("entry", F.last("start_no", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .where("entry IS NOT NULL")
        .groupBy("path", "seam", "entry")
        .agg(F.max("end_no").alias("end_line_no"), *head, F.sort_array(F.collect_list(F.struct("stretch", "texts"))).alias("texts"))
    )
    message = F.array_join(F.transform(F.flatten(F.col("texts.texts")), lambda x: x["text"]), "\n")
    return whole.select(
        "path",
        F.col("entry").alias("line_no"),
        "end_line_no",
        logged_at(F.col("kind"), F.col("t"), F.col("path")).alias("logged_at"),
        canonical_level(F.col("l")).alias("level"),
        F.coalesce(F.col("c"), F.lit("")).alias("component"),
        message.alias("message"),
    )


def scanned_entries(found: DataFrame, lines: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Entries of a line scan's findings beside what the whole file says about them.

    `found` has path, line_no, level, message and context_lines (rows may come
    twice). Gives one row per finding that is a start or lies within an entry:
    path, line_no, guessed_level, entry_line_no, logged_at, level, component.
    """
    each = found.where("path IS NOT NULL AND line_no IS NOT NULL").groupBy("path", "line_no").agg(F.max("level").alias("guessed_level"))
    each = each.withColumn("stretch", F.expr(f"line_no div {int(stretch)}"))
    entries = log_entries(lines, stretch).drop("message")
    # an entry is offered to every stretch that it touches, so that the join has an equality
    offered = entries.withColumnRenamed("line_no", "entry_line_no").withColumn(
        "stretch", F.explode(F.sequence(F.expr(f"entry_line_no div {int(stretch)}"), F.expr(f"end_line_no div {int(stretch)}")))
    )
    inside = F.col("line_no").between(F.col("entry_line_no"), F.col("end_line_no"))
    return (
        each.join(offered, ["path", "stretch"]).where(inside)
        .select("path", "line_no", "guessed_level", "entry_line_no", "logged_at", "level", "component")
    )


def layouts_seen(lines: DataFrame) -> DataFrame:
    """(kind, n): how many starts each kind of time accounts for."""
    heads = parsed_lines(lines).where("kind IS NOT NULL")
    return heads.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))

