"""Which source files nobody wrote by hand: generated, minified, vendored, or data saved as code.

A repository may say so itself, in attribute files (``.gitattributes``) whose
globs take precedence by folder and line. For repositories that declare
nothing, equivalent patterns are mined from the collection:

* libraries, kept in versioned folders of several repositories, and the
  folders right below which mostly such libraries stand, mark vendored files,
  as does a header that names a library with a version;
* generators, named by the standard marks of generated files in several
  repositories, and folders and endings of names under which files with such
  evidence stand far more often than elsewhere, mark generated files;
* phrases of headers that stand under those folders and endings far more often
  than elsewhere mark generated files as well, wherever they are;
* endings of names whose files are packed mark minified files.

What content shows by itself (packed code, tables of numbers, standard marks)
counts as it is. Conventional names complete the mined ones, which matters in
collections too small to mine.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.session import broadcast_if_small, cut_lineage, join_small_or_salted, spread

# Folder names, in lower case, under which generators or build tools write.
GENERATED_DIRS = ["gen", "generated", "__generated__", "_generated", "autogen", "auto-generated", "codegen", "codegen-out", "generated-src", "generated_src"]
# Folder names, in lower case, under which copies of other projects are kept.
VENDOR_DIRS = [
    "vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "3rd-party", "external", "externals",
    "extern", "deps", "upstream", "node_modules", "bower_components", "jspm_packages", "pods", "carthage", "godeps", "site-packages",
]
# Endings of generated files' names.
GENERATED_NAMES = (
    r"(?:\.pb\.(?:go|cc|h|swift|dart)|_pb2(?:_grpc)?\.pyi?|[A-Za-z0-9]Grpc\.java|OuterClass\.java|\.g\.(?:cs|i\.cs|dart|ts)|\.designer\.(?:cs|vb)|"
    r"[_-]gen\.go|\.gen\.\w+|[._-]generated\.\w+|\.freezed\.dart|_string\.go|\.feature\.cs)$|^(?:zz_generated|moc_|ui_|qrc_)[\w.]*$"
)
# Endings of minified or bundled files' names.
MINIFIED_NAMES = r"(?:[.-]min|\.bundle|[.-]pack|\.prod)\.(?:js|mjs|cjs|css)$|\.chunk[-.][\w-]*(?:\.js|\.mjs|\.css)?$|[.-][0-9a-f]{8,}\.(?:chunk\.)?(?:js|mjs|css)$"
# Names of tables kept as code.
DATA_NAMES = r"(?:^|[_-])(?:blob|data|lookup|table)(?:[_-][0-9a-z]+)?\.\w+$"
# The standard marks of generated files, from which the generators' names are mined.
GENERATED_MARKS = [r"@generated\b", r"<auto-?generated", r"\bcode generated (?:by|from|with)\b.*\bdo not edit"]
# Fixed value: how a header names its generator.
GENERATOR = r"\b(?:generated|created|produced|written) (?:by|with|from) (?:the )?([a-z][a-z0-9_-]{2,})"
# Conventional notices of generated files.
GENERATED_NOTICES = [
    r"\bauto-?generated (?:file|code|by|from|source)", r"\bautomatically (?:generated|created|produced|written) (?:by|from|with|using)",
    r"\bcode generated (?:by|from|with)\b", r"\bgenerated (?:source|file|code)\b\s*[:;,.-]", r"\bmachine[- ](?:made|generated|written)\b",
    r"\bthis (?:file|code|source) (?:was|is|has been) (?:auto\w*[ -])?(?:produced|generated) (?:by|from|with|using)\b",
    r"\b(?:manual )?(?:edits|changes) (?:are|will be|get) (?:overwritten|lost|discarded)",
    r"\bdo not (?:edit|modify|change)(?: this file| by hand| manually| directly)?\s*(?:[.!;]|-|\*|$)", r"\bgenerated by (?:the )?[\w.-]+ (?:compiler|generator)\b",
]
# Conventional notices of copies of other projects' files.
VENDOR_NOTICES = [
    r"\boriginally (?:part of|from|taken from) [\w@/.-]+ v?\d", r"\bredistributed under\b", r"\bcopied (?:without changes|verbatim|unmodified)\b", r"\bupstream: [\w@/.-]+ v?\d",
    r"\bkept in sync with (?:its )?upstream\b", r"(?:^|\s)[\w@/.-]+ v?\d+\.\d+[\w.-]* \| (?:\(c\)|copyright|mit\b|licen)", r"(?:^|\s)[\w@/.-]+ v?\d+\.\d+[\w.-]* https?://\S*licen[cs]e",
    r"(?:^|\s)[\w@/.-]+ v?\d+\.\d+[\w.-]* (?:\(c\)|©|copyright) ", r"(?:^|\s)@license\b",
]

_VERSIONED = r"^([a-z][a-z0-9_-]*?)-v?\d+\.\d+(?:\.\d+)*$"
_COMMENT = r"(?://[^\n]*|#[^\n]*|--[^\n]*|;[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')"
# Languages of documents and settings, in which data is at home.
NO_CODE = ["yaml", "json", "toml", "markdown", "text", "plaintext", "csv", "xml"]
_NO_CODE_NAMES = r"\.(?:ya?ml|jsonl?|toml|mdx?|txt|rst|csv|tsv|xml|ini|cfg|lock)$"
#: Repositories in which a pattern must be seen before it counts.
MIN_ROOTS = 2
#: Share of evidence among the files with a pattern that must be sure, and how many standard errors make it so. Elsewhere
#: a few files in a hundred are generated; under a generator's folder at least every third shows it.
SURE_SHARE, ERRORS = 0.15, 2.6
#: Share of packed files from which an ending of names is one of minified files, and the least number of them.
PACKED_SHARE, MIN_PACKED = 0.8, 3
#: Share of libraries among what stands right below a folder from which it is one for vendored files.
LIBRARY_SHARE = 0.5
#: Words of a header phrase.
PHRASE_WORDS = 3


# -- attribute files ---------------------------------------------------------
def glob_regex(glob: str) -> str:
    """A gitattributes pattern, relative to its file's folder, as a regular expression over paths from there.

    Without a slash (but for one at the end) it fits names at any depth, else
    the path from the folder on. ``**`` spans folders. A pattern for a folder
    only, ending in a slash, fits nothing, as attributes belong to files.
    """
    anchored = "/" in glob.rstrip("/")
    body, out, k = glob.lstrip("/"), "", 0
    if body.endswith("/"):
        return r"(?!)"
    while k < len(body):
        c = body[k]
        if body.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif body.startswith("**", k):
            out, k = out + ".*", k + 2
        elif c == "*":
            out, k = out + "[^/]*", k + 1
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and "]" in body[k + 2:]:
            end = body.index("]", k + 2)
            inner = body[k + 1:end]
            negated = inner[:1] in "!^"
            inner = inner[1:] if negated else inner
            out, k = out + "[" + ("^/" if negated else "") + inner.replace("\\", r"\\").replace("[", r"\[").replace("&", r"\&") + "]", end + 1
        else:
            out, k = out + re.escape(c), k + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$"


def attribute_rules(contents: DataFrame, root_col: str = "root", path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(root_path, folder, line_no, pattern, kind, value): what the attribute files declare about generated and vendored files.

    kind is ``generated`` or ``vendored``; value false takes a mark back. The
    files are few and small, which is why their globs are translated row by row.
    """
    @F.pandas_udf("string")
    def translate(globs: pd.Series) -> pd.Series:
        return globs.map(glob_regex)

    files = contents.where(F.col(path_col).rlike(r"(?:^|/)\.gitattributes$") & F.col(content_col).isNotNull() & F.col(root_col).isNotNull())
    lines = files.select(
        F.col(root_col).alias("root_path"), F.regexp_extract(path_col, r"^(.*?)/?\.gitattributes$", 1).alias("folder"),
        F.posexplode(F.split(F.regexp_replace(content_col, "^\ufeff", ""), r"\r?\n", -1)).alias("line_no", "line"),
    )
    parts = F.split(F.trim(F.col("line")), r"\s+")
    marks = lines.where(~F.col("line").rlike(r"^\s*(?:#|$)")).select(
        "root_path", "folder", "line_no", F.get(parts, F.lit(0)).alias("glob"), F.explode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("mark")
    )
    found = F.regexp_extract("mark", r"^([-!]?)(?:linguist-)?(generated|vendored)(?:=(.*))?$", 2)
    value = ~F.regexp_extract("mark", r"^([-!]?)", 1).isin("-", "!") & ~F.lower(F.regexp_extract("mark", r"=(.*)$", 1)).isin("false", "0", "no")
    rules = marks.withColumn("kind", found).where("kind <> ''").withColumn("value", value)
    return rules.select("root_path", "folder", "line_no", translate("glob").alias("pattern"), "kind", "value").distinct()


def declared(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(root_path, path, kind, value): for each file and kind the mark of the deepest folder's last line that fits."""
    folders = F.split(F.regexp_extract("path", r"^(?:(.*)/)?[^/]*$", 1), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(folders)), lambda k: F.array_join(F.slice(folders, F.lit(1), k), "/"))
    at = files.select("root_path", "path", F.explode(F.array_distinct(above)).alias("folder"))
    met = join_small_or_salted(at, rules, ["root_path", "folder"])
    below = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    met = met.withColumn("_below", below).where("_below RLIKE pattern")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return (
        met.groupBy("root_path", "path", "kind").agg(F.max(F.struct(depth.alias("depth"), "line_no", "value")).alias("m"))
        .select("root_path", "path", "kind", F.col("m.value").alias("value"))
    )


# -- patterns ----------------------------------------------------------------
def _folders(path: Column) -> Column:
    """Lower-case names of the folders of a path."""
    return F.filter(F.split(F.lower(F.regexp_extract(path, r"^(?:(.*)/)?[^/]*$", 1)), "/"), lambda x: x != "")


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def without_header(text: Column) -> Column:
    """A text without the comments at its top, however many they are."""
    return F.regexp_replace(text, rf"\G\s*(?:{_COMMENT})\s*", "")


def header_text(text: Column) -> Column:
    """The comments at the top of a file as one lower-case line without comment marks."""
    top = F.substring(text, F.lit(1), F.length(text) - F.length(without_header(text)))
    bare = F.regexp_replace(top, r"(?m)^\s*(?://+!?|#+!?|/\*+!?|\*+/?|--+|;+|<!--)|\*+/|-->|[-=*_]{4,}", " ")
    return F.trim(F.regexp_replace(F.lower(bare), r"\s+", " "))


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _packed(body: Column) -> Column:
    """Long lines with hardly any white space and much punctuation."""
    longest = F.array_max(F.transform(F.split(body, "\n"), lambda x: F.length(x)))
    n = F.greatest(F.length(body), F.lit(1))
    blank = F.length(F.regexp_replace(body, r"\S", "")) / n
    signs = F.length(F.regexp_replace(body, r"[\w\s]", "")) / n
    return (longest >= 250) & (blank < 0.12) & (signs > 0.15)


def _data(body: Column) -> Column:
    """Tables of numbers, or a literal that runs on without white space."""
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    # the last line may be cut off
    whole = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(1)))
    number = r"[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[uUlLfF]?"
    row = rf"""^\s*+(?:["']?[\w.-]++["']?\s*+[:=]\s*+)?[\[({{]*+\s*+{number}(?:(?:\s*+[,;]\s*+|\s++){number})++\s*+[\])}}]*+[,;]?\s*+$"""
    rows = F.size(F.filter(whole, lambda x: x.rlike(row)))
    table = (rows >= 4) & (rows >= 0.8 * (F.size(whole) - 1))
    blob = body.rlike(r"""["'`][A-Za-z0-9+/=_\\-]{200,}""")
    return table | blob


# -- mining ------------------------------------------------------------------
_ID = ["root_path", "path"]
_HEAD_WORD = r"([a-z][a-z0-9_-]*)"


def observed(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(root_path, path, language, line_count, has, head, packed, data), one row per file of `files`.

    What a content shows is worked out where it is read; contents themselves
    are never shuffled. Of several contents of a file that with the greatest
    hash counts, of several scans the greatest line count.
    """
    known = (
        files.where("root_path IS NOT NULL AND path IS NOT NULL").groupBy(*_ID)
        .agg(F.max("line_count").alias("line_count"), F.max(F.lower("language")).alias("language"))
    )
    text = F.regexp_replace("content", "^\ufeff|\r", "")
    kept = spread(contents.where("root IS NOT NULL AND path IS NOT NULL AND content IS NOT NULL").select("root", "path", "content"))
    kept = kept.select(F.col("root").alias("root_path"), "path", text.alias("_text"))
    body = without_header(F.col("_text"))
    shown = kept.select(*_ID, F.struct(F.xxhash64("_text").alias("h"), header_text(F.col("_text")).alias("head"), _packed(body).alias("packed"), _data(body).alias("data")).alias("_s"))
    one = shown.groupBy(*_ID).agg(F.max("_s").alias("_s"))
    return known.join(one, _ID, "left").select(
        *_ID, "language", "line_count", F.col("_s").isNotNull().alias("has"), F.coalesce("_s.head", F.lit("")).alias("head"), *[F.coalesce(f"_s.{c}", F.lit(False)).alias(c) for c in ("packed", "data")]
    )


def versioned(folders: Column) -> Column:
    """Names of libraries in the names of folders that end in a version."""
    return F.filter(F.transform(folders, lambda x: F.regexp_extract(x, _VERSIONED, 1)), lambda x: x != "")


def _in_several(found: DataFrame, name: str, min_roots: int) -> DataFrame:
    """Names seen in at least `min_roots` repositories; `found` has root_path and name."""
    return found.distinct().groupBy(name).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_roots).select(name)


def mined_libraries(files: DataFrame, min_roots: int = MIN_ROOTS) -> DataFrame:
    """(library): names that folders carry with a version, or right below a vendor folder, in at least `min_roots` repositories.

    Only names that are found with a version somewhere count: folders such as
    ``src`` stand below vendor folders too.
    """
    d = _folders(F.col("path"))
    vendor = F.array(*map(F.lit, VENDOR_DIRS))
    below = F.filter(F.transform(d, lambda x, k: F.when((k > 0) & F.array_contains(vendor, F.get(d, k - 1)), x)), lambda x: x.isNotNull())
    mark = lambda names, v: F.transform(names, lambda x: F.struct(x.alias("library"), F.lit(v).alias("v")))
    seen = files.select("root_path", F.explode(F.concat(mark(versioned(d), 1), mark(below, 0))).alias("_s"))
    each = seen.groupBy("_s.library", "root_path").agg(F.max("_s.v").alias("v")).groupBy("library").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v"))
    return each.where((F.col("n") >= min_roots) & (F.col("v") == 1)).select("library")


def vendor_folders(files: DataFrame, libraries: DataFrame, min_roots: int = MIN_ROOTS, share: float = LIBRARY_SHARE) -> DataFrame:
    """(folder): folders below which at least `share` of the files stand in a library's folder, in several repositories."""
    d = _folders(F.col("path"))
    pairs = files.select("root_path", F.explode(F.transform(d, lambda x, k: F.struct(x.alias("folder"), F.get(d, k + 1).alias("child")))).alias("_p")).select("root_path", "_p.*")
    counts = pairs.groupBy("root_path", "folder", "child").agg(F.count(F.lit(1)).alias("n"))
    known = libraries.select(F.col("library").alias("child"), F.lit(True).alias("_lib"))
    each = counts.join(known, "child", "left").groupBy("folder", "root_path").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_lib"), F.col("n")).otherwise(0)).alias("k"))
    sums = each.groupBy("folder").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count_if(F.col("k") > 0).alias("roots"))
    return sums.where((F.col("k") >= share * F.col("n")) & (F.col("roots") >= min_roots)).select("folder")


def path_features(path: Column) -> Column:
    """ARRAY<STRUCT(type, value)>: what a path may be known by: its folders, the last part of its name, its last capital word."""
    name = _name(path)
    tail = F.regexp_extract(F.lower(name), r"([._-][a-z][^._-]*\.[a-z0-9]+)$", 1)
    capital = F.regexp_extract(name, r"[a-z0-9]([A-Z][a-z]+\.[a-z]+)$", 1)
    named = F.array(F.struct(F.lit("tail").alias("type"), tail.alias("value")), F.struct(F.lit("capital").alias("type"), capital.alias("value")))
    folders = F.transform(F.array_distinct(_folders(path)), lambda x: F.struct(F.lit("folder").alias("type"), x.alias("value")))
    return F.filter(F.concat(folders, named), lambda x: x["value"] != "")


def header_phrases(head: Column) -> Column:
    """Distinct runs of `PHRASE_WORDS` words of a header; the whole header if it has fewer."""
    words = F.regexp_extract_all(head, F.lit(_HEAD_WORD), F.lit(1))
    runs = words
    for k in range(2, PHRASE_WORDS + 1):  # word by word, so that no word list is made anew for each of its words
        runs = F.zip_with(runs, F.slice(words, F.lit(k), F.greatest(F.size(words), F.lit(1))), lambda x, y: F.concat_ws(" ", x, y))
    return F.array_distinct(F.slice(runs, F.lit(1), F.greatest(F.size(words) - (PHRASE_WORDS - 1), F.lit(1))))


def _sure(k: str, n: str, z: float = ERRORS) -> Column:
    """Lower bound of a share, `z` standard errors below what was seen (Wilson's)."""
    p, size = F.col(k) / F.col(n), F.col(n)
    return (p + z * z / (2 * size) - z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size))) / (1 + z * z / size)


def _far_above(usual: float | None) -> float:
    """The share from which evidence is more than the usual one."""
    return max(SURE_SHARE, 2 * (usual or 0.0))


def _evidence(found: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """(by, n, and for each flag k_<flag> and roots_<flag>): rows, rows with the flag, and repositories with such rows."""
    each = found.groupBy(*by, "root_path").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f)).alias(f"k_{f}") for f in flags])
    return each.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(f"k_{f}").alias(f"k_{f}") for f in flags], *[F.count_if(F.col(f"k_{f}") > 0).alias(f"roots_{f}") for f in flags])


def _flagged(base: DataFrame, hits: DataFrame, flag: str) -> DataFrame:
    """`base` with a column that says whether `hits` (root_path, path) names the file."""
    return base.join(hits.distinct().withColumn("_hit", F.lit(True)), _ID, "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_hit")


def mined(files: DataFrame, min_roots: int = MIN_ROOTS) -> DataFrame:
    """(root_path, path, vendors, generates, minifies): what the mined patterns say of each file of `observed`.

    `files` is read several times; cut its lineage first. Each pattern is
    counted over all files; only patterns leave a count, and the few that are
    found are broadcast if their number is small, else joined by shuffle.
    """
    # vendored: libraries, their folders, and headers that name one with a version
    libraries = cut_lineage(mined_libraries(files, min_roots))
    folders = vendor_folders(files, libraries, min_roots)
    vendor = libraries.select(F.col("library").alias("value")).unionByName(folders.select(F.col("folder").alias("value"))).distinct().select(F.lit("folder").alias("type"), "value", F.lit("vendors").alias("says"))
    named = F.regexp_extract_all("head", F.lit(r"(?<![\w-])([a-z][\w-]*)[ @(]+v?\d+\.\d"), F.lit(1))
    releases = files.where(F.col("head").rlike(r"\d\.\d")).select(*_ID, F.explode(F.array_distinct(named)).alias("library")).join(broadcast_if_small(libraries), "library", "left_semi")

    # generated: marks name generators; generators' names, folders and endings, phrases
    marked = files.withColumn("mark", F.col("head").rlike(_any(GENERATED_MARKS)))
    makers = marked.where("mark").select("root_path", F.explode(F.regexp_extract_all("head", F.lit(GENERATOR), F.lit(1))).alias("word"))
    makers = broadcast_if_small(cut_lineage(_in_several(makers, "word", min_roots)))
    words = F.array_distinct(F.regexp_extract_all("head", F.lit(_HEAD_WORD), F.lit(1)))
    made = files.where("head <> ''").select(*_ID, F.explode(words).alias("word")).join(makers, "word", "left_semi")
    shown = cut_lineage(_flagged(marked, made, "made").withColumn("made", F.col("mark") | F.col("made")))
    features = shown.select(*_ID, "has", "made", "packed", F.explode(path_features(F.col("path"))).alias("_f")).select(*_ID, "has", "made", "packed", "_f.*")
    counts = _evidence(features.where("has"), ["type", "value"], ["made", "packed"])
    usual, usual_head = shown.agg(F.avg(F.when(F.col("has"), F.col("made").cast("int"))), F.avg(F.when(F.col("head") != "", F.col("made").cast("int")))).first()
    makes = (_sure("k_made", "n") >= _far_above(usual)) & (F.col("roots_made") >= min_roots)
    packs = (F.col("type") != "folder") & (F.col("k_packed") >= PACKED_SHARE * F.col("n")) & (F.col("k_packed") >= MIN_PACKED) & (F.col("roots_packed") >= min_roots)
    says = F.when(packs, "minifies").when(makes, "generates")
    paths = cut_lineage(counts.select("type", "value", says.alias("says")).where("says IS NOT NULL").unionByName(vendor))
    by_path = cut_lineage(features.select(*_ID, "type", "value").join(broadcast_if_small(paths), ["type", "value"]).select(*_ID, "says").distinct())
    placed = _flagged(shown.where("head <> ''").select(*_ID, "head"), by_path.where("says = 'generates'").select(*_ID), "placed")
    phrases = placed.select(*_ID, "placed", F.explode(header_phrases(F.col("head"))).alias("phrase"))
    told = cut_lineage(_evidence(phrases, ["phrase"], ["placed"]).where((_sure("k_placed", "n") >= _far_above(usual_head)) & (F.col("roots_placed") >= min_roots)).select("phrase"))
    by_phrase = phrases.join(broadcast_if_small(told), "phrase", "left_semi")

    hits = by_path
    for found, what in ((releases, "vendors"), (shown.where("made"), "generates"), (by_phrase, "generates")):
        hits = hits.unionByName(found.select(*_ID, F.lit(what).alias("says")))
    return hits.groupBy(*_ID).agg(*[F.bool_or(F.col("says") == w).alias(w) for w in ("vendors", "generates", "minifies")])


def classify(files: DataFrame, contents: DataFrame, rules: DataFrame | None = None, min_roots: int = MIN_ROOTS) -> DataFrame:
    """(root_path, path, kind, reason): one row per file, kind null for what is written by hand.

    `files` has root_path, path, language and line_count, one row per file and
    scan; `contents` has root, path and content. kind is ``generated``,
    ``minified``, ``vendored`` or ``data``; reason says by what: what the
    repository declares, mined patterns, content, and conventional names, in
    this order. Files without content are judged by path and line count. A
    declared false mark takes its kind back. Null roots and paths are left
    out.
    """
    base = cut_lineage(observed(files, contents))
    rules = cut_lineage(attribute_rules(contents)) if rules is None else rules
    marks = declared(base, rules).groupBy(*_ID).agg(
        F.max(F.when(F.col("kind") == "generated", F.col("value"))).alias("says_generated"), F.max(F.when(F.col("kind") == "vendored", F.col("value"))).alias("says_vendored"),
    )
    joined = base.join(marks, _ID, "left").join(mined(base, min_roots), _ID, "left")
    path, folders, name, head = F.col("path"), _folders(F.col("path")), _name(F.col("path")), F.col("head")
    script, no_text = F.lower(name).rlike(r"\.(?:js|mjs|cjs)$"), ~F.col("has")
    code = ~F.lower(name).rlike(_NO_CODE_NAMES) & ~F.coalesce(F.col("language"), F.lit("")).isin(NO_CODE)
    # a mark that is taken back rules its kind out, not the others
    vendor, generated = (F.coalesce(F.col(f"says_{k}"), F.lit(True)) for k in ("vendored", "generated"))
    numbers = code & no_text & (F.col("line_count") >= 2000)
    reason = (
        F.when(F.col("says_vendored"), "vendored:declared")
        .when(F.col("says_generated"), "generated:declared")
        .when(vendor & F.col("vendors"), "vendored:mined")
        .when(generated & F.col("generates"), "generated:mined")
        .when(F.col("minifies"), "minified:mined")
        .when(code & F.col("data"), "data:content")
        .when(F.col("packed"), "minified:content")
        .when(vendor & (F.size(versioned(folders)) > 0), "vendored:version")
        .when(vendor & F.arrays_overlap(folders, F.array(*map(F.lit, VENDOR_DIRS))), "vendored:folder")
        .when(vendor & head.rlike(_any(VENDOR_NOTICES)), "vendored:notice")
        .when(generated & F.arrays_overlap(folders, F.array(*map(F.lit, GENERATED_DIRS))), "generated:folder")
        .when(generated & name.rlike(f"(?i){GENERATED_NAMES}"), "generated:name")
        .when(generated & head.rlike(_any(GENERATED_MARKS + GENERATED_NOTICES)), "generated:notice")
        .when(F.lower(name).rlike(MINIFIED_NAMES), "minified:name")
        .when(no_text & script & (F.col("line_count") <= 5), "minified:lines")
        .when(numbers & (F.lower(name).rlike(DATA_NAMES) | F.array_contains(folders, "data") | F.array_contains(folders, "resources")), "data:lines")
        .when(code & no_text & F.lower(name).rlike(DATA_NAMES) & (F.col("line_count") <= 5), "data:name")
    )
    return joined.select(*_ID, F.split_part(reason, F.lit(":"), F.lit(1)).alias("kind"), reason.alias("reason"))
