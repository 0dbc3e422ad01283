"""Queries on ranking, packing, code units, symbols, imports and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass import config
from lodeglass.functions import text
from lodeglass.functions.text import code_tokens, content_hash, lines_of, query_terms
from lodeglass.operators import chunk, diff, graph, incremental, parse, rank, sessions, symbols
from lodeglass.plans import samples
from lodeglass.plans import sqltext as q
from lodeglass.session import cut_lineage, spread, table
from lodeglass.sources.files import distinct_files, file_lines

QUERY = "token budget of the retryQueue"
NAMED, FIND, READ_BUDGET = "group_session", "import_edge", 150
KEYS = ["root", "path"]


def _code(spark: SparkSession, d: str) -> DataFrame:
    return distinct_files(table(spark, d, "code_files").select("root", "path", "content").unionByName(samples.frame(spark)))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the pieces of files; pieces delivered again are still there."""
    rows = spread(table(spark, d, "file_chunks").where("content IS NOT NULL").select("path", F.col("chunk_no").alias("part"), "content"))
    return chunk.chunks(rows, ["path", "part"], chunk.window_spans)


# -- ranking -----------------------------------------------------------------
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return rank.document_frequencies(docs, "doc_id", "text")


def bm25_collection(spark: SparkSession, d: str) -> DataFrame:
    return rank.collection_stats(table(spark, d, "documents"), "text").select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_rank(spark: SparkSession, d: str) -> DataFrame:
    return rank.ranked(spread(table(spark, d, "documents").select("doc_id", "text")), "text", QUERY).select("doc_id", F.round("score", 6).alias("score"))


def chunk_rank(spark: SparkSession, d: str) -> DataFrame:
    found = rank.chunk_scores(_parts(spark, d), ["path"], ["part", "chunk_no"], "text", QUERY)
    return found.select("path", "part", "chunk_no", F.round("score", 6).alias("score"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of files with what ranking looks at; pieces delivered again are still there."""
    rows = table(spark, d, "file_chunks").where("content IS NOT NULL").select("path", "chunk_no", "start_line", "chunk_type", "identifier", "content")
    return spread(rows).withColumnRenamed("content", "text")


def chunk_rerank(spark: SparkSession, d: str) -> DataFrame:
    return rank.reranked(_units(spark, d).distinct(), ["path"], "retry queue parser").select("path", "chunk_no", F.round("score", 6).alias("score"))


def smart_read(spark: SparkSession, d: str) -> DataFrame:
    return rank.smart_read(_units(spark, d), ["path"], "retry queue parser").select("path", "chunk_no", F.round("score", 6).alias("score"), "tokens", "used")


def budget_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), "doc_id", code_tokens("text").alias("tokens"))
    return rank.packed(docs, ["source"], [F.col("tokens").desc(), F.col("doc_id")], "tokens", 20_000)


# -- code units --------------------------------------------------------------
def _exploded(files: DataFrame, array, fields: str = "name, start_line, end_line") -> DataFrame:
    found = files.select(*KEYS, F.explode(array).alias("_u"))
    return found.select(*KEYS, *[F.col(f"_u.{x.strip()}") for x in fields.split(",")])


def extract_functions_ts(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_code(spark, d).where("language IN ('typescript', 'javascript')"), parse.brace_functions(lines_of("content")))


def extract_classes_ts(spark: SparkSession, d: str) -> DataFrame:
    found = _exploded(_code(spark, d).where("language IN ('typescript', 'javascript')"), parse.brace_classes(lines_of("content")), "name, start_line, end_line, methods")
    return found.withColumn("methods", F.array_join("methods", ","))


def extract_interfaces_types(spark: SparkSession, d: str) -> DataFrame:
    files = _code(spark, d).where("language IN ('typescript', 'javascript')")
    kinds = [("interface", parse.INTERFACE), ("type", parse.TYPE), ("enum", parse.ENUM)]
    found = [files.select(*KEYS, F.lit(k).alias("kind"), F.explode(parse.named_lines(lines_of("content"), p)).alias("_u")) for k, p in kinds]
    both = found[0].unionByName(found[1]).unionByName(found[2])
    return both.select(*KEYS, "kind", "_u.name", F.col("_u.at").alias("line"))


def extract_functions_py(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_code(spark, d).where("language = 'python'"), parse.indent_functions(lines_of("content")))


def extract_classes_py(spark: SparkSession, d: str) -> DataFrame:
    found = _exploded(_code(spark, d).where("language = 'python'"), parse.indent_classes(lines_of("content")), "name, start_line, end_line, methods")
    return found.withColumn("methods", F.array_join("methods", ","))


def extract_generic_sigs(spark: SparkSession, d: str) -> DataFrame:
    files = _code(spark, d).where("language NOT IN ('typescript', 'javascript', 'python')")
    return files.select(*KEYS, F.posexplode(parse.signatures(lines_of("content"), F.col("language"))).alias("position", "signature"))


def extract_imports(spark: SparkSession, d: str) -> DataFrame:
    return graph.import_edges(_code(spark, d), KEYS)


def unit_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many functions and free classes each file has."""
    units = chunk.index_chunks(_code(spark, d), KEYS).where("chunk_type IN ('function', 'class')")
    return units.groupBy(*KEYS, "chunk_type").agg(F.count(F.lit(1)).alias("n"), F.sum("start_line").alias("starts"), F.sum("end_line").alias("ends"))


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    found = chunk.index_chunks(_code(spark, d), KEYS)
    return found.select(*KEYS, "chunk_no", "start_line", "end_line", "chunk_type", "identifier", F.md5("text").alias("digest"))


def function_extract(spark: SparkSession, d: str) -> DataFrame:
    found = chunk.extract_by_name(chunk.index_chunks(_code(spark, d), KEYS), NAMED, KEYS)
    return found.select(*KEYS, "start_line", "end_line", "identifier")


def function_extract_best(spark: SparkSession, d: str) -> DataFrame:
    """The unit of that name in every file, or else the file's best chunk for it."""
    found = chunk.extract(chunk.index_chunks(_code(spark, d), KEYS), NAMED, KEYS)
    return found.select(*KEYS, "start_line", "end_line", "identifier", "exact")


def smart_read_files(spark: SparkSession, d: str) -> DataFrame:
    """Every file as a first read gives it: whole if it is within the budget, else the units that answer the query; a size in tokens beside it."""
    files = _code(spark, d).withColumn("content", text.redacted("content")).withColumn("total", code_tokens("content"))
    plan = sessions.read_plan(F.lit("unread"), F.col("total"), READ_BUDGET)
    files = files.withColumn("plan", plan)
    whole = files.where("plan = 'whole'").select(*KEYS, "plan", F.lit(None).cast("int").alias("chunk_no"), "total", F.col("total").alias("tokens"))
    large = files.where("plan = 'chunks'")
    kept = rank.smart_read(chunk.index_chunks(large, KEYS), KEYS, "load session config", READ_BUDGET)
    cut = kept.select(*KEYS, F.lit("chunks").alias("plan"), "chunk_no", "tokens")
    return whole.unionByName(cut.join(large.select(*KEYS, "total"), KEYS))


def whole_units(spark: SparkSession, d: str) -> DataFrame:
    """Functions of script files with their whole extents, however long."""
    return _exploded(_code(spark, d).where("language IN ('typescript', 'javascript')"), parse.brace_functions(lines_of("content"), None))


# -- symbols -----------------------------------------------------------------
def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    return symbols.catalogue(_code(spark, d), KEYS)


def symbol_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return _catalogue(spark, d)


def _paths(symbols_: DataFrame) -> DataFrame:
    return symbols_.withColumn("path", F.concat_ws("/", "root", "path")).drop("root")


def symbol_find(spark: SparkSession, d: str) -> DataFrame:
    return symbols.find(_paths(_catalogue(spark, d)), FIND, limit=400).select("path", "name", "kind", "line", "bucket")


def symbol_find_kind(spark: SparkSession, d: str) -> DataFrame:
    """Functions of Python files below the root with most files."""
    rows = _paths(_catalogue(spark, d))
    top = table(spark, d, "code_files").groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "root").first()
    return symbols.find(rows, FIND, kind="function", language="python", root=top["root"] if top else None, limit=400).select("path", "name", "kind", "line", "bucket")


def symbol_outline(spark: SparkSession, d: str) -> DataFrame:
    """The outline of the file with most symbols."""
    rows = cut_lineage(_paths(_catalogue(spark, d)).select("path", "name", "kind", "line", "end_line"))
    top = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "path").first()
    return symbols.outline(rows, top["path"] if top else "")


def symbol_files_stats(spark: SparkSession, d: str) -> DataFrame:
    """Files, symbols and the last time of indexing of each root, as the runs that succeeded left them."""
    good = incremental.final_status(table(spark, d, "index_runs")).where("status = 'ok'").select("run_id")
    rows = table(spark, d, "symbol_files").join(F.broadcast(good), "run_id", "left_semi")  # one row per run
    return symbols.file_stats(rows, ["root_path"])


def symbol_invalidate(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by language after the first file by name was invalidated."""
    rows = cut_lineage(_paths(_catalogue(spark, d)).select("path", "language"))
    first = rows.agg(F.min("path")).first()[0]
    return symbols.without_file(rows, first or "").groupBy("language").agg(F.count(F.lit(1)).alias("symbols"))


def symbol_stats(spark: SparkSession, d: str) -> DataFrame:
    return symbols.counts(_catalogue(spark, d))


def _older(files: DataFrame) -> DataFrame:
    """An older state, in which every third file had no last line and every seventh wasn't there."""
    cut = F.when(F.pmod(F.length("content"), F.lit(3)) == 0, F.regexp_replace("content", r"\n?[^\n]*\z", "")).otherwise(F.col("content"))
    return files.where(F.pmod(F.length("content"), F.lit(7)) > 0).withColumn("content", cut)


def incremental_index(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue after a refresh from an older state."""
    files = _code(spark, d).select(F.concat_ws("/", "root", "path").alias("path"), "language", "content")
    before = _older(files)
    state, _ = symbols.refresh(files, symbols.catalogue(before, ["path"]), before.select("path", content_hash("content").alias("hash")))
    sums = [F.sum(F.col(c).cast("bigint")).alias(f"{c}s") for c in ("line", "end_line")]
    return state.groupBy("language", "kind").agg(F.count(F.lit(1)).alias("symbols"), *sums, F.sum(F.length("signature").cast("bigint")).alias("chars"))


def incremental_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many files a refresh scans, indexes, finds new, changed, unchanged and gone."""
    files = _code(spark, d).select(F.concat_ws("/", "root", "path").alias("path"), "content")
    gone = files.where(F.pmod(F.length("content"), F.lit(5)) > 0)
    return symbols.changed_counts(gone, _older(files).select("path", content_hash("content").alias("hash")))


# -- graph -------------------------------------------------------------------
def link_in_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degree(graph.import_edges(_code(spark, d), KEYS))


def link_sources(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.import_edges(_code(spark, d), KEYS).withColumn("file", F.concat_ws("/", "root", "path"))
    return graph.sources_of(edges, "file")


def most_imported(spark: SparkSession, d: str) -> DataFrame:
    return graph.most_imported(graph.import_edges(_code(spark, d), KEYS))


def resolve_imports(spark: SparkSession, d: str) -> DataFrame:
    """The files that relative imports mean, among the files of the code table and the project map."""
    listed = table(spark, d, "code_files").select(*KEYS).unionByName(table(spark, d, "project_map").select(F.col("root_path").alias("root"), "path"))
    return graph.resolved(graph.import_edges(_code(spark, d), KEYS), listed.unionByName(samples.frame(spark).select(*KEYS)))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "code_files").select(*KEYS).unionByName(table(spark, d, "project_map").select(F.col("root_path").alias("root"), "path"))
    return listed.unionByName(samples.frame(spark).select(*KEYS)).where("path IS NOT NULL")


def project_graph(spark: SparkSession, d: str) -> DataFrame:
    """All files with code and all modules that they name, with imports both ways."""
    code = _code(spark, d)
    return graph.project_nodes(graph.import_edges(code, KEYS), code)


def file_graph(spark: SparkSession, d: str) -> DataFrame:
    """What the files that import something relative lead to within two steps."""
    edges = graph.import_edges(_code(spark, d), KEYS)
    start = edges.where(F.col("target").startswith(".")).select(F.concat_ws("/", "root", "path").alias("node")).distinct()
    return graph.file_graph(edges, _listed(spark, d), start, 2)


def reach_depth2(spark: SparkSession, d: str) -> DataFrame:
    """From the customers of one market segment over their nations to regions, and back no further."""
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    edges = customer.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("dst")).union(
        nation.select(F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("r"), F.col("n_regionkey")))
    )
    start = customer.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"))
    return graph.reachable(edges, start, 2)


# -- differences -------------------------------------------------------------
def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Texts, and the same with every fifth line gone and a closing line."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    kept = F.filter(lines_of("text"), lambda x, k: k % 5 != 4)
    return docs, docs.select("doc_id", F.concat(F.array_join(kept, "\n"), F.lit("\nend of text")).alias("text"))


def line_diff(spark: SparkSession, d: str) -> DataFrame:
    before, after = (file_lines(x, ["doc_id"], "text") for x in _versions(spark, d))
    return diff.line_changes(before, after, ["doc_id"])


def line_diff_counts(spark: SparkSession, d: str) -> DataFrame:
    before, after = (file_lines(x, ["doc_id"], "text") for x in _versions(spark, d))
    return diff.changed_lines(before, after, ["doc_id"])


def diff_hunks(spark: SparkSession, d: str) -> DataFrame:
    before, after = _versions(spark, d)
    pairs = before.withColumnRenamed("text", "before").join(after.withColumnRenamed("text", "after"), "doc_id")
    return diff.hunks(pairs, ["doc_id"])


# -- SQL ---------------------------------------------------------------------
_TERMS = query_terms(QUERY)
_LANG = q.language("path")
_SRC = f"src AS (SELECT root, path, {_LANG} AS language, content FROM cf)"


def _bm25(rows: str, keys: str, group: str, terms: list[str]) -> str:
    """CTEs up to `scored` over `rows` (keys, toks); every group is a collection; group is '' for the whole."""
    part = f"PARTITION BY {group}" if group else ""
    fs = ", ".join(f"len(list_filter(toks, lambda x: x = '{t}')) AS f{k}" for k, t in enumerate(terms))
    dfs = ", ".join(f"sum(CASE WHEN f{k} > 0 THEN 1 ELSE 0 END) OVER ({part}) AS d{k}" for k in range(len(terms)))
    one = "CASE WHEN f{k} > 0 THEN ln(1 + (n - d{k} + 0.5) / (d{k} + 0.5)) * f{k} * 2.5 / (f{k} + 1.5 * (0.25 + 0.75 * (dl / greatest(a, 1.0)))) ELSE 0 END"
    total = " + ".join(one.format(k=k) for k in range(len(terms)))
    return f"""{rows}, counted AS (SELECT *, len(toks) AS dl, {fs} FROM rows),
    stated AS (SELECT *, count(*) OVER ({part}) AS n, avg(dl) OVER ({part}) AS a, {dfs} FROM counted), scored AS (SELECT *, {total} AS bm FROM stated)"""


_WIN = "SELECT path, part, chunk_no, array_to_string(ls[i + 1:i + 60], chr(10)) AS text FROM (SELECT path, part, generate_subscripts(s, 1) AS chunk_no, unnest(s) AS i, ls FROM (SELECT path, part, ls, range(0, len(ls), 50) AS s FROM (SELECT DISTINCT path, chunk_no AS part, string_split(content, chr(10)) AS ls FROM file_chunks WHERE content IS NOT NULL)))"
_RETRY = query_terms("retry queue parser")
_CHUNKS = "SELECT DISTINCT path, chunk_no, start_line, chunk_type, identifier, content AS text FROM file_chunks WHERE content IS NOT NULL"
_NAMED = "CASE WHEN coalesce(identifier, '') <> '' THEN identifier || ' ' ELSE '' END || text"
_PACK = "SELECT *, sum(tokens) OVER (PARTITION BY {g} ORDER BY {o} ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM {t} QUALIFY used <= {m}"


def _header(patterns: list[str], barred: list[str]) -> str:
    bars = ", ".join(f"'{x}'" for x in barred) or "''"
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_extract(line, '{p.replace(chr(39), chr(39) * 2)}', 1) NOT IN ('', {bars}) THEN regexp_extract(line, '{p.replace(chr(39), chr(39) * 2)}', 1) END" for p in patterns) + ")"


def _brace(patterns: list[str], barred: list[str]) -> str:
    """Spans by running sums over each header's next lines."""
    t = q.trim("line")
    return f"""
    WITH {q.CF}, {_SRC}, l AS ({q.lines("(SELECT * FROM src WHERE language IN ('typescript', 'javascript'))", "root, path")}),
    h AS (SELECT root, path, n AS h0, {_header(patterns, barred)} AS name FROM l WHERE {_header(patterns, barred)} IS NOT NULL),
    b AS (SELECT h.root, h.path, h0, name, n, line, length(line) - length(replace(line, '{{', '')) AS o, length(line) - length(replace(line, '}}', '')) AS c
          FROM h JOIN l ON h.root = l.root AND h.path = l.path AND n >= h0 AND n < h0 + 200),
    r AS (SELECT *, sum(o - c) OVER w AS depth, sum(o) OVER w > 0 AS opened FROM b WINDOW w AS (PARTITION BY root, path, h0 ORDER BY n ROWS UNBOUNDED PRECEDING))
    SELECT root, path, name, h0::INT AS start_line,
           coalesce(min(n) FILTER ((opened AND depth <= 0) OR (NOT opened AND n > h0 AND ({t} = '' OR {t} LIKE '%;'))), max(n))::INT AS end_line
    FROM r GROUP BY root, path, name, h0"""


def _indent(pattern: str) -> str:
    return f"""
    WITH {q.CF}, {_SRC}, l AS ({q.lines("(SELECT * FROM src WHERE language = 'python')", "root, path")}),
    h AS (SELECT root, path, n AS h0, regexp_extract(line, '{pattern}', 1) AS name FROM l WHERE regexp_matches(line, '{pattern}'))
    SELECT h.root, h.path, name, h0::INT AS start_line, coalesce(min(n) FILTER (n > h0 + 1 AND regexp_matches(line, '^\\S')) - 1, max(n))::INT AS end_line
    FROM h JOIN l ON h.root = l.root AND h.path = l.path AND n >= h0 AND n < h0 + 300 GROUP BY h.root, h.path, name, h0"""


def _classes(spans: str, language: str, method: str, barred: list[str], distinct: bool) -> str:
    """Class spans with the names of their methods, in order; each once where `distinct`."""
    bars = ", ".join(f"'{x}'" for x in ["", *barred])
    names = f"SELECT s.root, s.path, s.name, s.start_line, l.n, regexp_extract(l.line, '{method}', 1) AS m FROM s JOIN l ON s.root = l.root AND s.path = l.path AND l.n BETWEEN s.start_line AND s.end_line"
    once = "QUALIFY row_number() OVER (PARTITION BY root, path, start_line, m ORDER BY n) = 1" if distinct else ""
    return f"""
    WITH s AS (SELECT * FROM ({spans})), {q.CF}, l AS ({q.lines("(SELECT * FROM cf WHERE " + q.language("path") + f" IN ({language}))", "root, path")}),
    m AS (SELECT * FROM ({names}) WHERE m NOT IN ({bars}) {once})
    SELECT s.root, s.path, s.name, s.start_line, s.end_line, coalesce((SELECT string_agg(m.m, ',' ORDER BY m.n) FROM m WHERE m.root = s.root AND m.path = s.path AND m.start_line = s.start_line), '') AS methods FROM s"""


_IMPORTS = f"""
il AS ({q.lines("src", "root, path, language")}),
it AS (SELECT root, path, n, CASE
   WHEN language IN ('typescript', 'javascript') THEN nullif(regexp_extract(line, '^import\\s+.*\\s+from\\s+[''"]([^''"]+)[''"]', 1), '')
   WHEN language = 'python' THEN nullif(coalesce(nullif(regexp_extract(line, '^import\\s+([\\w.]+)', 1), ''), regexp_extract(line, '^from\\s+([\\w.]+)\\s+import', 1)), '')
   {" ".join(f"WHEN language = '{k}' THEN CASE WHEN regexp_matches({q.trim('line')}, '{p}') THEN {q.trim('line')} END" for k, p in parse.IMPORTS.items())} END AS target FROM il),
ie AS (SELECT root, path, row_number() OVER (PARTITION BY root, path ORDER BY n)::INT AS position, target FROM it WHERE target IS NOT NULL)
"""
_SIG = "CASE language " + " ".join(
    f"WHEN '{k}' THEN regexp_matches(line, '{'|'.join(p.replace('*+', '*') for p in v)}')" for k, v in parse.SIGNATURES.items() if k
) + f" ELSE regexp_matches(line, '{parse.SIGNATURES[''][0]}') END"
_SCRIPT, _CODE = "('typescript', 'javascript')", "(" + ", ".join(f"'{x}'" for x in config.CODE_LANGUAGES) + ")"


def _units_sql() -> str:
    """CTEs: cf, src, l (lines), un (functions and classes with extents), sg (signatures of other languages at their first place)."""
    fn, cls = _header(parse.BRACE_FUNCTIONS, config.NO_FUNCTION), _header([parse.BRACE_CLASS], [])
    py = lambda p: f"nullif(regexp_extract(line, '{p}', 1), '')"
    head = "SELECT root, path, language, n AS h0, '{k}' AS kind, {x} AS name, t AS signature FROM l WHERE language {w} AND {x} IS NOT NULL"
    return f"""
    WITH {q.CF}, {_SRC}, l AS (SELECT *, {q.trim('line')} AS t FROM ({q.lines("src", "root, path, language")})),
    bh AS ({head.format(k='function', x=fn, w='IN ' + _SCRIPT)} UNION ALL {head.format(k='class', x=cls, w='IN ' + _SCRIPT)}),
    bb AS (SELECT bh.*, n, length(line) - length(replace(line, '{{', '')) AS o, length(line) - length(replace(line, '}}', '')) AS c, t
           FROM bh JOIN l ON bh.root = l.root AND bh.path = l.path AND n >= h0 AND n < h0 + {config.BRACE_LINES}),
    br AS (SELECT *, sum(o - c) OVER w AS depth, sum(o) OVER w > 0 AS opened FROM bb WINDOW w AS (PARTITION BY root, path, kind, h0 ORDER BY n ROWS UNBOUNDED PRECEDING)),
    ph AS ({head.format(k='function', x=py(parse.INDENT_FUNCTION), w="= 'python'")} UNION ALL {head.format(k='class', x=py(parse.INDENT_CLASS), w="= 'python'")}),
    un AS (SELECT root, path, language, kind, name, h0::INT AS start_line, signature,
                  coalesce(min(n) FILTER ((opened AND depth <= 0) OR (NOT opened AND n > h0 AND (t = '' OR t LIKE '%;'))), max(n))::INT AS end_line FROM br GROUP BY ALL
           UNION ALL
           SELECT ph.root, ph.path, ph.language, kind, name, h0::INT, signature, coalesce(min(n) FILTER (n > h0 + 1 AND regexp_matches(line, '^\\S')) - 1, max(n))::INT
           FROM ph JOIN l ON ph.root = l.root AND ph.path = l.path AND n >= h0 AND n < h0 + {config.INDENT_LINES} GROUP BY ALL),
    sg AS (SELECT f.root, f.path, f.language, f.n, f.t AS sig, min(l.n)::INT AS place FROM (SELECT * FROM l WHERE language NOT IN ('typescript', 'javascript', 'python') AND {_SIG}) f
           JOIN l ON l.root = f.root AND l.path = f.path AND l.t = f.t GROUP BY ALL)"""


def _symbols() -> str:
    """CTEs up to cat, the catalogue."""
    bars = ", ".join(f"'{x}'" for x in ["", *config.NO_FUNCTION])
    named = f"CASE WHEN l.language = 'python' THEN regexp_extract(line, '{parse.INDENT_METHOD}', 1) WHEN regexp_extract(line, '{parse.BRACE_METHOD}', 1) NOT IN ({bars}) THEN regexp_extract(line, '{parse.BRACE_METHOD}', 1) ELSE '' END"
    plain = " UNION ALL ".join(
        f"SELECT root, path, language, regexp_extract(line, '{p}', 1), '{k}', n::INT, n::INT, t, NULL, {o}, n FROM l WHERE language IN {_SCRIPT} AND regexp_matches(line, '{p}')"
        for o, (k, p) in enumerate((("interface", parse.INTERFACE), ("type", parse.TYPE), ("enum", parse.ENUM)), 3)
    )
    name = r"regexp_extract(regexp_replace(sig, '^func\s+\([^)]*\)', 'func'), '(\w+)\s*(?:<[^>(]*>)?\s*\(', 1)"
    return f"""{_units_sql()},
    mn AS (SELECT DISTINCT un.root, un.path, un.language, un.name AS cname, un.start_line AS cs, un.end_line AS ce, {named} AS m FROM un
           JOIN l ON l.root = un.root AND l.path = un.path AND n BETWEEN un.start_line AND un.end_line WHERE kind = 'class' AND {named} <> ''),
    mp AS (SELECT mn.root, mn.path, mn.language, cname, cs, m, min(n) AS n FROM mn JOIN l ON l.root = mn.root AND l.path = mn.path AND n BETWEEN cs AND ce AND regexp_matches(line, '(^|\\s)' || m || '\\s*\\(') GROUP BY ALL),
    sy AS (SELECT root, path, language, name, kind, start_line AS line, end_line, signature, NULL::VARCHAR AS container, CASE kind WHEN 'function' THEN 0 ELSE 1 END AS ord, start_line AS sub FROM un
           UNION ALL SELECT mp.root, mp.path, mp.language, m, 'method', mp.n::INT, mp.n::INT, t, cname, 2, cs FROM mp JOIN l ON l.root = mp.root AND l.path = mp.path AND l.n = mp.n
           UNION ALL {plain}
           UNION ALL SELECT root, path, language, {name}, 'function', place, place, sig, NULL, 0, n FROM sg WHERE {name} <> ''),
    cat AS (SELECT * EXCLUDE (ord, sub) FROM sy QUALIFY row_number() OVER (PARTITION BY root, path, name, line ORDER BY ord DESC, sub DESC) = 1),
    pc AS (SELECT * REPLACE (root || '/' || path AS path) FROM cat)"""


def _chunked() -> str:
    """CTEs up to ck, the chunks of all files with their texts."""
    return f"""{_units_sql()},
    fl AS (SELECT root, path, language, string_split(content, chr(10)) AS ls FROM src),
    u AS (SELECT root, path, 0 AS ord, start_line AS sub, start_line, end_line, 'function' AS chunk_type, name AS identifier FROM un WHERE kind = 'function'
          UNION ALL SELECT root, path, 1, start_line, start_line, end_line, 'class', name FROM un c WHERE kind = 'class'
            AND NOT EXISTS (SELECT 1 FROM un f WHERE f.kind = 'function' AND f.root = c.root AND f.path = c.path AND f.start_line <= c.start_line AND f.end_line >= c.end_line)
            AND NOT EXISTS (SELECT 1 FROM un x WHERE x.kind = 'class' AND x.root = c.root AND x.path = c.path AND x.start_line < c.start_line AND x.end_line >= c.end_line)
          UNION ALL SELECT root, path, 0, n, place, least(place + {config.SIGNATURE_LINES - 1}, len(ls))::INT, 'function', regexp_extract(string_split(sig, '(')[1], '(\\S*)$', 1)
            FROM sg JOIN fl USING (root, path) WHERE sg.language IN {_CODE}),
    fb AS (SELECT root, path, 2 AS ord, i AS sub, (i + 1)::INT AS start_line, least(i + CASE WHEN language IN {_CODE} THEN 30 ELSE 60 END, len(ls))::INT AS end_line,
                  CASE WHEN language IN {_CODE} THEN 'block' ELSE 'lines' END AS chunk_type, NULL AS identifier
           FROM (SELECT *, unnest(range(0, len(ls), CASE WHEN language IN {_CODE} THEN 30 ELSE 50 END)) AS i FROM fl WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.root = fl.root AND u.path = fl.path))),
    ck AS (SELECT a.root, a.path, (row_number() OVER (PARTITION BY a.root, a.path ORDER BY ord, sub))::INT AS chunk_no, start_line, end_line, chunk_type, identifier,
                  array_to_string(ls[start_line:end_line], chr(10)) AS text FROM (SELECT * FROM u UNION ALL SELECT * FROM fb) a JOIN fl ON fl.root = a.root AND fl.path = a.path)"""


def _smart(ctes: str, source: str, group: str, terms: list[str], budget: int, bonus: str) -> str:
    """Two rankings with a packing each; `source` has group, chunk_no, start_line, chunk_type, identifier and text."""
    return (
        f"{ctes} rk AS (SELECT * FROM (" + "WITH " + _bm25(f"rows AS (SELECT *, {q.document_terms('text')} AS toks FROM ({source}))", group, group, terms)
        + f" SELECT {group}, chunk_no, start_line, chunk_type, identifier, text, round(bm, 9) AS score, {q.code_tokens('text')} AS tokens FROM scored)), k AS ("
        + _PACK.format(g=group, o="score DESC, chunk_no", t="rk", m=budget)
        + "), s AS (SELECT * FROM (WITH " + _bm25(f"rows AS (SELECT {group}, chunk_no, start_line, chunk_type, identifier, text, tokens, {q.document_terms(_NAMED)} AS toks FROM k)", group, group, terms)
        + f" SELECT {group}, chunk_no, round(bm + {bonus}, 9) AS score, tokens FROM scored WHERE bm + {bonus} > 0)), kept AS ("
        + _PACK.format(g=group, o="score DESC, chunk_no", t="s", m=budget) + ")"
    )


def _bonus(terms: list[str]) -> str:
    wanted = ", ".join(f"'{t}'" for t in terms)
    return (
        "(2.0 * len(list_filter(" + q.identifier_tokens("coalesce(identifier, '')") + f", lambda t: t IN ({wanted})))"
        + f" + CASE WHEN lower(coalesce(identifier, '')) IN ({wanted}) THEN 4.0 ELSE 0 END"
        + " + CASE WHEN chunk_type IN ('function', 'class') THEN 0.5 ELSE 0 END + CASE WHEN start_line <= 50 THEN 0.3 ELSE 0 END)"
    )


#: Relative imports with the file that they mean: parts put together one by one, then the endings in order.
_ENDS = "['.ts', '.tsx', '.js', '.jsx', '.py']"
_RESOLVED = f"""
rb AS (SELECT DISTINCT root, path, target, substr(list_reduce(list_concat([''], list_filter(string_split(CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END || '/' || target, '/'),
         lambda x: x NOT IN ('', '.'))), lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/?[^/]*$', '') ELSE a || '/' || x END), 2) AS base FROM ie WHERE target LIKE '.%'),
ro AS (SELECT root, path, target, list_concat(list_transform({_ENDS}, lambda e: base || e), list_transform({_ENDS}, lambda e: base || '/index' || e),
         CASE WHEN regexp_matches(base, '\\.(js|jsx|mjs)$') THEN [regexp_replace(base, '\\.(js|jsx|mjs)$', '') || '.ts', regexp_replace(base, '\\.(js|jsx|mjs)$', '') || '.tsx', base] ELSE [] END) AS options FROM rb),
rt AS (SELECT root, path, target, unnest(options) AS file, generate_subscripts(options, 1) AS k FROM ro),
rl AS (SELECT root, path AS file FROM cf UNION SELECT root, path FROM code_files WHERE path IS NOT NULL UNION SELECT root_path, path FROM project_map WHERE path IS NOT NULL),
rr AS (SELECT root, path, target, arg_min(file, k) AS file FROM rt JOIN rl USING (root, file) GROUP BY root, path, target)
"""
_FIND_SQL = f"""b AS (SELECT *, CASE WHEN lower(name) = lower('{FIND}') THEN 0 WHEN contains(lower(name), lower('{FIND}')) THEN 1
    WHEN list_has_any({q.identifier_tokens('name')}, [{", ".join(repr(t) for t in query_terms(FIND))}]) THEN 2 END AS bucket FROM pc {{w}})
    SELECT path, name, kind, line, bucket FROM b WHERE bucket IS NOT NULL ORDER BY bucket, kind = 'method', path, line, name LIMIT 400"""
_READ = query_terms("load session config")
_BONUS = _bonus(_RETRY)
_OLD = "list_filter(string_split(text, chr(10)), lambda x, i: (i - 1) % 5 <> 4)"
_DIFF = f"""
a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, -1 AS d FROM documents),
b AS (SELECT doc_id, unnest(list_concat(CASE WHEN len({_OLD}) = 0 THEN [''] ELSE {_OLD} END, ['end of text'])) AS line, 1 AS d FROM documents),
s AS (SELECT doc_id, line, sum(d) AS d FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL HAVING sum(d) <> 0)
"""

QUERIES = {
    "bm25_stats": bm25_stats, "bm25_collection": bm25_collection, "bm25_rank": bm25_rank, "chunk_rank": chunk_rank, "chunk_rerank": chunk_rerank, "smart_read": smart_read, "budget_pack": budget_pack,
    "extract_functions_ts": extract_functions_ts, "extract_classes_ts": extract_classes_ts, "extract_interfaces_types": extract_interfaces_types,
    "extract_functions_py": extract_functions_py, "extract_classes_py": extract_classes_py, "extract_generic_sigs": extract_generic_sigs,
    "extract_imports": extract_imports, "unit_counts": unit_counts, "semantic_chunks": semantic_chunks, "function_extract": function_extract, "function_extract_best": function_extract_best, "smart_read_files": smart_read_files,
    "whole_units": whole_units, "symbol_find_kind": symbol_find_kind, "symbol_files_stats": symbol_files_stats, "symbol_invalidate": symbol_invalidate,
    "incremental_counts": incremental_counts, "project_graph": project_graph, "file_graph": file_graph, "symbol_catalogue": symbol_catalogue,
    "symbol_find": symbol_find, "symbol_outline": symbol_outline, "symbol_stats": symbol_stats, "incremental_index": incremental_index,
    "link_in_degree": link_in_degree, "link_sources": link_sources, "most_imported": most_imported, "resolve_imports": resolve_imports, "reach_depth2": reach_depth2,
    "line_diff": line_diff, "line_diff_counts": line_diff_counts, "diff_hunks": diff_hunks,
}
ORACLES = {
    "bm25_stats": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({q.document_terms('text')}) AS term FROM documents) GROUP BY term",
    "bm25_collection": f"SELECT count(*) AS n, round(avg(len({q.document_terms('text')})), 6) AS avgdl FROM documents",
    "bm25_rank": "WITH " + _bm25(f"rows AS (SELECT doc_id, {q.document_terms('text')} AS toks FROM documents)", "doc_id", "", _TERMS) + " SELECT doc_id, round(bm, 6) AS score FROM scored WHERE bm > 0",
    "chunk_rank": "WITH " + _bm25(f"rows AS (SELECT path, part, chunk_no, {q.document_terms('text')} AS toks FROM ({_WIN}))", "path, part, chunk_no", "path", _TERMS)
    + " SELECT path, part, chunk_no::INT AS chunk_no, round(bm, 6) AS score FROM scored",
    "chunk_rerank": "WITH " + _bm25(f"rows AS (SELECT *, {q.document_terms(_NAMED)} AS toks FROM ({_CHUNKS}))", "path", "path", _RETRY)
    + f" SELECT path, chunk_no, round(bm + {_BONUS}, 6) AS score FROM scored WHERE bm + {_BONUS} > 0",
    "smart_read": _smart("WITH", _CHUNKS, "path", _RETRY, config.SNIPPET_BUDGET, _BONUS) + " SELECT path, chunk_no, round(score, 6) AS score, tokens, used FROM kept",
    "smart_read_files": _smart(f"{_chunked()}, rd AS (SELECT root, path, {q.code_tokens('content')} AS total FROM src),", f"SELECT ck.* FROM ck JOIN rd USING (root, path) WHERE total > {READ_BUDGET}", "root, path", _READ, READ_BUDGET, _bonus(_READ))
    + f" SELECT root, path, 'whole' AS plan, NULL::INT AS chunk_no, total, total AS tokens FROM rd WHERE total <= {READ_BUDGET} UNION ALL SELECT root, path, 'chunks', chunk_no, total, tokens FROM kept JOIN rd USING (root, path)",
    "budget_pack": f"WITH s AS (SELECT coalesce(lower(trim(source)), '') AS source, doc_id, {q.code_tokens('text')} AS tokens FROM documents) "
    + _PACK.format(g="source", o="tokens DESC, doc_id", t="s", m=20_000),
    "extract_functions_ts": _brace(parse.BRACE_FUNCTIONS, config.NO_FUNCTION),
    "extract_functions_py": _indent(parse.INDENT_FUNCTION),
    "extract_classes_ts": _classes(_brace([parse.BRACE_CLASS], []), "'typescript', 'javascript'", parse.BRACE_METHOD, config.NO_FUNCTION, True),
    "extract_classes_py": _classes(_indent(parse.INDENT_CLASS), "'python'", parse.INDENT_METHOD, [], False),
    "unit_counts": f"{_chunked()} SELECT root, path, chunk_type, count(*) AS n, sum(start_line)::BIGINT AS starts, sum(end_line)::BIGINT AS ends FROM ck WHERE chunk_type IN ('function', 'class') GROUP BY ALL",
    "semantic_chunks": f"{_chunked()} SELECT root, path, chunk_no, start_line, end_line, chunk_type, identifier, md5(text) AS digest FROM ck",
    "whole_units": _brace(parse.BRACE_FUNCTIONS, config.NO_FUNCTION).replace(" AND n < h0 + 200", ""),
    "symbol_catalogue": f"{_symbols()} SELECT * FROM cat",
    "symbol_stats": f"{_symbols()} SELECT kind, language, count(*) AS symbols, count(DISTINCT path) AS files FROM cat GROUP BY GROUPING SETS ((kind), (language), ())",
    "symbol_invalidate": f"{_symbols()} SELECT language, count(*) AS symbols FROM pc WHERE path <> (SELECT min(path) FROM pc) GROUP BY language",
    "symbol_find": f"{_symbols()}, " + _FIND_SQL.replace("{w}", ""),
    "symbol_find_kind": f"{_symbols()}, " + _FIND_SQL.replace("{w}", "WHERE kind = 'function' AND language = 'python' AND starts_with(path, (SELECT root FROM code_files GROUP BY root ORDER BY count(*) DESC, root LIMIT 1) || '/')"),
    "symbol_outline": f"{_symbols()} SELECT path, name, kind, line, end_line FROM pc WHERE path = (SELECT path FROM pc GROUP BY path ORDER BY count(*) DESC, path LIMIT 1)",
    "symbol_files_stats": """WITH g AS (SELECT run_id FROM index_runs WHERE run_id IS NOT NULL AND noted_at IS NOT NULL GROUP BY run_id HAVING max_by(status, (noted_at, status)) = 'ok'),
        f AS (SELECT * FROM symbol_files JOIN g USING (run_id) WHERE file_path IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY root_path, file_path ORDER BY indexed_at DESC NULLS LAST, symbol_count DESC NULLS LAST) = 1)
        SELECT root_path, count(*) AS files, coalesce(sum(symbol_count), 0)::BIGINT AS symbols, max(indexed_at) AS last_indexed FROM f GROUP BY root_path""",
    "incremental_index": f"{_symbols()} SELECT language, kind, count(*) AS symbols, sum(line)::BIGINT AS lines, sum(end_line)::BIGINT AS end_lines, sum(length(signature))::BIGINT AS chars FROM cat GROUP BY ALL",
    "incremental_counts": rf"""WITH {q.CF}, n AS (SELECT root || '/' || path AS path, content FROM cf WHERE length(content) % 5 > 0),
        o AS (SELECT root || '/' || path AS path, CASE WHEN length(content) % 3 = 0 THEN regexp_replace(content, '\n?[^\n]*$', '') ELSE content END AS old FROM cf WHERE length(content) % 7 > 0)
        SELECT count(n.path) AS scanned, count(*) FILTER (n.path IS NOT NULL AND content IS DISTINCT FROM old) AS indexed, count(*) FILTER (o.path IS NULL) AS added,
               count(*) FILTER (content <> old) AS changed, count(*) FILTER (content = old) AS unchanged, count(*) FILTER (n.path IS NULL) AS removed FROM n FULL JOIN o ON n.path = o.path""",
    "extract_interfaces_types": f"WITH {q.CF}, {_SRC}, l AS ({q.lines('src', 'root, path, language')}), k(kind, p) AS (VALUES "
    + ", ".join(f"('{k}', '{p}')" for k, p in (("interface", parse.INTERFACE), ("type", parse.TYPE), ("enum", parse.ENUM)))
    + ") SELECT root, path, kind, regexp_extract(line, p, 1) AS name, n::INT AS line FROM l, k WHERE language IN ('typescript', 'javascript') AND regexp_matches(line, p)",
    "extract_generic_sigs": f"WITH {q.CF}, {_SRC}, l AS ({q.lines('src', 'root, path, language')}), g AS (SELECT root, path, n, {q.trim('line')} AS signature FROM l WHERE language NOT IN ('typescript', 'javascript', 'python') AND {_SIG})"
    " SELECT root, path, (row_number() OVER (PARTITION BY root, path ORDER BY n) - 1)::INT AS position, signature FROM g QUALIFY position < 50",
    "extract_imports": f"WITH {q.CF}, {_SRC}, {_IMPORTS} SELECT * FROM ie",
    "function_extract": f"{_chunked()} SELECT root, path, start_line, end_line, identifier FROM ck WHERE lower(identifier) = lower('{NAMED}') QUALIFY row_number() OVER (PARTITION BY root, path ORDER BY chunk_no) = 1",
    "function_extract_best": f"{_chunked()}, x AS (SELECT * FROM ck WHERE lower(identifier) = lower('{NAMED}') QUALIFY row_number() OVER (PARTITION BY root, path ORDER BY chunk_no) = 1), fz AS (SELECT * FROM (WITH "
    + _bm25(f"rows AS (SELECT *, {q.document_terms('text')} AS toks FROM ck WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.root = ck.root AND x.path = ck.path))", "root, path", "root, path", query_terms(NAMED))
    + f" SELECT root, path, chunk_no, start_line, end_line, identifier, round(bm, 9) AS score, {q.code_tokens('text')} AS tokens FROM scored WHERE bm > 0)), fk AS ("
    + _PACK.format(g="root, path", o="score DESC, chunk_no", t="fz", m=config.SNIPPET_BUDGET)
    + ") SELECT root, path, start_line, end_line, identifier, true AS exact FROM x UNION ALL SELECT root, path, start_line, end_line, identifier, false FROM fk QUALIFY row_number() OVER (PARTITION BY root, path ORDER BY score DESC, chunk_no) = 1",
    "link_in_degree": f"WITH {q.CF}, {_SRC}, {_IMPORTS} SELECT target, count(*) AS degree FROM ie GROUP BY target",
    "link_sources": f"WITH {q.CF}, {_SRC}, {_IMPORTS} SELECT DISTINCT target, root || '/' || path AS source FROM ie",
    "most_imported": f"WITH {q.CF}, {_SRC}, {_IMPORTS} SELECT target, count(*) AS degree FROM ie GROUP BY target ORDER BY degree DESC, target LIMIT 20",
    "resolve_imports": f"WITH {q.CF}, {_SRC}, {_IMPORTS}, {_RESOLVED} SELECT * FROM rr",
    "project_graph": f"""WITH {q.CF}, {_SRC}, {_IMPORTS}, a AS (SELECT root || '/' || path AS node, 0 AS o, 0 AS i FROM cf UNION ALL SELECT root || '/' || path, 1, 0 FROM ie UNION ALL SELECT target, 0, 1 FROM ie)
        SELECT node, sum(o)::BIGINT AS imports, sum(i)::BIGINT AS imported_by FROM a GROUP BY node""",
    "file_graph": f"""WITH RECURSIVE {q.CF}, {_SRC}, {_IMPORTS}, {_RESOLVED}, k AS (SELECT DISTINCT root || '/' || path AS src, root || '/' || file AS dst FROM rr),
        r(node, level) AS (SELECT DISTINCT root || '/' || path, 0 FROM ie WHERE target LIKE '.%' UNION SELECT dst, level + 1 FROM r JOIN k ON src = node WHERE level < 2),
        v AS (SELECT node, min(level)::INT AS level FROM r GROUP BY node)
        SELECT node, level, (SELECT count(*) FROM ie WHERE root || '/' || path = node) AS imports,
               (SELECT count(*) FROM k JOIN v s ON s.node = k.src AND s.level < 2 WHERE k.dst = v.node) AS imported_by FROM v""",
    "reach_depth2": """WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
        r(node, level) AS (SELECT 'c' || c_custkey, 0 FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT dst, level + 1 FROM r JOIN e ON src = node WHERE level < 2)
        SELECT node, min(level)::INT AS level FROM r GROUP BY node""",
    "line_diff": f"WITH {_DIFF} SELECT doc_id, line, CASE WHEN d > 0 THEN '+' ELSE '-' END AS change, abs(d)::BIGINT AS n FROM s",
    "line_diff_counts": f"WITH {_DIFF} SELECT doc_id, coalesce(sum(d) FILTER (d > 0), 0)::BIGINT AS added, coalesce(-sum(d) FILTER (d < 0), 0)::BIGINT AS removed FROM s GROUP BY doc_id",
}
