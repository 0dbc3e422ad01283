"""Queries of the operators for training text, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.llm import distinctive, handwritten, leakage, mixing, prose, splitting
from lodeglass.session import cut_lineage, ensure_checkpoint_dir, table


# -- 1 -----------------------------------------------------------------------
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.most_telling(distinctive.term_weights(table(spark, d, "bm25_documents"))).select("id", "term")


def p1_weights(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.term_weights(table(spark, d, "bm25_documents")).select("id", "term", "f", "df", F.round("score", 6).alias("score"))


# -- 3 -----------------------------------------------------------------------
def _chunk_pieces(spark: SparkSession, d: str, carried: list[str] | None = None) -> DataFrame:
    chunks = table(spark, d, "file_chunks").withColumn("origin", F.coalesce("start_line", F.lit(1).cast("bigint")))
    return splitting.split_texts(chunks, ["path", "chunk_no"], carried=carried)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each piece's lines in its file; start_line is that of the delivery whose content was cut."""
    at = lambda c: (F.col("origin") + F.col(c) - 1)
    return _chunk_pieces(spark, d, ["origin"]).select("path", "chunk_no", at("first").alias("start_line"), at("last").alias("end_line"))


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.piece_texts(table(spark, d, "file_chunks"), _chunk_pieces(spark, d), ["path", "chunk_no"])
    return pieces.select("path", "chunk_no", "first", "last", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


#: Bytes of a range in `p3_files`: small, so that a file of any size has many.
FILE_RANGE = 16 << 10


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """The chunks written into eight large files, which are then split by byte ranges; each piece's text as length and checksum."""
    folder = f"{ensure_checkpoint_dir(spark)}/pieces-{uuid.uuid4().hex}"
    chunks = table(spark, d, "file_chunks").where("content IS NOT NULL AND path IS NOT NULL AND chunk_no IS NOT NULL").groupBy("path", "chunk_no").agg(F.max("content").alias("value"))
    part = F.pmod(F.length("path"), F.lit(8)).alias("part")
    # one sorted file per part
    chunks.select(part, "path", "chunk_no", "value").repartition(8, "part").sortWithinPartitions("part", "path", "chunk_no").select("part", "value").write.partitionBy("part").text(folder)
    listing = splitting.list_files(spark, folder).where("length > 0")
    pieces = splitting.split_files_with_texts(listing, range_bytes=FILE_RANGE)
    number = F.regexp_extract("path", r"part=(\d+)/", 1).cast("int").alias("part")
    return pieces.select(number, "first", "last", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


# -- 5 -----------------------------------------------------------------------
def _classified(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classify(table(spark, d, "project_map"), table(spark, d, "code_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).where("kind IS NOT NULL").select("root_path", "path")


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("files"))


#: Attribute files that every repository of `p5_declared` is given: (path, content).
ATTRIBUTES = [
    (".gitattributes", "*.go linguist-generated\nlib/** linguist-vendored\n"), ("lib/.gitattributes", "*.py -linguist-vendored\n"),
    ("src/.gitattributes", "*.go linguist-generated=false\ncore/*.ts linguist-generated\n"),
]


def p5_declared(spark: SparkSession, d: str) -> DataFrame:
    """What attribute files in three folders of every repository say of its files."""
    files = table(spark, d, "project_map").where("root_path IS NOT NULL AND path IS NOT NULL").select("root_path", "path").distinct()
    given = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in ATTRIBUTES])).alias("a")
    contents = files.select(F.col("root_path").alias("root")).distinct().select("root", given).select("root", "a.*")
    return handwritten.declared(files, handwritten.attribute_rules(contents))


# -- 6 -----------------------------------------------------------------------
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_passages(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    """Also passages of twelve words of which up to two are others or left out, with up to two put in between."""
    return leakage.find_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), misses=2, gaps=2)


# -- 7 -----------------------------------------------------------------------
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.mix_plan(mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"))
    return mixing.short_sources(spark, plan)


def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.mix_plan(mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"))
    return mixing.plan_table(spark, plan)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the drawn mix reaches."""
    sized = cut_lineage(mixing.sized_documents(table(spark, d, "documents")))
    plan = mixing.mix_plan(sized, table(spark, d, "mix_targets"))
    return mixing.mix_report(mixing.sample_mix(sized, plan), plan)


# -- 8 -----------------------------------------------------------------------
def _judged(spark: SparkSession, d: str) -> DataFrame:
    return prose.judged(table(spark, d, "documents"), table(spark, d, "common_words"), table(spark, d, "prose_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("NOT is_prose").select("doc_id").distinct()


def p8_contributions(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("doc_id", "language", "distance", *prose.named("contributions"), "is_prose")


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    stats = prose.text_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))
    return stats.select("doc_id", "language", *prose.named("stats"))


_WEIGHTS = """
rec AS (SELECT id, arg_max(t, (len(t), t)) AS t FROM (
          SELECT id, list_filter(list_transform(tokens, lambda x: lower(x)), lambda x: x IS NOT NULL AND x <> '') AS t
          FROM bm25_documents WHERE id IS NOT NULL) WHERE len(t) > 0 GROUP BY id),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM rec),
tf AS (SELECT id, len(t) AS dl, term, count(*) AS f FROM (SELECT id, t, unnest(t) AS term FROM rec) GROUP BY id, len(t), term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT id, term, f, df, n,
             round(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * (dl / avgdl))), 9) AS score
      FROM tf JOIN df USING (term), stats)
"""
_DOC_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
_GRAMS = "SELECT DISTINCT {0}, list_aggregate(w[k:k + 11], 'string_agg', ' ') AS g FROM (SELECT {0}, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT {0}, {1} AS w FROM {2} WHERE text IS NOT NULL) WHERE len(w) >= 12)"
#: Any usual tokenizer gives the same sources, so do characters.
_SHORT = """
WITH s AS (SELECT nullif(lower(trim(source)), '') AS source, length(text) AS n FROM documents WHERE text IS NOT NULL),
     t AS (SELECT source, sum(n) AS n FROM s WHERE source IS NOT NULL GROUP BY source), total AS (SELECT sum(n) AS n FROM s)
SELECT lower(trim(m.source)) AS source FROM mix_targets m LEFT JOIN t ON lower(trim(m.source)) = t.source, total
WHERE coalesce(t.n, 0) * m.max_repeats < m.target_weight * total.n
"""
#: The cutting rule as a recursion over piece ends; `c` has the columns {k}, origin and content.
_PIECES = r"""
WITH RECURSIVE c AS ({c}),
l AS (SELECT {k}, origin, string_split(content, chr(10)) AS ls FROM c),
big AS (SELECT {k}, origin, ls, len(ls) AS n FROM l WHERE len(ls) > 60),
cand AS (SELECT {k}, k, len(regexp_extract(ls[k], '^[ \t]*')) AS ind
         FROM (SELECT {k}, ls, unnest(range(2, n + 1)) AS k FROM big)
         WHERE regexp_matches(ls[k], '\S') AND NOT regexp_matches(ls[k - 1], '\S')),
nat AS (SELECT {k}, list(k ORDER BY k) AS ks FROM (SELECT *, min(ind) OVER (PARTITION BY {k}) AS least FROM cand) WHERE ind = least GROUP BY {k}),
b AS (SELECT big.*, coalesce(ks, []) AS ks FROM big LEFT JOIN nat USING ({k})),
p AS (SELECT {k}, origin, n, ks, 0::BIGINT AS s, 0::BIGINT AS e FROM b
      UNION ALL
      SELECT {k}, origin, n, ks, greatest(1, e - 4),
             CASE WHEN n <= greatest(1, e - 4) + 59 THEN n
                  ELSE coalesce(list_max(list_filter(ks, lambda k: k - 1 > e AND k - 1 <= greatest(1, e - 4) + 59)) - 1, greatest(1, e - 4) + 59) END
      FROM p WHERE e < n)
"""
_CHUNKS = _PIECES.replace("{c}", "SELECT path, chunk_no, max(start_line) AS origin, max(content) AS content FROM file_chunks WHERE content IS NOT NULL GROUP BY path, chunk_no").replace("{k}", "path, chunk_no")
_FILES = _PIECES.replace("{c}", """SELECT part, 1 AS origin, string_agg(content, chr(10) ORDER BY path, chunk_no) || chr(10) AS content
    FROM (SELECT path, chunk_no, length(path) % 8 AS part, max(content) AS content FROM file_chunks WHERE content IS NOT NULL AND path IS NOT NULL AND chunk_no IS NOT NULL GROUP BY path, chunk_no) GROUP BY part""").replace("{k}", "part")
_TEXT = "length(array_to_string(ls[s:e], chr(10))) AS n_chars, md5(array_to_string(ls[s:e], chr(10))) AS digest"

QUERIES = {
    "p1_found": p1_found, "p1_weights": p1_weights, "p3_found": p3_found, "p3_texts": p3_texts, "p3_files": p3_files, "p5_found": p5_found, "p5_kinds": p5_kinds, "p5_declared": p5_declared,
    "p6_found": p6_found, "p6_near": p6_near, "p7_found": p7_found, "p7_plan": p7_plan, "p7_mix": p7_mix,
    "p8_found": p8_found, "p8_contributions": p8_contributions, "p8_statistics": p8_statistics,
}
ORACLES = {
    "p1_found": f"WITH {_WEIGHTS} SELECT id, arg_min(term, (-score, term)) AS term FROM w WHERE df >= 2 GROUP BY id HAVING bool_or(df < n * 0.05)",
    "p1_weights": f"WITH {_WEIGHTS} SELECT id, term, f, df, round(score, 6) AS score FROM w",
    "p3_found": _CHUNKS + "SELECT path, chunk_no, origin + s - 1 AS start_line, origin + e - 1 AS end_line FROM p WHERE e > 0",
    "p3_texts": _CHUNKS + f"SELECT path, chunk_no, s AS first, e AS last, {_TEXT} FROM p JOIN l USING (path, chunk_no) WHERE e > 0",
    "p3_files": _FILES + f"SELECT part::INT AS part, s AS first, e AS last, {_TEXT} FROM p JOIN l USING (part) WHERE e > 0",
    "p6_found": "WITH i AS (" + _GRAMS.format("item_id", _DOC_WORDS.format("text"), "eval_items") + "), d AS ("
    + _GRAMS.format("doc_id", _DOC_WORDS.format("text"), "documents") + ") SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)",
    "p5_declared": r"""WITH f AS (SELECT DISTINCT root_path, path FROM project_map WHERE root_path IS NOT NULL AND path IS NOT NULL),
        k AS (SELECT *, 'generated' AS kind, CASE WHEN regexp_matches(path, '^src/core/[^/]*\.ts$') THEN true WHEN regexp_matches(path, '^src/.*\.go$') THEN false WHEN regexp_matches(path, '\.go$') THEN true END AS value FROM f
              UNION ALL SELECT *, 'vendored', CASE WHEN regexp_matches(path, '^lib/(.*/)?[^/]*\.py$') THEN false WHEN starts_with(path, 'lib/') THEN true END FROM f)
        SELECT root_path, path, kind, value FROM k WHERE value IS NOT NULL""",
    "p7_found": _SHORT,
}
