"""BM25 ranking for a stated query, and packing into a token budget.

The terms of the query are few and known, so that each text's counts of them
are taken within its row. A collection's statistics are then one small
aggregate: how many texts there are, how long, and how many hold each term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeglass import config
from lodeglass.functions.terms import term_counts
from lodeglass.functions.text import code_tokens, document_terms, identifier_tokens, query_terms
from lodeglass.session import cut_lineage


def term_table(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, term, f): how often each document holds each of its terms."""
    return docs.select(doc, F.explode(document_terms(text)).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("f"))


def document_frequencies(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(term, df)"""
    return docs.select(F.explode(F.array_distinct(document_terms(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def collection_stats(docs: DataFrame, text: str) -> DataFrame:
    """(n, avgdl), one row."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(document_terms(text))).alias("avgdl"))


def _counted(docs: DataFrame, text: Column, terms: list[str]) -> DataFrame:
    """With _dl, the text's length in terms, and _f, an array of the query terms' counts."""
    return docs.withColumn("_m", term_counts(text, terms)).withColumn("_dl", F.col("_m.dl")).withColumn("_f", F.col("_m.f")).drop("_m")


def _score(n: Column, avgdl: Column, dfs: list[Column], f: str = "_f", dl: str = "_dl", k1: float = config.K1, b: float = config.B) -> Column:
    total = F.lit(0.0)
    length = F.col(dl) / F.greatest(avgdl, F.lit(1.0))
    for k, df in enumerate(dfs):
        count = F.col(f)[k]
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        total = total + F.when(count > 0, idf * count * (k1 + 1) / (count + k1 * (1 - b + b * length))).otherwise(0.0)
    return total


def scored(docs: DataFrame, text: Column | str, query: str) -> DataFrame:
    """`docs` with `score`, ranked against the whole collection; 0 for all if the query has no terms.

    One pass for the statistics, one row to the driver; then the scores, without shuffle.
    """
    terms = query_terms(query)
    if not terms:
        return docs.withColumn("score", F.lit(0.0))
    counted = _counted(docs, F.col(text) if isinstance(text, str) else text, terms)
    row = counted.agg(F.count(F.lit(1)), F.avg("_dl"), *[F.count_if(F.col("_f")[k] > 0) for k in range(len(terms))]).first()
    score = _score(F.lit(row[0]), F.lit(float(row[1] or 0.0)), [F.lit(x) for x in row[2:]])
    return counted.withColumn("score", score).drop("_dl", "_f")


def _within(counted: DataFrame, groups: list[str], n_terms: int, f: str = "_f", dl: str = "_dl") -> DataFrame:
    """`counted` with `score`, each group being a collection of its own.

    The groups' statistics are aggregated, partly before they are shuffled,
    and joined back; a group with a third of all rows is split by AQE, as its
    other side is one row. Texts needn't be among the columns.
    """
    stats = counted.groupBy(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)]).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(dl).alias("_avg"), *[F.count_if(F.col(f)[k] > 0).alias(f"_df{k}") for k in range(n_terms)]
    )
    same = F.lit(True)
    for k, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    score = _score(F.col("_n"), F.col("_avg"), [F.col(f"_df{k}") for k in range(n_terms)], f, dl)
    return counted.join(stats, same).withColumn("score", score).drop("_n", "_avg", *[f"_df{k}" for k in range(n_terms)], *[f"_g{k}" for k in range(len(groups))])


def scored_within(docs: DataFrame, groups: list[str], text: Column | str, query: str) -> DataFrame:
    """`docs` with `score`, each group being a collection of its own (the chunks of one file).

    Select what you need of the result: columns that nobody asks for, the
    text above all, aren't shuffled.
    """
    terms = query_terms(query)
    if not terms:
        return docs.withColumn("score", F.lit(0.0))
    return _within(_counted(docs, F.col(text) if isinstance(text, str) else text, terms), groups, len(terms)).drop("_dl", "_f")


def chunk_scores(chunks: DataFrame, groups: list[str], keys: list[str], text: str, query: str, **made: Column) -> DataFrame:
    """(groups, keys, score): `scored_within` for chunks of which nothing but keys and scores is wanted.

    Each text is looked at once, and what is shuffled are numbers. Repeated
    rows count once. `made` are further columns among `keys`, worked out with
    the counts.
    """
    terms = query_terms(query)
    chunks = chunks.withColumns(made) if made else chunks
    counted = _counted(chunks, F.col(text), terms) if terms else chunks.withColumn("_f", F.lit(0)).withColumn("_dl", F.lit(0))
    measured = cut_lineage(counted.select(*groups, *keys, "_dl", "_f", F.xxhash64(text).alias("_h")).distinct().drop("_h"))
    found = _within(measured, groups, len(terms)) if terms else measured.withColumn("score", F.lit(0.0))
    return found.select(*groups, *keys, "score")


def ranked(docs: DataFrame, text: Column | str, query: str) -> DataFrame:
    """Documents with a score above 0."""
    return scored(docs, text, query).where("score > 0")


def _named_text() -> Column:
    """A chunk's identifier and text."""
    return F.concat(F.when(F.coalesce(F.col("identifier"), F.lit("")) != "", F.concat("identifier", F.lit(" "))).otherwise(""), "text")


def _bonus(terms: list[str]) -> Column:
    """What the name, kind and place of a chunk add to its score."""
    wanted, name = F.array(*map(F.lit, terms)), F.coalesce(F.col("identifier"), F.lit(""))
    return (
        F.size(F.array_intersect(identifier_tokens(name), wanted)) * 2.0 + F.when(F.array_contains(wanted, F.lower(name)), 4.0).otherwise(0.0)
        + F.when(F.col("chunk_type").isin("function", "class"), 0.5).otherwise(0.0) + F.when(F.col("start_line") <= 50, 0.3).otherwise(0.0)
    )


def reranked(chunks: DataFrame, groups: list[str], query: str) -> DataFrame:
    """The second ranking of chunks: identifiers count as text, with bonuses for what the names and places say.

    `chunks` has identifier, chunk_type, start_line and text. Chunks with
    score 0 are left out; without query terms all stay, at 0.
    """
    terms = query_terms(query)
    if not terms:
        return chunks.withColumn("score", F.lit(0.0))
    base = _within(_counted(chunks, _named_text(), terms), groups, len(terms)).drop("_dl", "_f")
    return base.withColumn("score", F.col("score") + _bonus(terms)).where("score > 0")


def packed(rows: DataFrame, groups: list[str], order: list[Column], tokens: str, budget: int, salts: int = 64) -> DataFrame:
    """The rows of each group, in order, up to the first that would overrun the budget; with `used`, tokens so far.

    A group may hold a third of all rows. So its rows are first packed within
    salted shares: what lies behind a share's own first overrun can't be kept,
    and lies behind an overrun in the whole too. Only what is left, a few
    budgets' worth of rows, meets in one window.
    """
    shares = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns]), F.lit(salts)))
    before = F.coalesce(F.sum(tokens).over(Window.partitionBy(*groups, "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = shares.withColumn("_before", before).where(F.col("_before") <= budget).drop("_before", "_salt")
    used = F.sum(tokens).over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return left.withColumn("used", used).where(F.col("used") <= budget)


def smart_read(chunks: DataFrame, groups: list[str], query: str, budget: int = config.SNIPPET_BUDGET, key: str = "chunk_no") -> DataFrame:
    """(groups, key, score, tokens, used): the chunks of each file that answer a query within a token budget.

    Ranked, packed, ranked again with names, packed again. Each text is looked
    at once, for the counts of both rankings and its size in tokens; from then
    on only numbers are shuffled. The texts of what is kept are joined by
    (groups, key), which names a chunk. Repeated rows count once.
    """
    terms, order = query_terms(query), [F.col("score").desc(), F.col(key)]
    sizes = chunks.withColumn("tokens", code_tokens("text"))
    if terms:
        sizes = sizes.withColumn("_a", term_counts(F.col("text"), terms)).withColumn("_b", term_counts(_named_text(), terms)).withColumn("_bonus", _bonus(terms))
    numbers = ["_a", "_b", "_bonus"] if terms else []
    measured = cut_lineage(sizes.select(*groups, key, "tokens", *numbers, F.xxhash64("text").alias("_h")).distinct().drop("_h"))
    if not terms:
        return packed(packed(measured.withColumn("score", F.lit(0.0)), groups, order, "tokens", budget).drop("used"), groups, order, "tokens", budget)
    first = _within(measured.select("*", F.col("_a.f").alias("_f"), F.col("_a.dl").alias("_dl")), groups, len(terms)).withColumn("score", F.round("score", 9))
    kept = packed(first, groups, order, "tokens", budget).drop("used", "score", "_f", "_dl")
    again = _within(kept.select("*", F.col("_b.f").alias("_f"), F.col("_b.dl").alias("_dl")), groups, len(terms))
    again = again.withColumn("score", F.round(F.col("score") + F.col("_bonus"), 9)).where("score > 0")
    return packed(again.select(*groups, key, "score", "tokens"), groups, order, "tokens", budget)
