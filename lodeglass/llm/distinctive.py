"""How characteristic each term of a record is of that record (BM25 weights).

Collection statistics (number of records, document frequencies, average
length) cover all records. Nothing but two numbers and the frequencies of
very common terms, of which there can only be few, leaves the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.session import cut_lineage

K1, B = 1.5, 0.75

#: A term held by at least this share of the records is joined by broadcast. Each record has `a` distinct terms on
#: average, so at most ``a / HOT_SHARE`` terms can be that common, however many records there are.
HOT_SHARE = 0.001


def _deliveries(docs: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    lowered = F.transform(F.col(tokens_col), lambda x: F.lower(x))
    kept = F.filter(lowered, lambda x: x.isNotNull() & (x != ""))
    return docs.select(F.col(id_col).alias("id"), kept.alias("tokens")).where("id IS NOT NULL AND size(tokens) > 0")


def records(docs: DataFrame, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """(id, tokens): one row per record that has tokens; lower case, without null and empty ones.

    Of several deliveries of a record the longest token list counts, the
    greatest of equally long ones (they should be equal). Rows without id are
    left out. Other columns are ignored.
    """
    longest = F.max(F.struct(F.size("tokens").alias("n"), "tokens")).alias("r")
    return _deliveries(docs, id_col, tokens_col).groupBy("id").agg(longest).select("id", F.col("r.tokens").alias("tokens"))


def collection_size(docs: DataFrame, id_col: str = "id", tokens_col: str = "tokens") -> tuple[int, float]:
    """Number of records with tokens, and their average length; only ids and lengths are shuffled."""
    lengths = _deliveries(docs, id_col, tokens_col).select("id", F.size("tokens").alias("n")).groupBy("id").agg(F.max("n").alias("n"))
    n, average = lengths.agg(F.count(F.lit(1)), F.avg("n")).first()
    return n, average or 1.0


def term_weights(docs: DataFrame, id_col: str = "id", tokens_col: str = "tokens", k1: float = K1, b: float = B) -> DataFrame:
    """(id, term, f, df, n_records, score): every term of every record with its weight.

    f is the term's count in the record, df the number of records that hold
    it. The score is ``ln(1 + (N - df + 0.5) / (df + 0.5)) * f * (k1 + 1) /
    (f + k1 * (1 - b + b * length / average length))``, rounded to nine
    places so that ties are ties on any cluster. An empty table, or one with
    nothing but empty lists, gives no rows.
    """
    n, avgdl = collection_size(docs, id_col, tokens_col)
    tf = (
        records(docs, id_col, tokens_col)
        .select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
        .groupBy("id", "dl", "term")
        .agg(F.count(F.lit(1)).alias("f"))
    )
    df = cut_lineage(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # read twice: for common terms, and for all
    hot = df.where(F.col("df") >= F.lit(n * HOT_SHARE)).withColumnRenamed("df", "hot_df")
    marked = tf.join(F.broadcast(hot), "term", "left")
    # Rows of common terms have their frequency by now; a key of their own spreads them over all tasks.
    key = F.when(F.col("hot_df").isNull(), F.concat(F.lit("t"), F.col("term"))).otherwise(F.concat(F.lit("r"), F.hex(F.xxhash64("id"))))
    rest = df.select(F.concat(F.lit("t"), F.col("term")).alias("_key"), "df")
    joined = marked.withColumn("_key", key).join(rest, "_key", "left").withColumn("df", F.coalesce("hot_df", "df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = F.col("dl") / F.lit(avgdl)
    score = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * length))
    return joined.select("id", "term", "f", "df", F.lit(n).cast("bigint").alias("n_records"), F.round(score, 9).alias("score"))


def most_telling(weights: DataFrame, min_df: int = 2, rare_share: float = 0.05) -> DataFrame:
    """(id, term, score): the best shared term of each record.

    Terms held by fewer than `min_df` records don't compete. A record none of
    whose competing terms is held by fewer than `rare_share` of the records
    gives no row. Of equal scores the least term wins.
    """
    rare = (F.col("df") < F.col("n_records") * F.lit(rare_share)).cast("int")
    # the least negative score is the greatest score, and beside it the least term
    best = (
        weights.where(F.col("df") >= min_df)
        .groupBy("id")
        .agg(F.min(F.struct((-F.col("score")).alias("negative"), "term")).alias("best"), F.max(rare).alias("rare"))
    )
    return best.where("rare = 1").select("id", F.col("best.term").alias("term"), (-F.col("best.negative")).alias("score"))

