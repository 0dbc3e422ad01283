"""Mixing sources to target weights, with a cap on how often a source repeats.

Sizes are tokens of a public tokenizer. The plan is a capped water-filling
over the table of targets; the sample takes each document a whole number of
times and a seeded share of them once more.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeglass.session import spread

#: Rank file of the tokenizer; a parameter everywhere.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the rank files' vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters handed to the tokenizer at once; longer texts are counted in parts, cut at the next place where no pre-token can go on.
PART_CHARS = 20_000
#: A single blank between letters or digits begins a pre-token, whatever stands around.
_BORDER = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: Sources that a plan may have; the targets are a configuration, not data.
MAX_SOURCES = 100_000


@lru_cache(maxsize=4)
def _encoding(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART_CHARS and (border := _BORDER.search(text, at + PART_CHARS)):
        yield text[at:border.start()]
        at = border.start()
    yield text[at:]


def count_tokens(text: Column | str, ranks: str = RANKS) -> Column:
    """Tokens of a text; 0 for null and empty text. Special tokens' names are ordinary text.

    The rank file is shipped to the executors. A text without a blank between
    words is handed to the tokenizer whole.
    """
    SparkSession.active().sparkContext.addFile(ranks)
    name = os.path.basename(ranks)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(SparkFiles.get(name)).encode_ordinary
        return texts.map(lambda t: sum(len(encode(p)) for p in _parts(t)) if t else 0).astype("int64")

    return count(text)


def source_key(source: Column | str) -> Column:
    """Sources are compared trimmed and in lower case; a blank one is none."""
    col = F.col(source) if isinstance(source, str) else source
    return F.nullif(F.lower(F.regexp_replace(col, r"^\s+|\s+$", "")), F.lit(""))


def sized_documents(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ranks: str = RANKS) -> DataFrame:
    """(doc_id, source, tokens)."""
    return spread(documents.select(doc_col, text_col, source_col)).select(F.col(doc_col).alias("doc_id"), source_key(source_col).alias("source"), count_tokens(text_col, ranks).alias("tokens"))


@dataclass(frozen=True)
class SourcePlan:
    """What one source contributes. `epochs` is how often its tokens pass, a whole and a fractional part."""

    source: str
    weight: float
    max_repeats: int
    available: int
    desired: float
    planned: float

    @property
    def capacity(self) -> int:
        return self.available * self.max_repeats

    @property
    def reaches_share(self) -> bool:
        """Whether the plan gives the source its share; one that is clamped below it doesn't, and rounding is no shortage."""
        return self.planned >= self.desired * (1 - 1e-9)

    @property
    def epochs(self) -> float:
        return self.planned / self.available if self.available else 0.0


def water_fill(targets: list[tuple[str, float, int]], available: dict[str, int], budget: float) -> list[SourcePlan]:
    """Capped water-filling.

    Each source starts with its weight's share of the budget. Those that can't
    hold theirs even when repeated as often as allowed are clamped there, and
    what they leave goes to the others in proportion to their weights, until
    all fit or all are clamped.
    """
    capacity = {s: available.get(s, 0) * r for s, _, r in targets}
    weight = {s: w for s, w, _ in targets}
    planned, rest, open_ = {}, float(budget), {s for s in weight if weight[s] > 0}
    while open_:
        total = sum(weight[s] for s in sorted(open_))
        full = {s for s in open_ if capacity[s] <= rest * weight[s] / total}
        if not full:
            planned |= {s: rest * weight[s] / total for s in open_}
            break
        planned |= {s: float(capacity[s]) for s in full}
        rest -= sum(capacity[s] for s in sorted(full))
        open_ -= full
    return [SourcePlan(s, w, r, available.get(s, 0), w * budget, planned.get(s, 0.0)) for s, w, r in targets]


def source_totals(sized: DataFrame, targets: DataFrame) -> tuple[list[tuple[str, float, int]], dict[str, int], int]:
    """Targets, tokens of each of their sources, and tokens of all documents, in one pass over the sizes.

    Only sources of the targets come to the driver, and one total. Targets are
    compared like sources; a null weight counts as 0, a null or negative
    max_repeats as 1 and 0; of a source listed twice the greatest row counts.
    """
    wanted = targets.select(
        source_key("source").alias("source"), F.coalesce("target_weight", F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("r"),
    ).where("source IS NOT NULL").groupBy("source").agg(F.max(F.struct("w", "r")).alias("t"))
    rows = wanted.select("source", "t.w", "t.r").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    plan = sorted((r["source"], float(r["w"]), int(r["r"])) for r in rows)
    names = [s for s, _, _ in plan]
    # sources that no target names are one group, so that only as many rows as targets reach the driver
    known = F.broadcast(sized.sparkSession.createDataFrame([(s,) for s in names], "known string"))
    sums = sized.join(known, sized["source"] == known["known"], "left").groupBy(F.col("known").alias("source")).agg(F.sum("tokens").alias("tokens"))
    found = {r["source"]: int(r["tokens"] or 0) for r in sums.collect()}
    return plan, {s: found.get(s, 0) for s in names}, sum(found.values())


def mix_plan(sized: DataFrame, targets: DataFrame, budget: float | None = None) -> list[SourcePlan]:
    """The plan for a mix of `budget` tokens; as many as all documents have, if none is given."""
    plan, available, total = source_totals(sized, targets)
    return water_fill(plan, available, total if budget is None else budget)


def plan_table(spark, plan: list[SourcePlan]) -> DataFrame:
    mixed = sum(p.planned for p in plan) or 1.0
    rows = [
        (p.source, p.weight, p.max_repeats, p.available, p.capacity, p.desired, p.planned, p.epochs, p.planned / mixed, p.reaches_share)
        for p in plan
    ]
    schema = (
        "source string, target_weight double, max_repeats int, tokens bigint, capacity bigint, desired double, "
        "planned double, epochs double, share double, reaches_share boolean"
    )
    return spark.createDataFrame(rows, schema)


def sample_mix(sized: DataFrame, plan: list[SourcePlan], seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each document enters the mix, at least once.

    Every document of a source comes the whole number of its epochs times. For
    the fraction, documents are taken in the order of a seeded hash until
    their tokens reach it: a histogram over the hash's leading bits finds the
    cell where that happens, and only that cell is walked document by
    document. The same seed gives the same sample on any cluster.
    """
    spark = sized.sparkSession
    epochs = spark.createDataFrame(
        [(p.source, int(p.epochs), (p.epochs - int(p.epochs)) * p.available) for p in plan if p.planned > 0], "source string, whole int, extra double",
    )
    docs = sized.join(F.broadcast(epochs), "source").withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id")))
    docs = docs.withColumn("_cell", F.shiftrightunsigned("_h", 52))
    cells = docs.groupBy("source", "_cell").agg(F.sum("tokens").alias("_n"))
    before = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # at most 4096 rows a source
    placed = docs.join(base, ["source", "_cell"])
    cut = F.when((F.col("_base") < F.col("extra")) & (F.col("_base") + F.col("_n") > F.col("extra")), F.lit(-1))
    # cells that are wholly in or out get a partition each, by hash, so that no window holds more than the cut cell
    walk = Window.partitionBy("source", F.coalesce(cut, F.col("_h"))).orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("tokens").over(walk), F.lit(0))
    more = F.when(cut.isNotNull(), F.col("_base") + within < F.col("extra")).otherwise(F.col("_base") + F.col("_n") <= F.col("extra"))
    return placed.select("doc_id", "source", "tokens", (F.col("whole") + more.cast("int")).alias("copies")).where("copies > 0")


def mix_report(sample: DataFrame, plan: list[SourcePlan]) -> DataFrame:
    """(source, target_weight, mixed_tokens, actual_share, most_copies) of a sample, beside its targets."""
    spark = sample.sparkSession
    sums = sample.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    wanted = F.broadcast(spark.createDataFrame([(p.source, p.weight) for p in plan], "source string, target_weight double"))
    joined = wanted.join(sums, "source", "left").fillna(0, ["mixed_tokens", "most_copies"])
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # one row per target source
    share = F.when(total > 0, F.col("mixed_tokens") / total).otherwise(0.0)
    return joined.select("source", "target_weight", "mixed_tokens", share.alias("actual_share"), "most_copies")


def short_sources(spark, plan: list[SourcePlan]) -> DataFrame:
    """(source): those that can't reach their share even when repeated as often as allowed."""
    return spark.createDataFrame([(p.source,) for p in plan if not p.reaches_share], "source string")
