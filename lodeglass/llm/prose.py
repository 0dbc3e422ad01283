"""Running prose told from lists, tables, code, logs and junk.

Each document gets statistics of its words, signs and lines
(`lodeglass.llm.prose_stats`). For every language the mean and covariance of
prose are estimated robustly over all documents; a document's squared
Mahalanobis distance from its language's prose, split into one contribution
per statistic, says how far it is from running text and why.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.llm.prose_stats import NAMES, Words, statistics
from lodeglass.session import cut_lineage, spread

N = len(NAMES)
#: Common words and labels read to the driver at most; both are hand-made tables.
MAX_WORDS, MAX_LABELS = 100_000, 100_000
#: Rounds of reweighting.
ROUNDS = 6
#: Shares of common words and of text that ends in punctuation from which a document takes part in the first estimate of prose.
SEED_COMMON, SEED_CLOSED = 0.25, 0.8
#: Share of common words from which a text's own language is trusted over the declared one.
SURE_COMMON = 0.12
#: Weight of the variances over all documents in the covariance of prose. Prose hardly varies in some statistics; the
#: shrinkage keeps these from drowning the others, at a scale that the data give.
SHRINKAGE = 0.01
#: Statistics of which half a document that isn't in sentences lacks half.
OF_SENTENCES = ["long_share", "spoken_share", "worded_share", "closed_share"]


def common_words(words: DataFrame) -> dict[str, frozenset[str]]:
    """Common words by language, in lower case; rows with nulls are left out."""
    rows = words.where("lang IS NOT NULL AND word IS NOT NULL").select(F.lower("lang"), F.lower("word")).limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} common words")
    by: dict[str, set[str]] = {}
    for lang, word in rows:
        by.setdefault(lang, set()).add(word)
    return {k: frozenset(v) for k, v in by.items()}


def text_statistics(documents: DataFrame, words: DataFrame, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, language, stats): the statistics of every document with a visible character.

    The language is the text's own by its common words, or, where the text
    has hardly any, the declared one in its short form; empty where neither
    is known. Null and blank texts and null ids give no row.
    """
    common = common_words(words)
    sure = NAMES.index("common_share")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words(common)
        for pdf in batches:
            rows = []
            for doc, text, declared in pdf.itertuples(index=False):
                found = statistics(text, known)
                if found is None:
                    continue
                own, values = found
                short = (declared or "").strip().lower().replace("_", "-").split("-")[0]
                rows.append((doc, own if values[sure] >= SURE_COMMON else short if short in common else "", values))
            yield pd.DataFrame(rows, columns=[doc_col, "language", "stats"])

    kind = documents.schema[doc_col].dataType.simpleString()
    kept = spread(documents.where(F.col(doc_col).isNotNull() & F.col(text_col).isNotNull()).select(doc_col, text_col, lang_col))
    return kept.mapInPandas(measure, f"`{doc_col}` {kind}, language string, stats array<double>")


@dataclass(frozen=True)
class Prose:
    """Mean and inverse covariance of one language's prose, and the weight of the documents behind it."""

    mean: np.ndarray
    inverse: np.ndarray
    weight: float

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Contributions of the statistics, a row per document; they sum to the squared distance."""
        d = x - self.mean
        return d * (d @ self.inverse)


def _weights(x: np.ndarray, model: Prose | None) -> np.ndarray:
    """Full weight up to twice the expected squared distance, falling from there, none beyond eight times."""
    if model is None:
        return ((x[:, NAMES.index("common_share")] >= SEED_COMMON) & (x[:, NAMES.index("closed_share")] >= SEED_CLOSED)).astype(float)
    d2 = model.distances(x).sum(axis=1)
    return np.where(d2 > 8 * N, 0.0, np.minimum(1.0, 2 * N / np.maximum(d2, 1e-9)))


_SUMS = ["w", *(f"s{i}" for i in range(N)), *(f"q{i}_{j}" for i in range(N) for j in range(i, N)), "n", *(f"t{i}" for i in range(N)), *(f"u{i}" for i in range(N))]


def _fit_once(stats: DataFrame, models: dict[str, Prose], shrinkage: float) -> dict[str, Prose]:
    """One pass over all documents: weighted and plain sums per batch and language, added up by Spark, one row per language to the driver."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for language, part in pdf.groupby("language"):
                x = np.stack(part["stats"].to_numpy()).astype(float)
                w = _weights(x, models.get(language))
                q = (w[:, None] * x).T @ x
                row = [w.sum(), *(w @ x), *q[np.triu_indices(N)], len(x), *x.sum(axis=0), *(x * x).sum(axis=0)]
                yield pd.DataFrame([[language, *row]], columns=["language", *_SUMS])

    partial = stats.where("language <> ''").select("language", "stats").mapInPandas(sums, "language string, " + ", ".join(f"{c} double" for c in _SUMS))
    rows = partial.groupBy("language").agg(*[F.sum(c).alias(c) for c in _SUMS]).collect()
    n = sum(r["n"] for r in rows) or 1.0
    first, second = (np.array([sum(r[f"{c}{i}"] for r in rows) for i in range(N)]) / n for c in "tu")
    overall = np.maximum(second - first**2, 1e-9)
    out = {}
    for row in rows:
        if row["w"] <= 0:
            continue
        mean = np.array([row[f"s{i}"] for i in range(N)]) / row["w"]
        second = np.zeros((N, N))
        second[np.triu_indices(N)] = [row[f"q{i}_{j}"] for i in range(N) for j in range(i, N)]
        second = second + np.triu(second, 1).T
        cov = (1 - shrinkage) * (second / row["w"] - np.outer(mean, mean)) + shrinkage * np.diag(overall)
        out[row["language"]] = Prose(mean, np.linalg.inv(cov), float(row["w"]))
    return out


def fit_prose(stats: DataFrame, rounds: int = ROUNDS, shrinkage: float = SHRINKAGE) -> dict[str, Prose]:
    """Robust mean and covariance of prose per language, by reweighting over all documents.

    The first round takes documents rich in common words that end in
    punctuation; each further round weighs every document by its distance from
    the estimate before. The covariance is shrunk towards the variances over
    all documents. Empty without any such document. Key '' holds the model of
    the language with most weight, for texts of no known language.
    """
    models: dict[str, Prose] = {}
    for _ in range(rounds):
        models = _fit_once(stats, models, shrinkage)
    if models:
        models[""] = max(models.values(), key=lambda m: m.weight)
    return models


def half_distance(models: dict[str, Prose]) -> float:
    """Squared distance of a document that is typical but for half its text, used where there are no labels."""
    if not models:
        return 1.0
    shift = np.array([-0.5 if n in OF_SENTENCES else 0.0 for n in NAMES])
    return float(shift @ models[""].inverse @ shift)


def prose_distances(stats: DataFrame, models: dict[str, Prose], doc_col: str = "doc_id") -> DataFrame:
    """(doc_id, language, distance, contributions): squared distance from prose, and each statistic's part in it.

    Texts of a language without a model are measured by the model of key ''.
    Without any model there are no rows.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for language, part in pdf.groupby("language"):
                parts = models.get(language, models[""]).distances(np.stack(part["stats"].to_numpy()).astype(float))
                yield part[[doc_col, "language"]].assign(distance=parts.sum(axis=1), contributions=list(parts))

    kind = stats.schema[doc_col].dataType.simpleString()
    source = stats if models else stats.where("false")
    return source.mapInPandas(measure, f"`{doc_col}` {kind}, language string, distance double, contributions array<double>")


def cutoff(distances: DataFrame, labels: DataFrame | None, half: float, doc_col: str = "doc_id", max_labels: int = MAX_LABELS) -> float:
    """The squared distance beyond which a document isn't prose.

    The one that agrees with most labels (``prose`` or ``other``): `half`, if
    that lies in a gap between labelled documents that does, else the middle
    of the nearest such gap on a logarithmic scale. At most `max_labels` labels are read, those of the
    least hash. Without labels of both kinds it is `half`.
    """
    if labels is None:
        return half
    known = labels.where("label IN ('prose', 'other')").select(doc_col, "label").orderBy(F.xxhash64(doc_col, "label")).limit(max_labels)
    rows = sorted((r["distance"], r["label"] == "other") for r in distances.select(doc_col, "distance").join(F.broadcast(known), doc_col).select("distance", "label").collect())
    others = sum(o for _, o in rows)
    if not others or others == len(rows):
        return half
    best, wrong = [], len(rows) - others
    for k, (d, other) in enumerate(rows):
        wrong += 1 if other else -1
        if k + 1 < len(rows) and rows[k + 1][0] > d:
            low, high = max(d, 1e-9), rows[k + 1][0]
            cut = half if low < half < high else math.sqrt(low * high)
            best.append((wrong, abs(math.log(cut / half)), cut))
    return min(best)[2] if best else half


def judged(documents: DataFrame, words: DataFrame, labels: DataFrame | None = None, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, language, distance, contributions, is_prose) of every document with a visible character."""
    stats = cut_lineage(text_statistics(documents, words, doc_col, text_col, lang_col))
    models = fit_prose(stats)
    distances = prose_distances(stats, models, doc_col)
    return distances.withColumn("is_prose", F.col("distance") <= F.lit(cutoff(distances, labels, half_distance(models), doc_col)))


def named(values: str, prefix: str = "") -> list:
    """The entries of a statistics array as columns."""
    return [F.col(values)[k].alias(f"{prefix}{n}") for k, n in enumerate(NAMES)]
