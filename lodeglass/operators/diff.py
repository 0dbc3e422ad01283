"""Differences between two versions of files, line by line."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, change, n): lines by how many more the one version has than the other; ``+`` or ``-``.

    `before` and `after` have keys and line, one row per line. Both sides are
    counted before they meet, so that a line that fills a file costs one row.
    """
    each = before.select(*keys, "line", F.lit(-1).alias("d")).unionAll(after.select(*keys, "line", F.lit(1).alias("d")))
    sums = each.groupBy(*keys, "line").agg(F.sum("d").alias("d")).where("d <> 0")
    return sums.select(*keys, "line", F.when(F.col("d") > 0, "+").otherwise("-").alias("change"), F.abs("d").alias("n"))


def changed_lines(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, added, removed)"""
    changes = line_changes(before, after, keys)
    n = lambda sign: F.coalesce(F.sum(F.when(F.col("change") == sign, F.col("n"))), F.lit(0))
    return changes.groupBy(*keys).agg(n("+").alias("added"), n("-").alias("removed"))


def hunks(pairs: DataFrame, keys: list[str], before: str = "before", after: str = "after", context: int = 3) -> DataFrame:
    """(keys, hunk_no, header, text): unified hunks of two contents in one row; a missing version counts as empty.

    Where lines stand matters here, which no set operation says; it is the
    one place in this module that leaves the JVM, a batch of rows at a time.
    """
    kept = pairs.select(*keys, F.coalesce(before, F.lit("")).alias("_b"), F.coalesce(after, F.lit("")).alias("_a")).where("_a <> _b")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keys) + ", hunk_no int, header string, text string"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *key, b, a in pdf[[*keys, "_b", "_a"]].itertuples(index=False):
                found: list[list[str]] = []
                for line in list(difflib.unified_diff(b.split("\n"), a.split("\n"), lineterm="", n=context))[2:]:
                    if line.startswith("@@"):
                        found.append([line])
                    else:
                        found[-1].append(line)
                rows += [(*key, k, h[0], "\n".join(h[1:])) for k, h in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=[*keys, "hunk_no", "header", "text"])

    return kept.mapInPandas(cut, schema)
