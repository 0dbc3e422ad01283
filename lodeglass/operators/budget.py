"""Token budgets: what items cost, how full the context is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass import config
from lodeglass.functions.text import js_round, token_label
from lodeglass.operators.search import top_per_group


def judged_items(items: DataFrame, label: str = "label", tokens: str = "tokens", priority: str = "priority") -> DataFrame:
    """`items` with `advice` (keep, consider-removing, remove) and `reason`, a code or else the size; a missing priority counts as 5."""
    n, name = F.col(tokens), F.lower(label)
    log, lock = F.contains(name, F.lit("log")), F.contains(name, F.lit("lock"))
    advice = (
        F.when(F.coalesce(F.col(priority), F.lit(5)) >= 8, "keep").when(n > 10_000, "consider-removing").when(log, "consider-removing").when(lock, "remove").otherwise("keep")
    )
    size = lambda text: F.concat(F.lit(f"{text} ("), token_label(n), F.lit(" tokens)"))
    reason = F.when(n > 20_000, size("Very large")).when(n > 10_000, size("Large")).when(log, "log").when(lock, "lock").otherwise(F.concat(token_label(n), F.lit(" tokens")))
    return items.withColumn("advice", advice).withColumn("reason", reason)


def with_session_files(items: DataFrame, files: DataFrame, label: str = "label", tokens: str = "tokens", priority: str = "priority") -> DataFrame:
    """`items` with the session's files that none of them names."""
    more = files.select(F.col("item").alias(label), F.col("tokens").alias(tokens), F.lit(5).alias(priority))
    return items.select(label, tokens, priority).unionByName(more.join(items.select(label).distinct(), label, "left_anti").select(label, tokens, priority))


def budget_status(total: Column) -> Column:
    return F.when(total >= config.BUDGET_CRITICAL, "critical").when(total >= config.BUDGET_WARNING, "warning").otherwise("ok")


def recommended(judged: DataFrame, groups: list[str], order: list[Column], tokens: str = "tokens", label: str = "label", names: int = 3) -> DataFrame:
    """(groups, status, removable, percent, names): what each budget that isn't ok could save, and its first items to remove, in order."""
    totals = budget_totals(judged, groups, tokens).where("status <> 'ok'")
    gone = top_per_group(judged.where("advice <> 'keep'").select(*groups, F.col(label).alias("_label"), F.struct(*order).alias("_o")), groups, [F.col("_o")], names)
    listed = gone.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("_o", "_label"))).alias("_n")).select(*groups, F.col("_n._label").alias("names"))
    saved = js_round(F.col("removable") / F.greatest(F.col("tokens"), F.lit(1)) * 100)
    return totals.withColumn("percent", saved).join(listed, groups, "left").select(*groups, "status", "removable", "percent", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def budget_totals(judged: DataFrame, groups: list[str], tokens: str = "tokens") -> DataFrame:
    """(groups, tokens, percent, status, removable)"""
    removable = F.coalesce(F.sum(F.when(F.col("advice") != "keep", F.col(tokens))), F.lit(0))
    sums = judged.groupBy(*groups).agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), removable.alias("removable"))
    return sums.select(*groups, "tokens", js_round(F.col("tokens") / config.BUDGET_CRITICAL * 100).alias("percent"), budget_status(F.col("tokens")).alias("status"), "removable")


def watch_level(tokens: Column) -> Column:
    share = tokens / config.CONTEXT_LIMIT
    return (
        F.when(share >= config.WATCH_EMERGENCY, "emergency").when(share >= config.WATCH_CRITICAL, "critical").when(share >= config.WATCH_WARNING, "warning").otherwise("safe")
    )


def watched(totals: DataFrame, tokens: str = "tokens", extra: int = 0) -> DataFrame:
    """`totals` with `used`, `percent` of the context and `level`."""
    used = F.col(tokens) + extra
    return totals.withColumn("used", used).withColumn("percent", js_round(used / config.CONTEXT_LIMIT * 100)).withColumn("level", watch_level(used))
