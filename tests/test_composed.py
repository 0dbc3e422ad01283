"""Operators put together: reads of files, lookups with a fallback, graphs from imports, snapshots, stores, ledgers."""

import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from lodeglass.functions.text import is_changed, normal_path, resolved_path
from lodeglass.operators import budget, chunk, graph, incremental, search, symbols, tasks
from lodeglass.sources.store import KeyedTable
from lodeglass.streaming import reads as stream

FILES = "root string, path string, language string, content string"


def test_a_name_without_a_unit_falls_back_to_the_best_chunk(spark):
    code = "function load(a) {\n  return a;\n}\nfunction store(cache) {\n  return cache.load(1);\n}\n"
    other = "function first(x) {\n  return x;\n}\nfunction second(x) {\n  return load(x) + load(x);\n}\n"
    df = spark.createDataFrame([("r", "a.js", "javascript", code), ("r", "b.js", "javascript", other), ("r", "c.js", "javascript", "function f() {\n}")], FILES)
    got = chunk.extract(chunk.index_chunks(df, ["root", "path"]), "load", ["root", "path"])
    assert rows(got, "path", "identifier", "exact") == [("a.js", "load", True), ("b.js", "second", False)]


def test_file_and_project_graphs(spark):
    files = [("r", "a.ts", "typescript", "import x from './b';\nimport y from 'react';"), ("r", "b.ts", "typescript", "import c from './c';"), ("r", "c.ts", "typescript", "import d from './d';\nimport a from './a';"), ("r", "d.ts", "typescript", "")]
    df = spark.createDataFrame(files, FILES)
    edges = graph.import_edges(df, ["root", "path"])
    start = spark.createDataFrame([("r/a.ts",)], "node string")
    assert rows(graph.file_graph(edges, df, start, 2)) == [("r/a.ts", 0, 2, 0), ("r/b.ts", 1, 1, 1), ("r/c.ts", 2, 2, 1)]
    nodes = {r[0]: r[1:] for r in rows(graph.project_nodes(edges, df))}
    assert nodes["r/a.ts"] == (2, 0) and nodes["./b"] == (0, 1) and nodes["react"] == (0, 1) and nodes["r/d.ts"] == (0, 0) and len(nodes) == 9
    assert rows(graph.sources_of(edges.where("target = './a'"))) == [("./a", "c.ts")]


def test_paths_and_changes(spark):
    df = spark.createDataFrame([("a/../b/./c",), ("/x//y/..",), ("..\\q",), ("",)], "p string")
    assert [r[0] for r in df.select(normal_path("p")).collect()] == ["b/c", "/x", "q", ""]
    assert [r[0] for r in df.select(resolved_path("p", F.lit("/base"))).collect()] == ["/base/b/c", "/x", "/q", "/base"]
    changed = spark.createDataFrame([("1", "1", "a", "b"), ("1", "2", "A", "a"), ("1", "2", "a", "b"), ("1", "2", None, "b")], "s string, t string, h string, i string")
    assert [r[0] for r in changed.select(is_changed(F.col("s"), F.col("t"), F.col("h"), F.col("i"))).collect()] == [False, False, True, True]


def test_patterns_are_those_of_the_engine_that_runs_them(spark):
    df = spark.createDataFrame([("a", "één\nplain"), ("b", "x")], "path string, content string")
    assert rows(search.matching_lines(df, r"^\p{L}{3}$"), "line") == [("één",)]
    with pytest.raises(ValueError):
        search.matching_lines(df, r"(?P<x>a)")
    plan = search.matching_lines(df, r"\b(?:plain|x)s?\b")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE(content" in plan and rows(search.matching_lines(df, r"\b(?:plain|x)s?\b"), "path", "line") == [("a", "plain"), ("b", "x")]


def test_recommendations_and_snapshots(spark):
    items = [("s", f"f{k}.log", 30_000 + k, 5) for k in range(6)] + [("s", "keep", 10, 9), ("t", "x", 10, 5)]
    judged = budget.judged_items(spark.createDataFrame(items, "source string, label string, tokens bigint, priority int"))
    got = budget.recommended(judged, ["source"], [-F.col("tokens")])
    assert rows(got) == [("s", "critical", 180_015, 100, ["f5.log", "f4.log", "f3.log"])]
    reads = spark.createDataFrame([("o", at("2024-01-01"), "a", 5), ("o", at("2024-01-05"), "a", 7), ("o", at("2024-01-05T01:00:00"), "b", None)], "owner string, read_at timestamp_ntz, item string, tokens bigint")
    made = tasks.snapshots(reads, "owner", "read_at", "item", "tokens")
    assert rows(made) == [("o", "checkpoint", "2 files, 7 tokens", 5, ["a", "b"], at("2024-01-05T01:00:00"))]
    assert rows(tasks.most_recent(reads, "read_at", "item", 1), "item") == [("b",)]


def test_refresh_counts_and_invalidation(spark):
    frame = lambda *x: spark.createDataFrame(list(x), "path string, hash string")
    got = symbols.changed_counts(frame(("a", "1"), ("b", "9"), ("n", "3")), frame(("a", "1"), ("b", "2"), ("gone", "4")))
    assert rows(got) == [(3, 2, 1, 1, 1, 1)]
    assert rows(symbols.without_file(frame(("a", "1"), ("b", "2")), "a")) == [("b", "2")]
    entries = spark.createDataFrame([("f", "r", 3, at("2025-01-01")), ("f", "r", 5, at("2025-01-02")), ("g", "r", None, at("2025-01-03"))], "file_path string, root_path string, symbol_count bigint, indexed_at timestamp_ntz")
    assert rows(symbols.file_stats(entries, ["root_path"])) == [("r", 2, 5, at("2025-01-03"))]


def test_store_with_writers_at_the_same_time(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], "k string, v int")
    row = lambda k, v: spark.createDataFrame([(k, v)], "k string, v int")
    t.upsert(row("a", 1))
    stale = t._parts()
    other = KeyedTable(spark, t.folder, ["k"], t.schema)
    other._parts = lambda: stale  # has listed the folder before the next write
    t.upsert(row("b", 2))
    other.upsert(row("c", 3))
    assert rows(t.read()) == [("a", 1), ("b", 2), ("c", 3)]
    before = t._parts()
    t._parts = lambda: before
    KeyedTable(spark, t.folder, ["k"], t.schema).upsert(row("a", 7))  # lands while the table is compacted
    t.compact()
    assert rows(other.__class__(spark, t.folder, ["k"], t.schema).read()) == [("a", 7), ("b", 2), ("c", 3)]
    fresh = KeyedTable(spark, t.folder, ["k"], t.schema)
    assert not fresh.has_changed("v", 7, k="a") and fresh.has_changed("v", 8, k="a") and fresh.has_changed("v", 8, k="zz")
    assert [r["k"] for r in fresh.latest("v", 2).collect()] == ["a", "c"]


def test_ledger_tombstones_compaction_and_runs_at_the_same_time(spark, tmp_path):
    frame = lambda *x: spark.createDataFrame(list(x), "path string, hash string")
    ledger, work = incremental.Ledger(spark, str(tmp_path / "job")), lambda df: df.select("path")
    assert ledger.run("r1", frame(("a", "1"), ("b", "2"), ("c", "3")), work)
    assert ledger.run("r2", frame(("a", "1"), ("c", "9")), work, complete=True)
    assert rows(ledger.manifest()) == [("a", "1"), ("c", "9")] and rows(ledger.current_output(), "path", "batch") == [("a", "r1"), ("c", "r2")]
    ledger.compact("one")
    assert rows(ledger.manifest()) == [("a", "1"), ("c", "9")] and rows(ledger.current_output(), "path", "batch") == [("a", "r1"), ("c", "r2")]
    assert ledger._live() == ["snapshot.one"]
    # a run that began before another, and ended after it: the later commit counts, whatever its hash
    slow = incremental.Ledger(spark, ledger.root)

    def meanwhile(df):
        assert ledger.run("fast", frame(("a", "zz")), work)
        return df.select("path")

    assert slow.run("slow", frame(("a", "bb"), ("b", "2")), meanwhile)
    assert rows(ledger.manifest()) == [("a", "bb"), ("b", "2"), ("c", "9")]
    ledger.compact("two")
    assert rows(ledger.manifest()) == [("a", "bb"), ("b", "2"), ("c", "9")] and len(ledger._live()) == 1
    with pytest.raises(ValueError):
        ledger.run("snapshot.x", frame(("a", "1")), work)


def test_a_stream_that_begins_anew_skips_nothing(spark, tmp_path):
    schema, ledger = "path string, hash string", incremental.Ledger(spark, str(tmp_path / "job"))
    for k, data in enumerate(([("a", "1")], [("b", "2")])):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        writer = stream.index_stream(spark.readStream.schema(schema).parquet(str(tmp_path / f"in{k}")), ledger, lambda df: df.select("path"))
        writer.option("checkpointLocation", str(tmp_path / f"cp{k}")).trigger(availableNow=True).start().awaitTermination()
    assert rows(ledger.output(), "path") == [("a",), ("b",)]
