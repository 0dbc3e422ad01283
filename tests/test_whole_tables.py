"""Registered queries take in their whole tables. Expected rows are worked out here, without the queries' SQL."""

from helpers import at, rows

from lodeglass.operators import budget, graph
from lodeglass.plans import rank_queries, state_queries

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark, folder):
    data = [
        (1, "2024-01-01T00:00:00", 7, "view", 5.5), (2, "2024-01-01T10:00:00", 7, "click", 3.0), (3, "2024-01-02T09:00:00", 7, "error", 2.0),
        (4, "2024-01-03T09:00:00", 7, "view", 1.0), (5, "2024-01-01T00:00:00", 800, "purchase", 9.9), (6, "2024-01-05T00:00:00", 800, "error", 4.0),
    ]
    spark.createDataFrame([(k, at(t), u, e, v, None) for k, t, u, e, v in data], EVENTS).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_items_of_all_owners_and_types_are_merged(spark, tmp_path):
    got = state_queries.budget_session_merge(spark, events(spark, tmp_path))
    assert rows(got) == [("7/click", 3, 9), ("7/error", 2, 9), ("7/view", 5, 9), ("800/error", 4, 9), ("800/purchase", 9, 9)]


def test_session_files_that_no_item_names_are_added(spark):
    items = spark.createDataFrame([("a", 1, 9), ("a", 2, 9)], "label string, tokens bigint, priority int")
    files = spark.createDataFrame([("a", 7), ("b", 3)], "item string, tokens bigint")
    assert rows(budget.with_session_files(items, files)) == [("a", 1, 9), ("a", 2, 9), ("b", 3, 5)]


def test_events_of_all_types_are_put_into_sessions(spark, tmp_path):
    folder = events(spark, tmp_path)
    got = rows(state_queries.sessionize_24h(spark, folder), "event_id", "session_no")
    assert got == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 1), (6, 2)]
    totals = state_queries.session_totals(spark, folder)
    assert rows(totals, "owner", "session_no", "reads", "items", "tokens") == [(7, 1, 3, 3, 10), (7, 2, 1, 1, 1), (800, 1, 1, 1, 9), (800, 2, 1, 1, 4)]


def test_imports_of_a_small_tree_that_names_its_files_in_all_ways(spark):
    files = [("r", p) for p in ("src/a.ts", "src/b.ts", "src/lib/index.ts", "src/lib/c.tsx", "src/d.js", "py/e.py", "top.ts")]
    edges = [("r", "src/a.ts", t) for t in ("./b", "./lib", "./lib/c.js", "../top", "./d.js", "./d", "./missing", "react", "../src/./b")] + [("r", "py/e.py", ".e"), ("r", "src/lib/c.tsx", "..")]
    got = graph.resolved(spark.createDataFrame(edges, "root string, path string, target string"), spark.createDataFrame(files, "root string, path string"))
    want = {"./b": "src/b.ts", "./lib": "src/lib/index.ts", "./lib/c.js": "src/lib/c.tsx", "../top": "top.ts", "./d.js": "src/d.js", "./d": "src/d.js", "../src/./b": "src/b.ts"}
    assert rows(got, "root", "path", "target", "file") == sorted((("r", "src/a.ts", t, f) for t, f in want.items()), key=repr)


def test_imports_of_the_tables_are_resolved(spark, tmp_path):
    code = [
        ("src/a.ts", "/r", "typescript", "import { x } from './b.js';\nimport y from '../lib/c';\nimport z from './gone';\nimport q from 'react';"),
        ("src/b.ts", "/r", "typescript", None), ("src/b.ts", "/other", "typescript", "import a from './a';"),
    ]
    spark.createDataFrame(code, "path string, root string, language string, content string").write.parquet(f"{tmp_path}/code_files.parquet")
    spark.createDataFrame([("/r", "lib/c.ts"), ("/r", "src/a.ts")], "root_path string, path string").write.parquet(f"{tmp_path}/project_map.parquet")
    got = rows(rank_queries.resolve_imports(spark, str(tmp_path)), "root", "path", "target", "file")
    assert got == [("/r", "src/a.ts", "../lib/c", "lib/c.ts"), ("/r", "src/a.ts", "./b.js", "src/b.ts"), ("samples", "src/gauge.ts", "./clock", "src/clock.ts")]


def test_documents_without_path_or_source_are_judged(spark, tmp_path):
    docs = [(1, "x " * 4, "s", "a.log"), (2, "word " * 9000, "s", None), (3, "y", None, "b"), (8, "z", None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, path string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(state_queries.context_budget(spark, str(tmp_path)), "priority", "label", "advice")
    assert got == [(1, "a.log", "consider-removing"), (2, "", "consider-removing"), (3, "b", "keep"), (8, "", "keep")]
