import math
from collections import Counter

import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from lodeglass.operators import budget, diff, logs, projectmap, rank, search, sessions, tasks
from lodeglass.sources import files as fs
from lodeglass.sources.store import KeyedTable


# -- search ------------------------------------------------------------------
def test_search(spark):
    df = spark.createDataFrame([("a.ts", "one\n Token x\n\ntwo\ntokens\n"), ("b.py", "nothing"), ("c.ts", None), ("d.ts", "TOKEN")], "path string, content string")
    got = search.matching_lines(df, "token", context_lines=1)
    assert rows(got) == [("a.ts", 2, "Token x", ["one"]), ("a.ts", 5, "tokens", ["two"]), ("d.ts", 1, "TOKEN", [])]
    assert rows(search.matching_lines(df, "token", case_sensitive=True), "path") == [("a.ts",)]
    assert rows(search.matching_lines(df, "token", extensions=[".py"])) == []
    assert rows(search.matching_lines(df, r"^two$"), "line") == [("two",)] and rows(search.matching_lines(df, r"x$"), "line") == [("Token x",)]
    assert [r["line_no"] for r in search.first_matches(got, limit=1).collect()] == [2]
    assert rows(search.matches_by_file(got)) == [("a.ts", 2), ("d.ts", 1)] and rows(search.match_totals(got)) == [(3, 2)]
    with pytest.raises(ValueError):
        search.matching_lines(df, "(")


# -- logs --------------------------------------------------------------------
def test_condensed_log(spark):
    lines = [f"2024-01-01 00:00:{k:02d} ERROR timeout after {k} ms" for k in range(42)] + ["FATAL out of memory", "warn: low", "fine", "ERROR other"]
    df = spark.createDataFrame([("f", k, x) for k, x in enumerate(lines, 1)] * 2 + [("f", 99, None)], "path string, line_no bigint, line string")
    got = logs.condensed(df)
    assert rows(got, "line_no", "level", "occurrences", "last_line_no") == [(1, "ERROR", 42, 42), (43, "FATAL", 1, 43), (44, "WARN", 1, 44), (46, "ERROR", 1, 46)]
    assert rows(logs.condensed(df, per_level=1), "line_no") == [(1,), (43,), (44,)] and rows(logs.condensed(df, entries=2), "line_no") == [(1,), (43,)]
    context = {r["line_no"]: r["context"] for r in logs.with_context(got, df, 1).collect()}
    assert context[44] == ["FATAL out of memory", "fine"] and context[46] == ["fine"]
    assert rows(logs.condensed(df.where("false"))) == []


# -- ranking -----------------------------------------------------------------
def bm25(docs, terms):
    counts = [Counter(d) for d in docs]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    out = []
    for c, d in zip(counts, docs):
        s = 0.0
        for t in terms:
            df = sum(t in x for x in counts)
            if c[t]:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(d) / max(avg, 1)))
        out.append(s)
    return out


def test_bm25(spark):
    texts = ["alpha beta beta", "beta gamma", "delta", "", "alpha alpha alpha beta gamma delta"]
    df = spark.createDataFrame([(k, k % 2, t) for k, t in enumerate(texts)], "id int, g int, t string")
    want = bm25([t.split() for t in texts], ["alpha", "beta"])
    got = {r["id"]: r["score"] for r in rank.scored(df, "t", "alpha, beta").collect()}
    assert [got[k] for k in range(5)] == pytest.approx(want)
    assert {r["id"] for r in rank.ranked(df, "t", "alpha beta").collect()} == {0, 1, 4}
    own = {r["id"]: r["score"] for r in rank.scored_within(df, ["g"], "t", "alpha beta").collect()}
    assert [own[k] for k in (0, 2, 4)] == pytest.approx(bm25([texts[k].split() for k in (0, 2, 4)], ["alpha", "beta"]))
    assert {r["score"] for r in rank.scored(df, "t", "the").collect()} == {0.0}
    assert rows(rank.scored(df.where("false"), "t", "alpha")) == [] and rows(rank.document_frequencies(df, "id", "t"), "term", "df")[0] == ("alpha", 2)


def test_packing_stops_at_the_first_overrun(spark):
    data = [("hot", k, (k * 37) % 11 + 1) for k in range(500)] + [("big", 1, 100), ("big", 2, 1), ("none", 1, 31)]
    df = spark.createDataFrame(data, "g string, k int, t int")
    for salts in (1, 7, 64):
        got = {}
        for g, k, _, used in rows(rank.packed(df, ["g"], [F.col("t"), F.col("k")], "t", 30, salts)):
            got.setdefault(g, []).append((used, k))
        want = {}
        for g in ("hot", "big", "none"):
            used = 0
            for t, k in sorted((t, k) for h, k, t in data if h == g):
                used += t
                if used > 30:
                    break
                want.setdefault(g, []).append((used, k))
        assert {g: sorted(x) for g, x in got.items()} == want


def test_packing_keeps_order_over_an_overrun(spark):
    df = spark.createDataFrame([("g", k, t) for k, t in enumerate([5, 50, 1, 1, 1])], "g string, k int, t int")
    assert rows(rank.packed(df, ["g"], [F.col("k")], "t", 20), "k") == [(0,)]


def test_smart_read(spark):
    parts = [("f", 1, 1, "function", "loginUser", "return token"), ("f", 2, 60, "block", None, "login login"), ("f", 3, 70, "block", None, "zzz"), ("g", 1, 1, "class", "X", "nothing")]
    df = spark.createDataFrame(parts, "path string, chunk_no int, start_line int, chunk_type string, identifier string, text string")
    got = {(r["path"], r["chunk_no"]): r["score"] for r in rank.reranked(df, ["path"], "login loginUser").collect()}
    assert got["f", 1] > 8 and 0 < got["f", 2] < 2 and ("f", 3) not in got and got["g", 1] == pytest.approx(0.8)
    assert rows(rank.smart_read(df, ["path"], "login", 4), "path", "chunk_no") == [("f", 2), ("g", 1)]


# -- maps, diffs, budgets, tasks ---------------------------------------------
def test_project_map(spark):
    df = spark.createDataFrame([("r", "a.ts", 10), ("r", "a.ts", 12), ("r", "x/b.py", None), (None, "c", 1), ("s", "Makefile", 3)], "root_path string, path string, line_count bigint")
    entries = projectmap.scanned_entries(df)
    assert rows(projectmap.by_language(entries)) == [("other", 1, 3, 30), ("python", 1, 0, 0), ("typescript", 1, 12, 120)]
    assert rows(projectmap.by_directory(entries), "root", "folder", "files") == [("r", ".", 1), ("r", "x", 1), ("s", ".", 1)] and rows(projectmap.totals(entries)) == [(3, 15, 150)]


def test_differences(spark):
    frame = lambda d: spark.createDataFrame([(p, x) for p, t in d.items() for x in t.split("\n")], "path string, line string")
    before, after = frame({"same": "a\nb", "moved": "a\nb", "gone": "x\nx", "more": "y"}), frame({"same": "a\nb", "moved": "b\na", "new": "n", "more": "y\ny\nz"})
    assert rows(diff.line_changes(before, after, ["path"])) == [("gone", "x", "-", 2), ("more", "y", "+", 1), ("more", "z", "+", 1), ("new", "n", "+", 1)]
    assert rows(diff.changed_lines(before, after, ["path"])) == [("gone", 0, 2), ("more", 2, 0), ("new", 1, 0)]
    pairs = spark.createDataFrame([("m", "a\nb", "b\na"), ("n", None, "x"), ("s", "q", "q")], "path string, before string, after string")
    got = rows(diff.hunks(pairs, ["path"]), "path", "hunk_no", "text")
    assert [g[0] for g in got] == ["m", "n"] and "-b" in got[0][2] and "+x" in got[1][2]


def test_budgets(spark):
    items = [("a", 10_000, None), ("a", 10_001, None), ("a", 20_001, 8), ("catalog", 5, None), ("block", 5, 1), ("Lock.log", 5, 1), ("x", 1500, 9)]
    got = budget.judged_items(spark.createDataFrame(items, "label string, tokens bigint, priority int"))
    assert [r["advice"] for r in got.collect()] == ["keep", "consider-removing", "keep", "consider-removing", "remove", "consider-removing", "keep"]
    assert got.collect()[6]["reason"] == "1.5k tokens" and got.collect()[2]["reason"] == "Very large (20.0k tokens)"
    levels = spark.createDataFrame([(79_999, 125_999), (80_000, 126_000), (149_999, 153_000), (150_000, 171_000)], "t bigint, w bigint")
    assert [tuple(r) for r in levels.select(budget.budget_status(F.col("t")), budget.watch_level(F.col("w"))).collect()] == [("ok", "safe"), ("warning", "warning"), ("warning", "critical"), ("critical", "emergency")]


def test_tasks(spark):
    df = spark.createDataFrame([("p", s) for s in ["done", "done", "done", "pending", "in_progress", "blocked"]] + [("q", "skipped")], "project string, status string")
    assert rows(tasks.progress(df, ["project"]), "project", "total", "done", "skipped", "percent") == [("p", 6, 3, 0, 50), ("q", 1, 0, 1, 0)]
    schema = "project string, decisions array<string>, observations array<string>, files_changed array<string>, notes string"
    old, new = spark.createDataFrame([("p", ["a", "b"], ["o"], ["f"], "n"), ("x", ["a"], None, None, "k")], schema), spark.createDataFrame([("p", ["b", "c"], ["o"], None, None), ("y", ["z"], ["w"], [], "m")], schema)
    assert rows(tasks.merged_checkpoints(old, new, "project")) == [("p", ["a", "b", "c"], ["o", "o"], ["f"], "n"), ("x", ["a"], [], [], "k"), ("y", ["z"], ["w"], [], "m")]


# -- sessions ----------------------------------------------------------------
def test_sessions_at_the_edge(spark):
    times = ["2024-01-01T00:00:00", "2024-01-01T23:59:59.999999", "2024-01-02T23:59:59.999999", "2024-01-03T23:59:59.999998", "2024-01-05T00:00:00"]
    df = spark.createDataFrame([("o", k, at(t), k) for k, t in enumerate(times)] + [("o", 9, None, 1), (None, 8, at(times[0]), 1), ("p", 7, at(times[0]), 1)], "owner string, k int, t timestamp_ntz, tokens int")
    got = {k: s for k, s in rows(sessions.with_sessions(df, "owner", "t"), "k", "session_no")}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 7: 1}  # exactly 24 hours part, a microsecond less doesn't
    totals = sessions.session_totals(df, "owner", "t", "k", "tokens")
    assert rows(totals, "owner", "session_no", "reads", "tokens") == [("o", 1, 2, 1), ("o", 2, 2, 5), ("o", 3, 1, 4), ("p", 1, 1, 1)]
    assert rows(sessions.session_files(df, "owner", "t", "k", "tokens"), "owner", "k") == [("o", 4), ("p", 7)]


def test_freshness_and_purging(spark):
    files = spark.createDataFrame([("a", "AB"), ("b", "1"), ("c", None)], "path string, hash string")
    cache = spark.createDataFrame([("a", "ab"), ("b", "2"), ("c", None)], "path string, hash string")
    assert rows(sessions.freshness(files, cache)) == [("a", "fresh"), ("b", "changed"), ("c", "fresh")]
    assert rows(sessions.freshness(files, cache.where("false"))) == [("a", "unread"), ("b", "unread"), ("c", "unread")]
    parents = spark.createDataFrame([("x", at("2024-01-01")), ("y", at("2024-01-02"))], "k string, t timestamp_ntz")
    left, kids = sessions.purge(parents, spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int"), ["k"], "t", F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))
    assert rows(left, "k") == rows(kids, "k") == [("y",)]


# -- sources -----------------------------------------------------------------
def test_scans(spark, tmp_path):
    names = ["a.ts", ".hidden.ts", "node_modules/x.ts", "src/b.py", "src/.git/c.py", ".github/d.yml", ".claude/e.md", ".other/f.ts", "yarn.lock", "package-lock.json", "1/2/3/4/5/6/g.go", "1/2/3/4/5/6/7/8/9/h.go", "big.ts", "notes.txt", "src/.dot/i.ts"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x" * (5 * 1024 * 1024) if n == "big.ts" else b"one\ntwo\xff")
    scan = lambda rules: [r[0] for r in rows(fs.scan_tree(spark, str(tmp_path), rules), "path")]
    assert scan(fs.SEARCH_SCAN) == ["1/2/3/4/5/6/g.go", "a.ts", "notes.txt", "src/b.py"]
    assert scan(fs.MAP_SCAN) == [".claude/e.md", ".github/d.yml", "1/2/3/4/5/6/7/8/9/h.go", "1/2/3/4/5/6/g.go", "a.ts", "big.ts", "notes.txt", "src/b.py"]
    assert scan(fs.SYMBOL_SCAN) == [".hidden.ts", ".other/f.ts", "1/2/3/4/5/6/7/8/9/h.go", "1/2/3/4/5/6/g.go", "a.ts", "src/b.py"]
    assert scan(fs.GRAPH_SCAN) == ["a.ts", "big.ts", "package-lock.json", "src/b.py"]
    assert scan(fs.ScanRules(8, extensions=(".py",))) == ["src/b.py"]
    content = fs.scan_tree(spark, str(tmp_path), fs.ScanRules(8, extensions=(".py",))).first()["content"]
    assert content.startswith("one\ntwo")
    lines = fs.file_lines(spark.createDataFrame([("p", "a\n"), ("q", None)], "path string, content string"), ["path"])
    assert rows(lines) == [("p", 1, "a"), ("p", 2, "")]


def test_keyed_table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], "k string, v int")
    frame = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    assert t.count() == 0
    t.upsert(frame(("a", 1), ("b", 2)))
    t.upsert(frame(("a", 3), ("c", None)))
    assert rows(t.read()) == [("a", 3), ("b", 2), ("c", None)] and rows(t.get(k="a")) == [("a", 3)]
    t.delete(frame(("b", 0)))
    assert t.delete_where(F.col("v") == 3) == 1 and t.delete_where(F.lit(False)) == 0
    t.compact()
    assert rows(t.read()) == [("c", None)] and len(t._parts()) == 1
    t.upsert(frame(("a", 9)))
    assert rows(t.read()) == [("a", 9), ("c", None)]


def test_tables_of_the_schema(spark, tmp_path):
    from lodeglass import schema

    for name in schema.TABLES:
        assert schema.open_table(spark, str(tmp_path), name).count() == 0
    tasks_table = schema.open_table(spark, str(tmp_path), "tasks")
    tasks_table.upsert(spark.createDataFrame([("t1", "Title", ["d"])], "id string, title string, decisions array<string>"))
    assert [(r["id"], r["decisions"], r["tasks"]) for r in tasks_table.get(id="t1").collect()] == [("t1", ["d"], None)]


def test_joins_of_hot_keys(spark):
    from lodeglass.session import broadcast_if_small, join_small_or_salted

    left = spark.createDataFrame([("hot" if k % 3 else f"k{k}", k) for k in range(300)], "k string, n int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3)], "k string, m int")
    small, salted = join_small_or_salted(left, right, ["k"]), join_small_or_salted(left, right, ["k"], max_rows=1, salts=7)
    assert rows(small) == rows(salted) and len(rows(small)) == 401 and small.columns == salted.columns
    assert rows(broadcast_if_small(right, 1)) == rows(right)


def test_recall(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    cache = spark.createDataFrame([("a", "1", "S", 10), ("b", "9", "T", 20)], "path string, hash string, summary string, token_estimate bigint")
    assert rows(sessions.recalled(now, cache)) == [("a", "fresh", "S", 10), ("b", "changed", None, None), ("c", "unread", None, None)]
    plans = spark.createDataFrame([("fresh", 10), ("changed", 10), ("fresh", 2001)], "s string, t int")
    assert [r[0] for r in plans.select(sessions.read_plan(F.col("s"), F.col("t"))).collect()] == ["summary", "whole", "chunks"]
