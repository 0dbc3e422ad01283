import random
import re

from helpers import rows
from pyspark.sql import functions as F

from lodeglass import config
from lodeglass.functions.text import lines_of
from lodeglass.operators import chunk, graph, parse, symbols

SERVICE = """import { a } from './a';
import b from "pkg/b";
import './side';
export interface Result { ok: boolean }
export type Id = string;
const enum Kind { A }

export class Failure extends Error {
  constructor(m: string) { super(m); }
}

export abstract class Store {
  private items = [];
  public async load(id: Id) {
    if (id) {
      return this.find(id);
    }
  }
  find(id) { return '{'; }
  static of() { return new Store(); }
}

export const twice = (x: number) => x * 2;
export const later = async x =>
  x + 1;

function one() { return 1; }
export async function two<T>(
  x: T,
) {
  return x;
}
"""
PYTHON = """import os
from a.b import c
import x.y as z

def top(a):
    if a:

        return 1

async def other():
    def inner():
        pass
    return inner

class Thing(Base):
    '''doc'''

    def method(self):
        return top(1)

    async def more(self):
        pass
x = 1
"""
OTHERS = {
    "m.go": "package m\nimport (\nfunc Plain(a int) {\n}\nfunc (s *Srv) Handle(w int) {\n}\n",
    "M.java": "import java.util.List;\npublic class M {\n    public static int size(int a) {\n    }\n}\n",
    "m.rs": "use std::io;\npub async fn run<T>(x: T) {\n}\npub struct S;\n",
    "m.rb": "require 'x'\nclass K\n  def go\n  end\n  def stop(a)\n  end\nend\n",
    "m.txt": "function foo(a)\nnothing\n",
}


def files(spark, entries):
    from lodeglass.functions.text import language_of

    df = spark.createDataFrame(list(entries.items()), "path string, content string")
    return df.withColumn("language", language_of("path"))


def spans(spark, content, fn):
    df = spark.createDataFrame([(content,)], "c string")
    return [(r["name"], r["start_line"], r["end_line"]) for r in df.select(fn(lines_of("c")).alias("u")).first()["u"]]


def brute_brace(content):
    """Names and extents, line by line and sign by sign."""
    lines, out = content.split("\n"), []
    for i, line in enumerate(lines):
        name = next((m[1] for p in parse.BRACE_FUNCTIONS if (m := re.match(p, line)) and m[1] not in config.NO_FUNCTION), None)
        if name is None:
            continue
        depth, opened, end = 0, False, min(i + 200, len(lines)) - 1
        for j in range(i, min(i + 200, len(lines))):
            for c in lines[j]:
                depth += {"{": 1, "}": -1}.get(c, 0)
                opened |= c == "{"
            if opened and depth <= 0 or not opened and j > i and (not lines[j].strip() or lines[j].strip().endswith(";")):
                end = j
                break
        out.append((name, i + 1, end + 1))
    return out


def brute_indent(content):
    lines, out = content.split("\n"), []
    for i, line in enumerate(lines):
        if m := re.match(parse.INDENT_FUNCTION, line):
            end = i
            for j in range(i + 1, min(i + 300, len(lines))):
                if lines[j].strip() and not lines[j][0].isspace() and j > i + 1:
                    break
                end = j
            out.append((m[1], i + 1, end + 1))
    return out


def test_brace_functions(spark):
    got = spans(spark, SERVICE, parse.brace_functions)
    assert got == brute_brace(SERVICE)
    assert {n for n, _, _ in got} == {"load", "find", "of", "twice", "later", "one", "two"}


def test_random_files(spark):
    rng = random.Random(11)
    pieces = ["function f(a) {", "  go(x) {", "}", "  }", "const g = (a) => {", "const h = x => x;", "", "  return a;", "  if (a) {", "'{'", "class A {", "def p(a):", "    q = 1", "async def r():", "  }}", "x"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.choice([3, 20, 60, 450]))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, c string")
    got = df.select("k", parse.brace_functions(lines_of("c")).alias("b"), parse.indent_functions(lines_of("c")).alias("i")).collect()
    for r in got:
        assert [(u["name"], u["start_line"], u["end_line"]) for u in r["b"]] == brute_brace(texts[r["k"]])
        assert [(u["name"], u["start_line"], u["end_line"]) for u in r["i"]] == brute_indent(texts[r["k"]])


def test_long_blank_lines_are_no_trap(spark):
    assert spans(spark, " " * 50_000 + "x\n" + "\t" * 50_000, parse.brace_functions) == []


def test_classes_and_methods(spark):
    df = spark.createDataFrame([(SERVICE, PYTHON)], "s string, p string")
    row = df.select(parse.brace_classes(lines_of("s")).alias("s"), parse.indent_classes(lines_of("p")).alias("p")).first()
    assert [(c["name"], c["start_line"], c["end_line"], c["methods"]) for c in row["s"]] == [("Failure", 8, 10, []), ("Store", 12, 33, ["load", "find", "of"])]
    assert [(c["name"], c["start_line"], c["end_line"], c["methods"]) for c in row["p"]] == [("Thing", 15, 22, ["method", "more"])]


def test_indent_functions(spark):
    assert spans(spark, PYTHON, parse.indent_functions) == brute_indent(PYTHON) == [("top", 5, 9), ("other", 10, 14)]


def test_docstring(spark):
    df = spark.createDataFrame([('x = 1\n"""a\nb """\n',), ("'''one'''",), ("none",)], "c string")
    assert [r[0] for r in df.select(parse.docstring(F.col("c"))).collect()] == ["a\nb", "one", None]


def test_imports(spark):
    edges = graph.import_edges(files(spark, {"s.ts": SERVICE, "p.py": PYTHON, **OTHERS}), ["path"])
    assert rows(edges, "path", "position", "target") == sorted(
        [("s.ts", 1, "./a"), ("s.ts", 2, "pkg/b"), ("p.py", 1, "os"), ("p.py", 2, "a.b"), ("p.py", 3, "x.y"), ("m.go", 1, "import ("), ("M.java", 1, "import java.util.List;"), ("m.rs", 1, "use std::io;"), ("m.rb", 1, "require 'x'")], key=repr
    )
    assert rows(graph.in_degree(edges).where("degree > 1")) == []


def test_signatures(spark):
    df = files(spark, OTHERS)
    got = {r["path"]: r["s"] for r in df.select("path", parse.signatures(lines_of("content"), F.col("language")).alias("s")).collect()}
    assert got == {
        "m.go": ["func Plain(a int) {", "func (s *Srv) Handle(w int) {"], "M.java": ["public class M {", "public static int size(int a) {"],
        "m.rs": ["pub async fn run<T>(x: T) {", "pub struct S;"], "m.rb": ["class K", "def go", "def stop(a)"], "m.txt": ["function foo(a)"],
    }


def test_unit_chunks(spark):
    got = chunk.index_chunks(files(spark, {"s.ts": SERVICE, "p.py": PYTHON, "m.go": OTHERS["m.go"], "a.md": "\n".join("x" * 130)}), ["path"])
    by = {}
    for p, t, i, a, b in rows(got, "path", "chunk_type", "identifier", "start_line", "end_line"):
        by.setdefault(p, []).append((t, i, a, b))
    assert ("class", "Failure", 8, 10) in by["s.ts"] and ("class", "Store", 12, 33) in by["s.ts"] and ("function", "one", 27, 27) in by["s.ts"]
    assert sorted(by["p.py"]) == [("class", "Thing", 15, 22), ("function", "other", 10, 14), ("function", "top", 5, 9)]
    assert sorted(by["m.go"]) == [("function", "", 5, 7), ("function", "Plain", 3, 7)]
    assert sorted(x[2:] for x in by["a.md"]) == [(1, 60), (51, 110), (101, 130)]
    text = {r["identifier"]: r["text"] for r in got.where("path = 'p.py'").collect()}
    assert text["top"] == "\n".join(PYTHON.split("\n")[4:9])
    assert rows(chunk.extract_by_name(got, "STORE", ["path"]), "path", "start_line") == [("s.ts", 12)]


def test_class_inside_a_function_is_covered(spark):
    code = "function f() {\nclass A {\n}\n}\nclass B {\n"
    got = chunk.index_chunks(files(spark, {"s.js": code, "empty.js": "x", "none.py": ""}), ["path"])
    assert rows(got, "path", "chunk_type", "identifier") == [("empty.js", "block", None), ("none.py", "block", None), ("s.js", "class", "B"), ("s.js", "function", "f")]


def test_sections_and_windows(spark):
    df = spark.createDataFrame([("a", "\n".join(map(str, range(61))))], "path string, content string")
    assert rows(chunk.chunks(df, ["path"], chunk.section_spans), "start_line", "end_line") == [(1, 30), (31, 60), (61, 61)]
    small = chunk.chunks(df, ["path"], lambda x: chunk.window_spans(x, 50, 5))
    assert rows(small, "start_line", "end_line") == [(1, 50), (46, 61)]


def test_catalogue(spark):
    got = symbols.catalogue(files(spark, {"s.ts": SERVICE, "p.py": PYTHON, **OTHERS}), ["path"])
    kinds = {(p, n): (k, a, c) for p, n, k, a, c in rows(got, "path", "name", "kind", "line", "container")}
    assert kinds["s.ts", "load"] == ("method", 14, "Store") and kinds["s.ts", "Result"] == ("interface", 4, None) and kinds["s.ts", "Kind"] == ("enum", 6, None)
    assert kinds["p.py", "method"] == ("method", 18, "Thing") and kinds["p.py", "top"][0] == "function"
    assert kinds["m.go", "Handle"] == ("function", 5, None) and kinds["M.java", "size"] == ("function", 3, None) and kinds["m.rs", "run"] == ("function", 2, None) and kinds["m.rb", "stop"][1] == 5
    assert len(rows(got)) == len({(p, n, a) for p, n, a in rows(got, "path", "name", "line")})


def test_find_and_counts(spark):
    data = [("a.ts", "typescript", "loadUser", "method", 3), ("b.ts", "typescript", "LoadUser", "function", 9), ("c.py", "python", "preloadUsers", "class", 1), ("d.py", "python", "userThing", "function", 2), ("/app2/x", "go", "loaduser", "class", 1), ("e", "go", "other", "class", 1)]
    df = spark.createDataFrame(data, "path string, language string, name string, kind string, line int")
    order = lambda *a, **k: [r["path"] for r in symbols.find(df, *a, **k).collect()]
    assert order("loadUser") == ["/app2/x", "b.ts", "a.ts", "c.py"]
    assert order("load_user") == ["b.ts", "c.py", "d.py", "a.ts"][:1] + order("load_user")[1:]
    assert order("user", kind="function") == ["b.ts", "d.py"] and order("user", kind="nonsense") == order("user") and order("user", limit=1) == ["/app2/x"]
    assert order("loaduser", root="/app") == [] and order("loaduser", language="python") == ["c.py"]
    assert [r["line"] for r in symbols.outline(df, "d.py").collect()] == [2]
    counts = {(r["kind"], r["language"]): r["symbols"] for r in symbols.counts(df).collect()}
    assert counts[None, None] == 6 and counts["class", None] == 3 and counts[None, "python"] == 2


def test_refresh(spark):
    before = files(spark, {"a.py": "def x():\n    pass\n", "b.py": "def y():\n    pass\n", "gone.py": "def z():\n    pass\n"})
    after = files(spark, {"a.py": "def x():\n    pass\n", "b.py": "def y2():\n    pass\n", "new.py": "def n():\n    pass\n"})
    from lodeglass.functions.text import content_hash

    state, todo = symbols.refresh(after, symbols.catalogue(before, ["path"]), before.select("path", content_hash("content").alias("hash")))
    assert rows(state, "path", "name") == [("a.py", "x"), ("b.py", "y2"), ("new.py", "n")] and rows(todo, "path") == [("b.py",), ("new.py",)]
    assert rows(state) == rows(symbols.catalogue(after, ["path"]))
    counted = symbols.index_state(after.withColumn("root", F.lit("r")), symbols.catalogue(after.withColumn("root", F.lit("r")), ["root", "path"]), F.lit("2025-01-01").cast("timestamp_ntz"))
    assert rows(counted, "file_path", "symbol_count") == [("r/a.py", 1), ("r/b.py", 1), ("r/new.py", 1)]


def test_reachable_and_resolved(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), ("a", "c"), ("x", "y")], "src string, dst string")
    assert rows(graph.reachable(edges, spark.createDataFrame([("a",)], "node string"), 2)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(graph.reachable(edges, spark.createDataFrame([], "node string"), 2)) == []
    assert rows(graph.nodes(edges, "src", "dst")) == [(x,) for x in "abcdxy"]
    assert rows(graph.imported_by(edges, "src", "dst").where("dst = 'c'")) == [("c", ["a", "b"])]
