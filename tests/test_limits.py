"""Limits of the reports are parameters; each has a way without it."""

from helpers import rows
from pyspark.sql import functions as F

from lodeglass.functions.logs import dedupe_key
from lodeglass.functions.text import lines_of
from lodeglass.operators import chunk, logs, parse, symbols, units


def test_functions_and_classes_end_where_they_end(spark):
    body = "\n".join(f"  a({k});" for k in range(500))
    script, python = f"class A {{\n{body}\n}}\nfunction f() {{\n{body}\n}}", "def g():\n" + "\n".join(f"    a({k})" for k in range(500)) + "\nx = 1"
    df = spark.createDataFrame([(script, python)], "s string, p string")
    reach = lambda fn, c, **k: [u["end_line"] for u in df.select(fn(lines_of(c), **k).alias("u")).first()["u"] if u["name"] in "Afg"]
    assert reach(parse.brace_functions, "s") == [702] and reach(parse.brace_functions, "s", reach=None) == [1004]
    assert reach(parse.brace_classes, "s") == [200] and reach(parse.brace_classes, "s", reach=None) == [502]
    assert reach(parse.indent_functions, "p") == [300] and reach(parse.indent_functions, "p", reach=None) == [501]
    files = spark.createDataFrame([("a.js", "javascript", script), ("b.go", "go", "func a() {\n" + "x\n" * 100 + "}\nfunc b() {\n}")], "path string, language string, content string")
    assert rows(symbols.catalogue(files, ["path"], reach=units.WHOLE).where("name = 'f'"), "end_line") == [(1004,)]
    whole = chunk.index_chunks(files.where("path = 'b.go'"), ["path"], reach=units.WHOLE)
    assert rows(whole, "identifier", "start_line", "end_line") == [("a", 1, 102), ("b", 103, 104)]
    assert rows(chunk.index_chunks(files.where("path = 'b.go'"), ["path"]), "start_line", "end_line") == [(1, 60), (103, 104)]


def test_many_unclosed_blocks_take_little_time(spark):
    text = "\n".join("function f() {" for _ in range(40_000))
    found = units.brace_functions(text.split("\n"), units.Braces(text.split("\n")), None)
    assert len(found) == 40_000 and {u.end_line for u in found} == {40_000}


def test_alike_messages_beyond_the_first_characters(spark):
    df = spark.createDataFrame([("x" * 130 + "a",), ("x" * 130 + "b",)], "m string")
    assert df.select(F.count_distinct(dedupe_key(F.col("m")))).first()[0] == 1
    assert df.select(F.count_distinct(dedupe_key(F.col("m"), None))).first()[0] == 2


def test_all_signatures(spark):
    df = spark.createDataFrame([("\n".join(f"func f{k}() {{" for k in range(70)),)], "c string")
    size = lambda **k: df.select(F.size(parse.signatures(lines_of("c"), F.lit("go"), **k))).first()[0]
    assert size() == 50 and size(limit=None) == 70


def test_what_a_report_leaves_out_is_counted(spark):
    lines = [("a", k, f"ERROR word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxy'[k // 100]} broke") for k in range(450)] + [("a", 500 + k, "ERROR wordaku broke") for k in range(3)] + [("b", 1, "WARN x")]
    df = spark.createDataFrame(lines, "path string, line_no bigint, line string")
    assert logs.condensed(df).where("path = 'a'").count() == 100 and logs.condensed(df, entries=None, per_level=None).where("path = 'a'").count() == 450
    groups = logs.deduplicated(logs.trouble_lines(df))
    assert rows(logs.left_out(groups)) == [("a", 450, 100, 350, 350), ("b", 1, 1, 0, 0)]
