import random

import pytest
from helpers import at, rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeglass import config
from lodeglass.functions import logs, text


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in df.orderBy("k").select(expr(F.col("x"))).collect()]


IDENTIFIERS = {
    "loginUser": ["loginuser", "login", "user"], "AuthService": ["authservice", "auth", "service"], "get_user_id": ["get_user_id", "get", "user", "id"],
    "HTTPSConnection": ["httpsconnection", "https", "connection"], "__": ["__"], "_foo": ["_foo", "foo"], "x1Y2": ["x1y2", "x1", "y2"], "": [], "a": ["a"],
}


def test_identifier_tokens(spark):
    assert column(spark, list(IDENTIFIERS), text.identifier_tokens) == list(IDENTIFIERS.values())
    assert {x: text.identifier_tokens_of(x) for x in IDENTIFIERS} == IDENTIFIERS


@given(st.text("aAbBzZ019_-$. ", max_size=12))
def test_identifier_tokens_on_the_driver(name):
    got = text.identifier_tokens_of(name)
    assert len(got) == len(set(got)) and all(t == t.lower() for t in got) and (not name or got[0] == name.lower())


def test_driver_and_cluster_agree(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("aAbBcC01_-. ") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    assert column(spark, names, text.identifier_tokens) == [text.identifier_tokens_of(n) for n in names]


def test_document_terms_keep_repeats(spark):
    got = column(spark, ["the loginUser, loginUser a b1! Schöpf"], text.document_terms)[0]
    assert got == ["loginuser", "login", "user", "loginuser", "login", "user", "b1", "sch", "pf"]


def test_query_terms():
    assert text.query_terms("JWT token, for the loginUser get_user!") == ["jwt", "token", "loginuser", "get_user", "get", "user"]
    assert text.query_terms("the a") == text.query_terms("") == []


def test_tokens(spark):
    assert column(spark, ["", "abc", "abcde"], text.text_tokens) == [0, 1, 2]
    assert column(spark, ["", "\n", "// long comment here", "\t# c", "    x = 1\n\n  \n"], text.code_tokens) == [2, 4, 2, 2, 3 + 6]
    assert column(spark, [999, 1000, 1250, 123456], text.token_label, "int") == ["999", "1.0k", "1.3k", "123.5k"]
    df = spark.createDataFrame([(0, 5), (200, 199), (1000, 995), (8, 20)], "a int, b int")
    assert [r[0] for r in df.select(text.percent_saved("a", "b")).collect()] == [0, 1, 1, -150]


def test_lines_and_trim(spark):
    assert column(spark, ["", "a\n", "a\r\nb"], text.lines_of) == [[""], ["a", ""], ["a\r", "b"]]
    assert column(spark, ["\xa0\ufeff x \u2003\n"], text.trimmed) == ["x"]


def test_paths(spark):
    paths = ["a/b.tsx", "b.PY", ".env", "a.b/c", "x.d.ts", "Makefile", "a/.gitignore"]
    assert column(spark, paths, text.language_of) == ["typescript", "python", "plaintext", "plaintext", "typescript", "plaintext", "plaintext"]
    assert column(spark, paths, text.directory) == ["a", ".", ".", "a.b", ".", ".", "a"]
    names = ["index.ts", "x/foo.test.ts", "app.config.js", "types.ts", "my.service.ts", "README.md", "a.ts", "a.xyz", "package.json"]
    assert column(spark, names, lambda p: text.describe(p, text.language_of(p, "other"))) == ["entry point", "tests", "configuration", "types/models", "service", "documentation", "typescript", "file", "npm package config"]


def test_redaction(spark):
    got = column(spark, ["a <private>x</private> b", "<PRIVATE>\nx</Private><private>y</private>", "<private>open"], text.redacted)
    assert got == ["a <private>[redacted]</private> b", "<private>[redacted]</private>" * 2, "<private>open"]


def test_truncate_and_round(spark):
    assert column(spark, ["abc", "abcd"], lambda x: text.truncated(x, 3)) == ["abc", "ab…"]
    assert column(spark, [2.5, -2.5, 0.49], text.js_round, "double") == [3, -2, 0]
    assert column(spark, [at("2025-01-01T00:00:29"), at("2025-01-01T00:00:30")], lambda x: text.minutes_ago(x, F.lit("2025-01-01 00:01:00").cast("timestamp_ntz")), "timestamp_ntz") == [1, 1]


def test_summaries(spark):
    data = [("export class A extends B {\n}\nexport const x = 1\n", "typescript"), ("def f(a):\n  pass\nclass C:\n", "python"), ("x\ny\n", "go"), ("no exports", "javascript")]
    df = spark.createDataFrame(data, "c string, l string")
    got = [r[0] for r in df.select(text.summary_of("c", "l")).collect()]
    assert got == ["4 lines. Exports: export class A extends B, export const x = 1", "4 lines. Defines: f, C:", "3 lines. Starts: x\ny", "1 lines. Starts: no exports"]


def test_hash(spark):
    assert column(spark, ["abc"], text.content_hash) == ["ba7816bf8f01cfea"]


LINES = ["FATAL x", "an error: y", "ErrorX", "Exceptions", "deprecated", "DEPRECATION", "x_error", "éerror", "Traceback (most", "info", "Error:x", "warning!", "critical ERROR"]


def test_levels(spark):
    assert column(spark, LINES, logs.line_level) == ["FATAL", "ERROR", None, None, "WARN", None, None, "ERROR", "ERROR", None, "ERROR", "WARN", "FATAL"]


def test_dedupe_key(spark):
    uid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    got = column(spark, [f"2024-01-01T00:00:00,123 job 17 {uid} é12 x1", uid.upper(), "a" * 200], logs.dedupe_key)
    assert got[0] == "<TIME> job <N> <UUID> é<N> x1" and "<UUID>" not in got[1] and len(got[2]) == config.DEDUPE_CHARS


def test_display(spark):
    got = column(spark, ["  at 10.0.0.1   https://x.y/z /usr/lib/a.so /tmp/ \xa0end"], logs.display_message)
    assert got == ["at <IP> <URL> a.so end"]


def test_line_kinds(spark):
    stack = ["    at foo (x.js:1)", '  File "a.py", line 3', "  a.b(C.java:3)", "  #1 0xff", "goroutine 7 [x", "  from a/b.rb:3", "  [1] 0xab", "at x"]
    assert column(spark, stack, logs.is_stack_line) == [True] * 7 + [False]
    assert column(spark, ["... 3 more", "same error", "x"], logs.is_repetition) == [True, True, False]
    assert column(spark, ["[12:00:00]", "2024-01-01 00:00:00", "12:00:00"], logs.has_time) == [True, True, False]
    kinds = ['{"level":"x","msg":"m"}', "a=1", "plain", '{"a": 1} tail', '"x": 1', "12", ""]
    assert column(spark, kinds, logs.line_format) == ["json", "logfmt", "plain", "plain", "plain", "json", "plain"]
    assert [tuple(r) if r else None for r in column(spark, kinds[:3], logs.json_fields)] == [("x", "m"), None, None]



@pytest.mark.parametrize("size", [0, 1, 2])
def test_context(spark, size):
    df = spark.createDataFrame([(["a", " ", "b ", "c", ""],)], "x array<string>")
    got = df.select(*[text.context_around(F.col("x"), F.lit(k), size) for k in range(1, 6)]).first()
    lines = ["a", " ", "b ", "c", ""]
    want = [[x.strip() for j, x in enumerate(lines, 1) if abs(j - k) <= size and j != k and x.strip()] for k in range(1, 6)]
    assert list(got) == want


def test_rows_helper(spark):
    assert rows(spark.createDataFrame([(2,), (1,)], "a int")) == [(1,), (2,)]


def test_keys_and_relative_paths(spark):
    df = spark.createDataFrame([("/a/b/c.ts", "/a/b/", 1), ("/a/bc", "/a/b", None), ("x", "/", 2)], "p string, r string, n int")
    got = [tuple(r) for r in df.select(text.relative_path("p", "r"), text.compound_key("p", "n")).collect()]
    assert got == [("c.ts", "/a/b/c.ts|1"), ("/a/bc", None), ("x", "x|2")]
