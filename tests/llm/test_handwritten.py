import re

import pytest
from helpers import rows

from lodeglass.llm import handwritten as hw

FILES = "root_path string, path string, language string, line_count bigint, kind string, content string"
TEXTS = "path string, root string, language string, content string, reason string"
CODE = "import { a } from './b.js';\n\nexport function f(x) {\n    return a(x) + 1;\n}\n"


def classified(spark, entries, extra=()):
    files = [(r, p, "typescript", n, "k", "c") for r, p, n, _ in entries]
    texts = [(p, r, "typescript", t, "y") for r, p, _, t in [*entries, *extra]]
    return {(r, p): k for r, p, k, _ in rows(hw.classify(spark.createDataFrame(files, FILES), spark.createDataFrame(texts, TEXTS)))}


PLAIN = [
    ("src/generator/a.ts", CODE), ("src/vendor_portal/a.ts", CODE), ("src/a.minutes.ts", CODE), ("src/minify_a.js", CODE), ("src/autogenerate_b.py", "def f():\n    pass\n"),
    ("a.ts", "// Copyright the x team. Internal use.\n" + CODE), ("b.ts", "// Ids here are generated by the router; do not edit the order of the calls below.\n" + CODE),
    ("c.ts", "// Wraps the foo library (1.2.3) for the window view.\n" + CODE), ("d.ts", CODE + "const notice = 'Code generated by x. DO NOT EDIT.';\n"),
    ("e.yml", "a: 601\nb: 12\nc: 13\nd: 14\ne: 15\nf: 3\n"), ("f.md", "# Title\n\n" + "word " * 200), ("g.ts", "export * from './x.js';"), ("h.ts", None), ("i.ts", ""),
    ("j.ts", "// " + "a long remark about things " * 20 + "\n" + CODE),
]
OTHERS = [
    ("generated", "src/gen/a.ts", CODE), ("generated", "src/Generated/a.cs", CODE), ("generated", "a_pb2.py", CODE), ("generated", "x/a.pb.go", CODE), ("generated", "a.Designer.cs", CODE), ("generated", "bGrpc.java", CODE),
    ("generated", "c.ts", "// Code generated by foo. DO NOT EDIT.\n" + CODE), ("generated", "d.ts", "﻿/*\r\n * AUTO-GENERATED FILE,\r\n * edits are overwritten\r\n */\r\n" + CODE),
    ("generated", "e.py", "#!/usr/bin/env python\n# Owner: core\n# -----\n# Automatically created from a.idl - please\n# change the template instead\nx = 1\n"), ("generated", "f.cs", '// <auto-generated source="x" />\n' + CODE),
    ("generated", "g.ts", "// THIS FILE WAS PRODUCED BY FOO V1.2; MANUAL CHANGES WILL BE LOST.\n" + CODE),
    ("vendored", "third_party/x/a.ts", CODE), ("vendored", "lib/ThirdParty/a.ts", CODE), ("vendored", "libs/foo-1.2.3/a.ts", CODE), ("vendored", "h.ts", "/*! foo 1.2.3 https://foo.example/licence */\n" + CODE),
    ("vendored", "i.py", "# foo v1.2.3 | (c) the foo authors | MIT\nx = 1\n"), ("vendored", "j.go", "// Originally part of foo 2.3.4. Redistributed under the terms of its licence.\npackage a\n"),
    ("minified", "k.min.js", CODE), ("minified", "app.1234abcd.chunk-9.js", None), ("minified", "web/l.js", "!function(e){\"use strict\";m=e(735)}(y);var f=!t&&w[51];" * 20),
    ("data", "m.ts", "const x = [\n" + "  1, 2, 3, 4,\n" * 20), ("data", "n.java", "var b = new byte[] {\n" + "0xeb, 0xde, 0x21,\n" * 20), ("data", "o.py", 'x = "' + "aB3/" * 100), ("data", "p.go", "t = {\n" + '  "abc": [-1.5, 2.25],\n' * 9),
]


def test_what_is_written_by_hand_and_what_not(spark):
    entries = [("/r", p, 10, t) for p, t in PLAIN] + [(f"/{k}", p, 10, t) for k, p, t in OTHERS]
    got = classified(spark, entries)
    assert {x: k for x, k in got.items() if x[0] == "/r"} == {("/r", p): None for p, _ in PLAIN}
    assert {x: k for x, k in got.items() if x[0] != "/r"} == {(f"/{k}", p): k for k, p, _ in OTHERS}


def test_without_content(spark):
    got = classified(spark, [("/r", "a.js", 3, None), ("/r", "index.ts", 1, None), ("/r", "data/a_table.go", 9000, None), ("/r", "src/a.go", 9000, None), ("/r", "b.js", None, None)])
    assert got == {("/r", "a.js"): "minified", ("/r", "index.ts"): None, ("/r", "data/a_table.go"): "data", ("/r", "src/a.go"): None, ("/r", "b.js"): None}


def test_attribute_files(spark):
    attributes = [
        ("/r", ".gitattributes", 1, "# comment\n*.ts linguist-generated\n/docs/** generated\nlib/*.js linguist-vendored=true\nkeep.ts -linguist-generated text eol=lf\n[broken\n"),
        ("/r", "sub/.gitattributes", 1, "*.ts linguist-generated=false\r\ndeep/x.ts generated\r\n"),
        ("/r", "vendor/.gitattributes", 1, "own.ts linguist-vendored=false\n"),
    ]
    names = ["a.ts", "x/y/a.ts", "keep.ts", "x/keep.ts", "docs/a/b.md", "x/docs/b.md", "lib/a.js", "lib/x/a.js", "sub/a.ts", "sub/deep/x.ts", "sub/deep/y.ts", "vendor/own.ts", "vendor/a.go"]
    got = classified(spark, [("/r", p, 10, CODE) for p in names] + attributes + [("/other", "a.ts", 10, CODE)])
    want = {
        "a.ts": "generated", "x/y/a.ts": "generated", "keep.ts": None, "x/keep.ts": None, "docs/a/b.md": "generated", "x/docs/b.md": None, "lib/a.js": "vendored", "lib/x/a.js": None,
        "sub/a.ts": None, "sub/deep/x.ts": "generated", "sub/deep/y.ts": None, "vendor/own.ts": "generated", "vendor/a.go": "vendored",
    }
    assert {p: got["/r", p] for p in names} == want and got["/other", "a.ts"] is None


@pytest.mark.parametrize("glob,yes,no", [
    ("*.js", ["a.js", "x/a.js"], ["a.jsx"]), ("/a.js", ["a.js"], ["x/a.js"]), ("a/**/b", ["a/b", "a/x/y/b"], ["x/a/b"]), ("a/*", ["a/b"], ["a/b/c"]), ("a/**", ["a/b", "a/b/c"], ["b"]),
    ("[!a]?.c", ["bx.c"], ["ax.c", "b/.c"]), ("a.b", ["a.b"], ["axb"]), ("dir/", [], ["dir", "dir/a"]), ("**/x", ["x", "a/x"], ["ax"]), ("[a", ["[a"], ["a"]),
])
def test_globs(glob, yes, no):
    pattern = hw.glob_regex(glob)
    assert all(re.search(pattern, x) for x in yes) and not any(re.search(pattern, x) for x in no)


def test_libraries_are_mined_from_the_collection(spark):
    entries = [("/a", "libs/foo-1.2.0/a.ts", 9, CODE), ("/b", "vendor/foo/a.ts", 9, CODE), ("/c", "src/foo/a.ts", 9, CODE), ("/d", "libs/solo-1.0.0/a.ts", 9, CODE), ("/c", "src/solo/a.ts", 9, CODE), ("/b", "vendor/src/a.ts", 9, CODE), ("/a", "vendor/src/a.ts", 9, CODE)]
    got = classified(spark, entries)
    assert got["/c", "src/foo/a.ts"] == "vendored" and got["/c", "src/solo/a.ts"] is None


def test_nulls_repeats_and_empty_tables(spark):
    entries = [("/r", "a.ts", 10, CODE), ("/r", "a.ts", 12, CODE), (None, "a.ts", 1, CODE), ("/r", None, 1, CODE)]
    assert classified(spark, entries) == {("/r", "a.ts"): None}
    empty = hw.classify(spark.createDataFrame([], FILES), spark.createDataFrame([], TEXTS))
    assert rows(empty) == []


def test_long_text(spark):
    got = classified(spark, [("/r", "a.ts", 10, "// x\n" * 100_000 + CODE), ("/r", "b.ts", 10, "/* " + "y " * 300_000), ("/r", "c.ts", 10, " " * 300_000), ("/r", "d.ts", 10, "1, " * 200_000)])
    assert got["/r", "a.ts"] is None and len(got) == 4


def test_headers_of_any_number_of_comments_are_read_whole(spark):
    lines = "".join(f"// remark {k} on the cache\n" for k in range(3000))
    got = classified(spark, [("/r", "a.ts", 10, lines + "// Code generated by foo. DO NOT EDIT.\n" + CODE), ("/r", "b.ts", 10, lines + CODE), ("/r", "c.ts", 10, lines + "m=1;" * 200)])
    assert got == {("/r", "a.ts"): "generated", ("/r", "b.ts"): None, ("/r", "c.ts"): "minified"}


def test_marks_beyond_the_thousandth_count(spark):
    many = " ".join(f"mark{k}" for k in range(1500))
    got = classified(spark, [("/r", "a.ts", 10, CODE), ("/r", ".gitattributes", 1, f"*.ts {many} linguist-generated\n")])
    assert got["/r", "a.ts"] == "generated"


def test_patterns_are_mined_from_marks_of_several_repositories(spark):
    """Made-up folders, endings, generators and phrases, of which no list knows; only a few files carry the standard mark."""
    entries = []
    for k in range(120):
        root = f"/r{k % 4}"
        note = f"// Code generated by weavekit. DO NOT EDIT.\n{CODE}" if k % 3 == 0 else CODE
        entries += [(root, f"src/out_{k % 4}/woven/part{k}.ts", 10, note), (root, f"src/m{k}.woven.ts", 10, f"// Wove by machine from shape {k}, leave alone.\n{CODE}" if k % 2 else f"// Code generated by weavekit. DO NOT EDIT.\n{CODE}")]
        entries += [(root, f"src/hand/n{k}.ts", 10, f"// Looks after shape {k}, with care.\n{CODE}"), (root, f"lib/q{k}.packd.js", 3, "m=1;f(e[7],!0);" * 40)]
    entries += [(f"/r{k % 4}", f"src/hand/more/h{k}.ts", 10, f"// Looks after shape {k}, with care.\n{CODE}" if k % 2 else CODE) for k in range(1200)]
    entries += [
        ("/s", "x/woven/a.ts", 10, None), ("/s", "x/b.woven.ts", 10, None), ("/s", "x/c.packd.js", 30, None), ("/s", "x/d.ts", 10, "// By weavekit, as ever.\n" + CODE),
        ("/s", "x/e.ts", 10, "// Wove by machine from shape 7, leave alone.\n" + CODE), ("/s", "x/f.ts", 10, "// Looks after shape 3, with care.\n" + CODE), ("/s", "x/hand/g.ts", 10, None),
    ]
    got = classified(spark, entries)
    assert {p: k for (r, p), k in got.items() if r == "/s"} == {
        "x/woven/a.ts": "generated", "x/b.woven.ts": "generated", "x/c.packd.js": "minified", "x/d.ts": "generated", "x/e.ts": "generated", "x/f.ts": None, "x/hand/g.ts": None
    }
    assert all(k is None for (_, p), k in got.items() if "/hand/" in p or "/more/" in p)


def test_vendor_folders_and_headers_follow_from_libraries(spark):
    entries = [("/a", "lib/foo-1.2.0/a.ts", 9, CODE), ("/b", "lib/foo-1.3.0/a.ts", 9, CODE), ("/b", "attic/foo/a.ts", 9, CODE), ("/c", "attic/foo/b.ts", 9, CODE), ("/c", "attic/bar/c.ts", 9, CODE)]
    entries += [("/d", "x.ts", 9, "// Taken over: foo 2.1, whole.\n" + CODE), ("/d", "y.ts", 9, "// Works with baz 2.1 only.\n" + CODE)] + [("/d", f"lib/own{k}/a.ts", 9, CODE) for k in range(6)]
    got = classified(spark, entries)
    assert got["/c", "attic/bar/c.ts"] == "vendored" and got["/d", "x.ts"] == "vendored" and got["/d", "y.ts"] is None and got["/d", "lib/own1/a.ts"] is None
