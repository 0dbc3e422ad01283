import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from lodeglass.operators import logentries as le

SCHEMA = "path string, line_no bigint, line string, start_no bigint, seam string"
COLUMNS = ["path", "line_no", "end_line_no", "logged_at", "level", "component"]
P = "/logs/x/2024/app-1.log"

# line, (time, level, component, message) or None
SAMPLES = [
    ("2024-04-10T18:00:24.103+02:00 TRACE [scheduler] a lease", ("2024-04-10 16:00:24", "DEBUG", "scheduler", "a lease")),
    ("2024-04-10T18:00:24.103Z \x1b[36mWarning\x1b[0m [a.b] x", ("2024-04-10 18:00:24", "WARN", "a.b", "x")),
    ("2024-04-10T00:30:24-05:00 INFO no component here", ("2024-04-10 05:30:24", "INFO", "", "no component here")),
    ("2025-01-06 14:00:35,075 - my-2 - INFORMATION - lease - gone", ("2025-01-06 14:00:35", "INFO", "my-2", "lease - gone")),
    ("05.09.2025 01:00:27 crawler SEVERE query took 2 ms", ("2025-09-05 01:00:27", "ERROR", "crawler", "query took 2 ms")),
    ("[05/Apr/2024:06:02:22 +0100] Fatal packer: key=a", ("2024-04-05 05:02:22", "FATAL", "packer", "key=a")),
    ("Feb 29 22:00:36 node30 reaper_io[5682]: DEBUG: done", ("2024-02-29 22:00:36", "DEBUG", "reaper_io", "done")),
    ("Aug  6 12:02:52 node35 indexer[4298]: no WARN: set", ("2024-08-06 12:02:52", "", "indexer", "no WARN: set")),
    ("E0506 23:07:14.956182 19362 core.io.go:536] worker", ("2024-05-06 23:07:14", "ERROR", "core.io", "worker")),
    ("ERR     | 2024-03-12 17:00:29 | scheduler | budget | low", ("2024-03-12 17:00:29", "ERROR", "scheduler", "budget | low")),
    ("1712293239.013 W/sched.core(10211): lease", ("2024-04-05 05:00:39", "WARN", "sched.core", "lease")),
    ('ts=2024-07-09T07:03:14.210Z lvl=critical comp=c-2 msg="retry \\"5\\" of 5" pid=2', ("2024-07-09 07:03:14", "FATAL", "c-2", 'retry \\"5\\" of 5')),
    ('level=info component=res time="2024-07-09 07:02:02" msg="skipped"', ("2024-07-09 07:02:02", "INFO", "res", "skipped")),
    ('{"ts":"2024-04-05T05:04:33.703+01:00","level":"verbose","component":"w","msg":"m"}', ("2024-04-05 04:04:33", "DEBUG", "w", "m")),
    ('{"level":60,"time":1712293313194,"pid":7823,"name":"watcher","msg":"bad"}', ("2024-04-05 05:01:53", "FATAL", "watcher", "bad")),
    ('{"message": "z", "severity": "ERR", "logger": "l", "timestamp": "2024-04-05 05:10:44"}', ("2024-04-05 05:10:44", "ERROR", "l", "z")),
    ("  > 2024-03-28T22:00:00.000Z ERROR [compactor] quoted", None),
    ("2024 entries were held back, 41 of them costly", None),
    ("0000  8c c6 00 b5 4e c2 07", None), ("SELECT path, count(*)", None), ("{", None), ('{"level": "error"}', None), ("", None),
    ("\tat ws.A.b(C.java:3)", None), ("see also: 2024-01-01", None), ("key=value other=1", None), ("ws.x.ParseError: 2024-13-45", None),
]


def frame(spark, lines, path=P, first=1):
    return spark.createDataFrame([(path, first + k, x, 7, "z") for k, x in enumerate(lines)], SCHEMA)


@pytest.mark.parametrize("line,want", SAMPLES)
def test_each_layout(spark, line, want):
    got = le.log_entries(frame(spark, [line])).select("logged_at", "level", "component", "message").collect()
    assert [tuple(r) for r in got] == ([want] if want else [])


def brute(lines):
    """Entries as (start, end) by the header test alone, line by line."""
    out = []
    for n, is_start in lines:
        if is_start:
            out.append([n, n])
        elif out:
            out[-1][1] = n
    return [tuple(x) for x in out]


@pytest.mark.parametrize("stretch", [1, 2, 3, 5, 1000])
def test_entries_over_the_ends_of_stretches(spark, stretch):
    head, more = "2024-04-10T18:00:24Z INFO [a] m", "    more"
    pattern = "..H.H....HH.......H"
    lines = [(3 * k + k % 2, c == "H") for k, c in enumerate(pattern)]
    data = [(P, n, head if s else more) for n, s in lines] * 2  # every line is delivered twice
    got = le.log_entries(spark.createDataFrame(data, "path string, line_no bigint, line string"), stretch)
    assert sorted(rows(got, "line_no", "end_line_no")) == brute(lines)
    texts = {r["line_no"]: r["message"].count("\n") for r in got.collect()}
    assert sum(texts.values()) + len(texts) == sum(n >= brute(lines)[0][0] for n, _ in lines)


def test_nulls_ties_and_other_cases(spark):
    h = "2024-04-10T18:00:24Z INFO [a] m"
    data = [(P, 1, None), (P, 2, h), (P, 2, h), (None, 3, h), (P, None, h), (P, 4, "x" * 300_000), ("/no/year.log", 1, "Feb 30 10:00:00 n a[1]: b"), ("/a/2023/b", 1, "Feb 29 10:00:00 n a[1]: b\r")]
    got = le.log_entries(spark.createDataFrame(data, "path string, line_no bigint, line string"))
    assert rows(got, *COLUMNS) == [
        ("/a/2023/b", 1, 1, None, "", "a"), (P, 2, 4, "2024-04-10 18:00:24", "INFO", "a"), ("/no/year.log", 1, 1, None, "", "a"),
    ]
    assert rows(le.log_entries(spark.createDataFrame([], SCHEMA))) == []


def test_session_time_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = le.log_entries(frame(spark, ["2024-03-10T02:30:00Z INFO [a] m", "1710037800.5 I/b(1): x"])).select("logged_at").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = dt.datetime.fromtimestamp(1710037800, dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    assert {r[0] for r in got} == {"2024-03-10 02:30:00", want}


def test_findings_get_their_entry(spark):
    h = "2024-04-10T18:00:24Z INFO [a] m"
    found = spark.createDataFrame([(P, 3, "ERROR", "m", ["c"]), (P, 3, None, "m", ["c"]), (P, 1, "WARN", "m", None)], "path string, line_no bigint, level string, message string, context_lines array<string>")
    for stretch in (1, 2, 1000):
        got = le.scanned_entries(found, frame(spark, ["lost", h, "  error"]), stretch)
        assert rows(got, "line_no", "guessed_level", "entry_line_no", "level") == [(3, "ERROR", 2, "INFO")]


def test_plan_shuffles_lines_once(spark):
    plan = le.log_entries(frame(spark, ["x"])).select(*COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Cartesian" not in plan and "NestedLoop" not in plan


def test_levels(spark):
    df = spark.createDataFrame([("err",), ("Emergency",), ("i",), ("40",), ("notice",), (None,)], "x string")
    assert [r[0] for r in df.select(le.canonical_level(F.col("x"))).collect()] == ["ERROR", "FATAL", "INFO", "WARN", "", ""]
