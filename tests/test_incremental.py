import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from lodeglass.operators import incremental as inc

READS = "path string, hash string, last_read_at timestamp_ntz, hash_ string, _done_key string"
ENTRIES = "file_path string, hash string, indexed_at timestamp_ntz, run_id bigint"
RUNS = "run_id bigint, status string, noted_at timestamp_ntz"


def reads(spark, *data):
    return spark.createDataFrame([(p, h, t and at(t), "x", "y") for p, h, t in data], READS)


def test_latest_hash_without_nulls_and_case(spark):
    df = reads(
        spark, ("a", "AB", "2025-01-02"), ("a", None, "2025-01-03"), ("a", "cd", "2025-01-01"), ("a", "AB", "2025-01-02"),
        ("b", None, "2025-01-01"), (None, "x", "2025-01-01"), ("c", "x", None), ("d", "p", "2025-01-01"), ("d", "q", "2025-01-01"),
    )
    assert rows(inc.present_files(df)) == [("a", "ab"), ("d", "q")]


def test_final_status_is_the_latest(spark):
    runs = spark.createDataFrame(
        [(1, "started", at("2025-01-01")), (1, "ok", at("2025-01-02")), (1, "rolled_back", at("2025-01-03")), (2, "ok", at("2025-01-02")), (2, "started", at("2025-01-01")), (None, "ok", at("2025-01-01")), (3, "ok", None)], RUNS
    )
    assert rows(inc.final_status(runs)) == [(1, "rolled_back"), (2, "ok")]


def test_pending_files(spark):
    listing = inc.present_files(reads(spark, ("a", "1", "2025-01-02"), ("b", "2", "2025-01-02"), ("c", "3", "2025-01-02"), ("d", "4F", "2025-01-02"), ("e", "5", "2025-01-02")))
    runs = spark.createDataFrame([(1, "ok", at("2025-01-01")), (2, "failed", at("2025-01-01"))], RUNS)
    entries = spark.createDataFrame(
        [
            ("a", "1", at("2025-01-01"), 1), ("a", "1", at("2025-01-01"), 1), ("a", "0", at("2025-01-05"), 2),  # the failed run doesn't count
            ("b", "9", at("2025-01-03"), 1), ("b", "2", at("2025-01-01"), 1),  # the latest index state is another
            ("d", "4f", at("2025-01-01"), 1), ("e", None, at("2025-01-01"), 1), ("z", "7", at("2025-01-01"), 1),
        ], ENTRIES,
    )
    manifest = inc.indexed_files(entries, runs)
    assert rows(inc.pending(listing, manifest), "path") == [("b",), ("c",), ("e",)]
    assert rows(inc.removed(listing, manifest)) == [("z",)]


def test_pending_keeps_other_columns_even_clashing_ones(spark):
    listing = reads(spark, ("a", "1", "2025-01-02"), ("b", None, "2025-01-02"), (None, "1", "2025-01-02"))
    manifest = spark.createDataFrame([("a", "1"), ("b", None)], "path string, hash string")
    got = inc.pending(listing, manifest)
    assert got.columns == listing.columns and rows(got, "path") == [("b",)]


def test_empty_tables(spark):
    listing = inc.present_files(reads(spark))
    manifest = inc.indexed_files(spark.createDataFrame([], ENTRIES), spark.createDataFrame([], RUNS))
    assert rows(listing) == rows(manifest) == rows(inc.pending(listing, manifest)) == []


def test_ledger_survives_failures_without_skipping_or_repeating(spark, tmp_path):
    ledger = inc.Ledger(spark, str(tmp_path / "job"))
    first = spark.createDataFrame([("a", "1", 10), ("b", "2", 20)], "path string, hash string, size bigint")

    def work(df):
        return df.select("path", F.upper("path").alias("out"))

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.run("r1", first, broken)
    assert ledger.committed() == [] and ledger.output() is None and rows(ledger.manifest()) == []
    later = first.union(spark.createDataFrame([("c", "3", 30)], first.schema))
    assert ledger.run("r1", later, work)  # works on what it froze when it first began
    assert rows(ledger.output(), "path") == [("a",), ("b",)]
    assert not ledger.run("r1", later, work)
    changed = spark.createDataFrame([("a", "1", 10), ("b", "9", 20), ("c", "3", 30)], first.schema)
    assert ledger.run("r2", changed, work)
    assert rows(ledger.output(), "path", "batch") == [("a", "r1"), ("b", "r1"), ("b", "r2"), ("c", "r2")]
    assert rows(ledger.current_output(), "path", "batch") == [("a", "r1"), ("b", "r2"), ("c", "r2")]
    assert rows(ledger.manifest()) == [("a", "1"), ("b", "9"), ("c", "3")]
    assert ledger.run("r3", changed, work) and rows(ledger.output().where("batch = 'r3'")) == []
    with pytest.raises(ValueError):
        ledger.run("../x", changed, work)


def test_output_left_by_a_dead_run_does_not_count(spark, tmp_path):
    ledger = inc.Ledger(spark, str(tmp_path / "job"))
    listing = spark.createDataFrame([("a", "1")], "path string, hash string")
    ledger._commit = lambda *x: (_ for _ in ()).throw(OSError("died before the rename"))
    with pytest.raises(OSError):
        ledger.run("r1", listing, lambda df: df.select("path"))
    again = inc.Ledger(spark, str(tmp_path / "job"))
    assert again.output() is None and again.run("r1", listing, lambda df: df.select("path"))
    assert rows(again.output(), "path") == [("a",)]
