from helpers import at, rows

from lodeglass.operators import incremental as inc
from lodeglass.streaming import reads as stream


def test_a_changed_size_is_pending_though_the_checksum_is_the_same(spark, tmp_path):
    frame = lambda *x: spark.createDataFrame(list(x), "path string, hash string, bytes bigint")
    work = lambda df: df.select("path")
    assert inc.Ledger(spark, str(tmp_path / "job")).run("r0", frame(("old", "0", 1)), work)  # a batch from before sizes were kept
    ledger = inc.Ledger(spark, str(tmp_path / "job"), size="bytes")
    assert rows(ledger.manifest()) == [("old", "0", None)]
    assert ledger.run("r1", frame(("a", "1", 10), ("b", "2", 20), ("old", "0", 1)), work)
    assert ledger.run("r2", frame(("a", "1", 10), ("b", "2", 21), ("old", "0", 1)), work)
    assert rows(ledger.output(), "path", "batch") == [("a", "r1"), ("b", "r1"), ("b", "r2"), ("old", "r0")]
    assert rows(ledger.manifest()) == [("a", "1", 10), ("b", "2", 21), ("old", "0", None)]
    assert rows(inc.Ledger(spark, str(tmp_path / "new"), size="bytes").manifest()) == []


def test_the_latest_version_in_a_micro_batch_counts(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "path string, hash string, bytes bigint, seen timestamp_ntz"
    ledger = inc.Ledger(spark, str(tmp_path / "job"), size="bytes")
    data = [("a", "9", 1, at("2025-01-01")), ("a", "1", 2, at("2025-01-02")), ("a", None, 3, at("2025-01-03")), ("b", None, 4, at("2025-01-01"))]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(source)
    writer = stream.index_stream(spark.readStream.schema(schema).parquet(source), ledger, lambda df: df.select("path", "bytes"), at="seen")
    writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert rows(ledger.manifest()) == [("a", "1", 2), ("b", None, 4)]
    assert rows(ledger.output(), "path", "bytes") == [("a", 2), ("b", 4)]
