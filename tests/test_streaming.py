from helpers import at, rows

from lodeglass.operators import incremental, sessions
from lodeglass.streaming import reads as stream

SCHEMA = "owner string, read_at timestamp, item string, tokens bigint"


def test_running_sessions_agree_with_the_batch(spark, tmp_path):
    data = [
        [("a", at("2024-01-01T00:00:00"), "x", 1), ("b", at("2024-01-01T01:00:00"), "x", 2), ("a", at("2024-01-01T05:00:00"), "y", 3)],
        [("a", at("2024-01-02T06:00:00"), "x", 4), ("b", at("2024-01-02T00:30:00"), "x", None), (None, at("2024-01-02T00:30:00"), "x", 1)],
        [("a", at("2024-01-02T07:00:00"), "x", 5), ("b", at("2024-01-03T00:30:00"), "x", 7)],
    ]
    source, out = str(tmp_path / "in"), "sessions_out"
    for batch in data:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = stream.running_sessions(spark.readStream.schema(SCHEMA).parquet(source)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        seen = []
        query = query.foreachBatch(lambda df, _, seen=seen: seen.extend(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        data_seen = globals().setdefault(out, {})
        data_seen.update({(r["owner"], r["session_no"]): (r["reads"], r["tokens"]) for r in seen})
    everything = spark.createDataFrame([r for b in data for r in b], SCHEMA)
    want = {(o, s): (n, t) for o, s, n, t in rows(sessions.session_totals(everything, "owner", "read_at", "item", "tokens"), "owner", "session_no", "reads", "tokens")}
    assert globals()[out] == want


def test_listing_stream_is_indexed_once(spark, tmp_path):
    source = str(tmp_path / "in")
    ledger = incremental.Ledger(spark, str(tmp_path / "job"))
    schema = "path string, hash string"
    for batch in ([("a", "1"), ("a", "1")], [("a", "1"), ("b", "2")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        writer = stream.index_stream(spark.readStream.schema(schema).parquet(source), ledger, lambda df: df.select("path"))
        writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert rows(ledger.output(), "path") == [("a",), ("b",)]
    assert len(ledger.committed()) == 2
