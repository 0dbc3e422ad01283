from helpers import rows
from pyspark.sql import functions as F

from lodeglass.llm import splitting as sp


def test_each_text_is_cut_by_offset_once(spark):
    texts = {"a": "é1\nzwei\n\n4\n", "b": "one", "c": "x\r\ny\n\u2028z", "d": "\n\n"}
    items = spark.createDataFrame([(k, 1, t) for k, t in texts.items()] + [("a", 1, "short"), ("e", 1, None)], "path string, chunk_no int, content string")
    spans = [(k, i, j) for k, t in texts.items() for i in range(1, t.count("\n") + 2) for j in range(i, t.count("\n") + 2)]
    pieces = spark.createDataFrame([(k, 1, i, j) for k, i, j in spans], "path string, chunk_no int, first bigint, last bigint")
    got = sp.piece_texts(items, pieces, ["path", "chunk_no"])
    assert rows(got) == sorted(((k, 1, i, j, "\n".join(texts[k].split("\n")[i - 1: j])) for k, i, j in spans), key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "MapInPandas" in plan  # no text is split once per piece


def test_bytes_that_are_no_text_stay_as_they_are(spark):
    items = spark.createDataFrame([("a",)], "path string").withColumn("content", F.expr("cast(X'61ff0a62fe' AS string)"))
    pieces = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "path string, first bigint, last bigint")
    got = sp.piece_texts(items, pieces, ["path"]).select("first", F.hex(F.col("text").cast("binary")))
    assert rows(got) == [(1, "61FF"), (2, "62FE")]
