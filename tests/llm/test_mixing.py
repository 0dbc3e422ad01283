import pytest
from helpers import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeglass.llm import mixing as mx

DOCS = "doc_id bigint, text string, source string, tokens string, copies int"
TARGETS = "source string, target_weight double, max_repeats int"


def documents(spark, data):
    return spark.createDataFrame([(k, t, s, "x", 1) for k, (t, s) in enumerate(data)], DOCS)


@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.floats(0, 1), st.integers(0, 4), st.integers(0, 1000)), min_size=1), st.floats(0, 5000))
def test_water_filling(sources, budget):
    plan = mx.water_fill([(s, w, r) for s, (w, r, _) in sources.items()], {s: n for s, (_, _, n) in sources.items()}, budget)
    total = sum(p.planned for p in plan)
    assert all(p.planned <= p.capacity + 1e-6 for p in plan)
    room = sum(p.capacity for p in plan if p.weight > 0)
    assert total == pytest.approx(min(budget, room), abs=1e-6)
    free = [p.planned / p.weight for p in plan if p.weight > 1e-9 and p.planned < p.capacity - 1e-6]
    assert not free or max(free) == pytest.approx(min(free), rel=1e-6, abs=1e-6)


def test_token_counts(spark):
    long = "word " * 30_000
    df = documents(spark, [("Hello world", "a"), ("", "a"), (None, "a"), (long, "a"), ("x" * 50_000, "a"), ("<|endoftext|>", "a"), ("ü‍\U0001f600", "a")])
    got = [r[0] for r in df.orderBy("doc_id").select(mx.count_tokens("text")).collect()]
    assert got[:3] == [2, 0, 0] and got[3] == pytest.approx(30_001, abs=3) and got[4] > 1000 and got[5] > 1 and got[6] > 1


def test_sources_that_fall_short(spark):
    data = [("a b c d", "Big "), ("a b c d", " big"), ("a b", "small"), ("a b", None), ("a b", "  "), ("a", "unlisted")]
    targets = spark.createDataFrame([("BIG", 0.5, 1), ("small", 0.5, 2), ("nothing", 0.1, 9), ("zero", 0.0, 1), (None, 0.3, 1), ("small", 0.5, 2), ("loose", None, None)], TARGETS)
    plan = mx.mix_plan(mx.sized_documents(documents(spark, data)), targets)
    assert {p.source: p.available for p in plan} == {"big": 8, "small": 2, "nothing": 0, "zero": 0, "loose": 0}
    assert rows(mx.short_sources(spark, plan)) == [("nothing",), ("small",)]  # 15 tokens in all: 8 >= 7.5, 4 < 7.5
    assert {r["source"]: r["reaches_share"] for r in mx.plan_table(spark, plan).collect()}["big"]


def test_sample_reaches_the_plan(spark):
    data = [("w " * (k % 50 + 1), "hot" if k % 3 else f"s{k % 9}") for k in range(3000)]
    sized = mx.sized_documents(documents(spark, data))
    targets = spark.createDataFrame([("hot", 0.1, 1), ("s0", 0.6, 3), ("s3", 0.1, 2), ("s6", 0.2, 5), ("none", 0.1, 1)], TARGETS)
    plan = mx.mix_plan(sized, targets, 40_000)
    sample = mx.sample_mix(sized, plan)
    got = {r["source"]: r for r in mx.mix_report(sample, plan).collect()}
    for p in plan:
        assert got[p.source]["mixed_tokens"] == pytest.approx(p.planned, abs=60)
        assert got[p.source]["most_copies"] <= p.max_repeats
    assert sum(r["actual_share"] for r in got.values()) == pytest.approx(1)
    assert rows(sample) == rows(mx.sample_mix(sized.repartition(7), plan))
    assert rows(sample) != rows(mx.sample_mix(sized, plan, seed=5))
    spread = sample.groupBy("source").agg((F.max("copies") - F.min("copies")).alias("d")).collect()
    assert all(r["d"] <= 1 for r in spread)


def test_empty_tables(spark):
    sized = mx.sized_documents(documents(spark, []))
    targets = spark.createDataFrame([("a", 0.5, 2)], TARGETS)
    plan = mx.mix_plan(sized, targets)
    assert [p.planned for p in plan] == [0.0] and rows(mx.sample_mix(sized, plan)) == [] and rows(mx.short_sources(spark, plan)) == []
    assert mx.mix_plan(sized, spark.createDataFrame([], TARGETS)) == []
    assert rows(mx.mix_report(mx.sample_mix(sized, plan), plan)) == [("a", 0.5, 0, 0.0, 0)]


def test_long_texts_are_counted_as_if_whole():
    encode = mx._encoding(mx.RANKS).encode_ordinary
    for text in ("9" * 60_000, "word " * 20_000, "a  b\n c" * 9_000, "x" * 19_999 + " y" * 30_000, "né à " * 9_000):
        assert "".join(mx._parts(text)) == text and sum(len(encode(p)) for p in mx._parts(text)) == len(encode(text))
