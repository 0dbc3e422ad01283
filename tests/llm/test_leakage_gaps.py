from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeglass.llm import leakage as lk
from lodeglass.llm import queries


def in_order(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        row, last = [0], row
        for k, y in enumerate(b):
            row.append(max(row[-1], last[k + 1], last[k] + (x == y)))
    return row[-1]


def brute(docs, items, width, misses, gaps):
    out = {}
    for d, t in docs:
        w = lk.words(t)
        for i, u in items:
            v = lk.words(u)
            best = max((in_order(w[a: a + width + gaps], v[b: b + width]) for a in range(len(w)) for b in range(len(v) - width + 1)), default=0)
            if best >= width - misses:
                out[d, i] = best
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abce"), max_size=14), max_size=4), st.lists(st.lists(st.sampled_from("abcd"), max_size=12), max_size=3), st.integers(1, 5), st.integers(0, 2), st.integers(1, 3))
def test_segment_with_gaps_against_brute_force(docs, items, width, misses, gaps):
    misses = min(misses, width - 1)
    docs, items = [(k, " ".join(d)) for k, d in enumerate(docs)], [(k, " ".join(i)) for k, i in enumerate(items)]
    known = lk.QuerySet(items, width)
    segment = lk.Segment([t for _, t in docs], known)
    found = {(d, i): m for i, item in zip(known.ids, known.codes) for d, m in segment.near_with_gaps(item, width, misses, gaps).items()}
    assert found == brute(docs, items, width, misses, gaps)


def test_a_word_put_in_or_left_out(spark):
    item = [f"w{k}" for k in range(12)]
    docs = [
        (1, item), (2, item[:6] + ["extra"] + item[6:]), (3, item[:5] + item[6:]), (4, item[:4] + ["q"] * 9 + item[4:]), (5, item[:9]),
        (6, item[:3] + ["x"] + item[4:7] + ["y", "z"] + item[7:]), (7, item[::-1]),
    ]
    frames = spark.createDataFrame([(d, " ".join(["a", *w, "b"])) for d, w in docs], "doc_id bigint, text string"), spark.createDataFrame([(9, " ".join(item))], "item_id bigint, text string")
    assert rows(lk.find_passages(*frames, misses=2), "doc_id", "matched") == [(1, 12)]
    assert rows(lk.find_passages(*frames, misses=2, gaps=2), "doc_id", "matched") == [(1, 12), (2, 12), (3, 11), (6, 11)]


def test_the_registered_query_lets_words_be_put_in(spark, tmp_path):
    item = [f"w{k}" for k in range(12)]
    spark.createDataFrame([(1, " ".join(item[:6] + ["extra"] + item[6:]))], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, " ".join(item))], "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert len(rows(queries.p6_near(spark, str(tmp_path)))) == 1
