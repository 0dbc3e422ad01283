import random

import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeglass.llm import leakage as lk

DOCS = "doc_id bigint, text string, item_id string, matched string"
ITEMS = "item_id bigint, suite string, text string, answer string"


def brute(docs, items, width=12, misses=0):
    out = {}
    for d, t in docs:
        w = lk.words(t)
        for i, u in items:
            v = lk.words(u)
            best = max((sum(map(str.__eq__, w[a:a + width], v[b:b + width])) for a in range(len(w) - width + 1) for b in range(len(v) - width + 1)), default=0)
            if best >= width - misses:
                out[d, i] = best
    return out


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)] + ["the", "of"] * 10
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.choice([5, 12, 30, 60]))) for k in range(12)] + [(90, "The End. " * 10), (91, "the end the end")]
    items.append((92, items[2][1]))
    docs = []
    for k in range(60):
        _, t = items[k % len(items)]
        w = t.split()
        cut = w[k % 5: k % 5 + rng.choice([8, 11, 12, 13, 40])]
        if k % 4 == 0 and len(cut) > 6:
            cut[5] = "other"
        docs.append((k, say(10) + " -- " + ", ".join(cut).upper() + "!\n" + say(10)))
    docs += [(60, ""), (61, "the " * 3000), (62, "the end " * 2000), (63, docs[2][1]), (64, "a")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, "x", "y") for d, t in docs], DOCS), spark.createDataFrame([(i, "s", t, None) for i, t in items], ITEMS)


@pytest.mark.parametrize("misses,block_words,segment", [(0, 10**6, 1 << 20), (2, 10**6, 1 << 20), (0, 40, 300), (2, 100, 50)])
def test_against_brute_force(spark, monkeypatch, misses, block_words, segment):
    monkeypatch.setattr(lk, "SEGMENT_CHARS", segment)
    docs, items = corpus()
    nulls = frames(spark, [*docs, (None, docs[0][1]), (99, None)], [*items, (None, items[0][1]), (98, None), items[0]])
    got = lk.find_passages(*nulls, misses=misses, block_words=block_words)
    want = brute([(d, t) for d, t in docs if d != 61 or True], items, 12, misses)
    assert {(a, b) for a, b, _ in rows(got, "doc_id", "item_id", "matched")} == set(want)
    if misses:
        assert {(a, b): m for a, b, m in rows(got, "doc_id", "item_id", "matched")} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=4), st.lists(st.lists(st.sampled_from("abcd"), max_size=14), max_size=3), st.integers(1, 5), st.integers(0, 2))
def test_segment_against_brute_force(docs, items, width, misses):
    misses = min(misses, width - 1)
    docs, items = [(k, " ".join(d)) for k, d in enumerate(docs)], [(k, " ".join(i)) for k, i in enumerate(items)]
    queries = lk.QuerySet(items, width)
    segment = lk.Segment([t for _, t in docs], queries)
    found = {(d, i): m for i, item in zip(queries.ids, queries.codes) for d, m in segment.near(item, width, misses).items()}
    assert found == brute(docs, items, width, misses)
    assert {(d, i) for i, item in zip(queries.ids, queries.codes) for d in segment.exact(item, width)} == set(brute(docs, items, width))


def test_words():
    assert lk.words("Ärger-Test_x, É9 KK") == ["rger", "test", "x", "9", "kk"]


def test_empty_tables(spark):
    docs, items = corpus()
    assert rows(lk.find_passages(*frames(spark, [], items))) == rows(lk.find_passages(*frames(spark, docs, []))) == []
    with pytest.raises(ValueError):
        lk.find_passages(*frames(spark, docs, items), min_words=2, misses=2)


def test_a_stored_index_answers_any_block(spark, tmp_path):
    docs, items = corpus()
    frame, asked = frames(spark, docs, items)
    index = lk.build_index(frame, folder=str(tmp_path / "index"), segment_chars=900)
    again = lk.PassageIndex(spark, str(tmp_path / "index"), "doc_id")
    for misses in (0, 2):
        assert {(a, b) for a, b, _ in rows(lk.search_index(again, asked, misses=misses, block_words=90))} == set(brute(docs, items, 12, misses))
    assert rows(lk.search_index(index, asked.where("item_id = 2"))) == rows(lk.find_passages(frame, asked.where("item_id = 2")))
    assert index.rows().where("term IS NULL").count() > 3
