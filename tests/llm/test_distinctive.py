import math
from collections import Counter

from helpers import rows

from lodeglass.llm import distinctive as di

SCHEMA = "id string, path string, tokens array<string>, term string, df bigint"


def frame(spark, records):
    return spark.createDataFrame([(i, "p", t, "x", 9) for i, t in records], SCHEMA)


def brute(records):
    """(found, weights) by the book."""
    docs = {}
    for i, t in records:
        if i is not None:
            t = [x.lower() for x in t or [] if x]
            docs[i] = max(docs.get(i, []), t, key=lambda x: (len(x), x))
    docs = {i: t for i, t in docs.items() if t}
    n, avg = len(docs), sum(map(len, docs.values())) / max(1, len(docs))
    df = Counter(x for t in docs.values() for x in set(t))
    weights, found = {}, {}
    for i, t in docs.items():
        for x, f in Counter(t).items():
            idf = math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5))
            weights[i, x] = round(idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avg)), 9)
        competing = [x for x in set(t) if df[x] >= 2]
        if any(df[x] < 0.05 * n for x in competing):
            found[i] = min(competing, key=lambda x: (-weights[i, x], x))
    return found, weights


def records(n):
    """`n` records with a word in all, some in a few, and one of their own."""
    out = [(f"r{k}", ["Common", "common", f"own{k}", f"few{k % (n // 3)}", *([f"few{k % (n // 3)}"] if k % 2 else []), f"mid{k % 7}"]) for k in range(n)]
    return out + [("r1", None), ("r2", []), ("r3", ["", None]), (None, ["common"]), ("e", None), ("e2", [None, ""]), out[0], out[0]]


def test_against_brute_force(spark):
    data = records(90)
    found, weights = brute(data)
    got = di.term_weights(frame(spark, data))
    assert {(r["id"], r["term"]): r["score"] for r in got.collect()} == weights
    assert dict(rows(di.most_telling(got), "id", "term")) == found and len(found) == 90


def test_common_terms_take_the_broadcast_way(spark, monkeypatch):
    data = records(60)
    for share in (0.0, 0.5, 2.0):
        monkeypatch.setattr(di, "HOT_SHARE", share)
        assert dict(rows(di.most_telling(di.term_weights(frame(spark, data))), "id", "term")) == brute(data)[0]


def test_no_rare_competing_term_gives_no_row(spark):
    data = [(f"r{k}", ["all", "all", f"own{k}"]) for k in range(50)]
    assert rows(di.most_telling(di.term_weights(frame(spark, data)))) == []


def test_ties_go_to_the_least_term(spark):
    data = [(f"r{k}", [f"z{k // 2}", f"a{k // 2}"]) for k in range(100)]
    assert dict(rows(di.most_telling(di.term_weights(frame(spark, data))), "id", "term")) == {f"r{k}": f"a{k // 2}" for k in range(100)}


def test_empty_and_long(spark):
    assert rows(di.most_telling(di.term_weights(frame(spark, [])))) == []
    assert rows(di.most_telling(di.term_weights(frame(spark, [("a", None), ("b", [])])))) == []
    data = [("long", ["w"] * 200_000 + ["x"]), *[(f"r{k}", ["y", f"v{k % 20}"]) for k in range(60)], ("s", ["w"])]
    assert dict(rows(di.most_telling(di.term_weights(frame(spark, data))), "id", "term")) == brute(data)[0]
