import random
import re

import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeglass.llm import splitting as sp

SCHEMA = "path string, chunk_no bigint, content string, range_no bigint, n_lines string"


def brute(text, limit, overlap):
    lines = text.split("\n")
    n = len(lines)
    if n <= limit:
        return []
    found = [(k + 1, len(re.match(r"[ \t]*", lines[k])[0])) for k in range(1, n) if lines[k].strip() and not lines[k - 1].strip()]
    least = min((i for _, i in found), default=0)
    starts = [k for k, i in found if i == least]
    out, end = [], 0
    while end < n:
        first = max(1, end - overlap + 1)
        reach = first + limit - 1
        ends = [k - 1 for k in starts if end < k - 1 <= reach]
        last = n if n <= reach else max(ends) if ends else reach
        out.append((first, last))
        end = last
    return out


def local(text, limit, overlap, range_bytes):
    """The operator's steps on one text without Spark."""
    data = text.encode()
    base, blank, found = 0, False, []
    for t in sp._tables(len(data), lambda at, n: data[at:at + n], range_bytes):
        if t["n_lines"]:
            if blank and t["first_indent"] >= 0:
                found.append((base + 1, t["first_indent"], t["first_offset"]))
            found += [(base + k + 1, i, o) for k, i, o in zip(t["cand_line"], t["cand_indent"], t["cand_offset"])]
            base, blank = base + t["n_lines"], t["last_blank"]
    for line, _, offset in found:
        assert data[:offset].count(b"\n") == line - 1
    least = min((i for _, i, _ in found), default=0)
    ends = sp._walk([k for k, i, _ in found if i == least], base, 0, base, limit, overlap) if base > limit else []
    return base, [(max(1, e - overlap + 1), last) for e, last in zip([0, *ends], ends)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["\n", "\n", "\n", " ", "\t", "a", "é", "\xa0", " ", "\r"]), max_size=120), st.integers(2, 9), st.integers(0, 8), st.sampled_from([1, 2, 3, 7, 16, 1000]))
def test_ranges_of_any_size_give_the_same(chars, limit, overlap, range_bytes):
    text, overlap = "".join(chars), min(overlap, limit - 1)
    assert local(text, limit, overlap, range_bytes) == (len(text.split("\n")), brute(text, limit, overlap))


def texts(n=25):
    rng = random.Random(7)
    make = lambda k: "\n".join(rng.choice(["", "", "  ", "x = 1", "    y", "\tz", "def f():", "ä ö"]) for _ in range(k))
    return [make(rng.choice([1, 10, 60, 61, 65, 130, 400])) for _ in range(n)] + ["", "\n" * 200, "a", "x" * 100_000 + "\n" * 70, "\n" * 60]


@pytest.mark.parametrize("range_bytes,stretch", [(1 << 20, 50_000), (50, 60), (7, 97)])
def test_table_against_brute_force(spark, range_bytes, stretch):
    data = [(f"p{k % 3}", k, t, 1, "n") for k, t in enumerate(texts())]
    data += [data[0], data[3], ("p", 1, None, 1, "n"), (None, 1, "\n" * 99, 1, "n")]
    got = sp.split_texts(spark.createDataFrame(data, SCHEMA), ["path", "chunk_no"], range_bytes=range_bytes, stretch_lines=stretch)
    want = sorted((p, k, *x) for p, k, t in {(p, k, t) for p, k, t, *_ in data} if t is not None and p for x in brute(t, 60, 5))
    assert sorted(rows(got, "path", "chunk_no", "first", "last")) == want


def test_other_limits_and_texts_of_pieces(spark):
    data = [("p", k, t, 1, "n") for k, t in enumerate(texts())]
    df = spark.createDataFrame(data, SCHEMA)
    pieces = sp.split_texts(df, ["path", "chunk_no"], limit=11, overlap=3, stretch_lines=11)
    got = sp.piece_texts(df, pieces, ["path", "chunk_no"]).collect()
    want = {(k, a, b): "\n".join(t.split("\n")[a - 1:b]) for _, k, t, *_ in data for a, b in brute(t, 11, 3)}
    assert {(r["chunk_no"], r["first"], r["last"]): r["text"] for r in got} == want
    with pytest.raises(ValueError):
        sp.split_texts(df, ["path", "chunk_no"], limit=5, overlap=5)


def test_longest_of_differing_deliveries(spark):
    df = spark.createDataFrame([("p", 1, "\n" * 70, 0, ""), ("p", 1, "x\n" * 80, 0, "")], SCHEMA)
    assert sp.split_texts(df, ["path", "chunk_no"]).agg({"last": "max"}).first()[0] == 81


def test_empty_table(spark):
    assert rows(sp.split_texts(spark.createDataFrame([], SCHEMA), ["path", "chunk_no"])) == []


@pytest.mark.parametrize("range_bytes", [13, 1000, 1 << 20])
def test_files_by_offset(spark, tmp_path, range_bytes):
    for k, t in enumerate(texts()):
        (tmp_path / f"f{k}.txt").write_bytes(t.encode())
    listing = sp.list_files(spark, str(tmp_path))
    pieces = sp.split_files(listing, limit=20, overlap=4, range_bytes=max(range_bytes, 200), stretch_lines=25)
    got = sp.file_piece_texts(listing, pieces, range_bytes=max(range_bytes, 200)).collect()
    want = {(f"f{k}.txt", a, b): "\n".join(t.split("\n")[a - 1:b]) for k, t in enumerate(texts()) for a, b in brute(t, 20, 4)}
    assert {(r["path"].rsplit("/", 1)[1], r["first"], r["last"]): r["text"] for r in got} == want
