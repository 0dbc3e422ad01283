"""Oversized items cut into pieces at natural boundaries, with overlap.

Works on byte ranges, so that an item may be larger than any worker's memory.

1. A worker owns the lines that start in its range. It reads one byte before
   the range and as far behind it as the last owned line's first visible
   character, and notes its line count and its candidates (a visible line
   after a blank one) with their indentation: the range's boundary table.
2. The tables are stitched: a running sum of line counts gives each range its
   first line number, the last owned line of the range before decides whether
   a range's first line is a candidate, and the least indentation of the
   item's candidates says which of them are natural boundaries.
3. Cutting is a walk from piece end to piece end. Stretches of many lines walk
   independently for every state in which they may be entered (at most `limit`
   of them); composing these small maps along the item gives the true state
   at each stretch, from which the pieces are emitted.
4. Texts are fetched by line range or by byte offset.
"""

from __future__ import annotations

import bisect
import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeglass.session import cut_lineage

LIMIT, OVERLAP = 60, 5
#: Bytes of an item that one task scans at a time.
RANGE_BYTES = 4 << 20
#: Lines of an item that one walk covers.
STRETCH_LINES = 50_000
#: Bytes of pieces that a task holds before it hands them on.
HELD_BYTES = 16 << 20

# White space other than the line feed, as UTF-8.
_SPACE = rb"(?:[ \t\r\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
_BLANKS_THEN_LINE = re.compile(rb"(?m)^(?>(?:" + _SPACE + rb"*+\n)+)([ \t]*+)" + _SPACE + rb"*+(?=[^\n])")
_LEADING = re.compile(rb"([ \t]*+)" + _SPACE + rb"*+")
_LAST_VISIBLE = re.compile(rb"(?:\n|" + _SPACE + rb")*\Z")

TABLE_SCHEMA = (
    "range_no bigint, n_ranges bigint, lo bigint, n_lines bigint, first_offset bigint, first_indent bigint, "
    "last_blank boolean, cand_line array<bigint>, cand_offset array<bigint>, cand_indent array<bigint>"
)


# -- 1. scanning -------------------------------------------------------------
def scan_range(read: Callable[[int, int], bytes], size: int, lo: int, hi: int) -> dict:
    """The boundary table of the lines that start in ``[lo, hi)``; `read` gives (offset, length) of the item.

    Reads beyond `hi` only as far as the last owned line's first visible
    character or its end, block by block.
    """
    hi = min(hi, size) if size else 0
    data = read(max(lo - 1, 0), hi - max(lo - 1, 0))
    if lo == 0:
        start = 0
    else:
        found = data.find(b"\n")
        # the line after a feed at hi - 1 starts at hi and isn't ours, except at the very end of the item
        start = lo - 1 + found + 1 if found >= 0 else -1
        if start >= hi and not (start == size == hi):
            start = -1
    empty = {"n_lines": 0, "first_offset": -1, "first_indent": -1, "last_blank": None, "cand_line": [], "cand_offset": [], "cand_indent": []}
    if start < 0:
        return empty
    buf = data[start - max(lo - 1, 0):]
    ours = len(buf)  # line starts below this belong to the range
    ends_item = start + ours >= size
    feeds = np.flatnonzero(np.frombuffer(buf, np.uint8) == 10)
    # a feed at the last byte of the range starts a line of the next range, or the item's last, empty line
    n_lines = 1 + int(np.count_nonzero(feeds < ours - 1)) + int(ends_item and len(feeds) > 0 and feeds[-1] == ours - 1)
    last_start = 0
    inner = feeds[feeds < ours - 1]
    if ends_item and len(feeds) and feeds[-1] == ours - 1:
        last_start = ours
    elif len(inner):
        last_start = int(inner[-1]) + 1
    at = start + ours
    while at < size:  # until the last owned line shows whether it is blank
        tail = buf[last_start:]
        lead = _LEADING.match(tail).end()
        if lead < len(tail) and (len(tail) - lead > 3 or tail[lead] == 10):
            break  # 3: the white space characters of several bytes may be cut by the end of the block
        more = read(at, min(1 << 16, size - at))
        buf += more
        at += len(more)
    visible = buf[: len(buf) - len(_trailing_blank(buf))]

    def lead_of(pos: int) -> int:
        """Indentation of the line at `pos`, -1 if it is blank."""
        m = _LEADING.match(buf, pos)
        return -1 if m.end() >= len(buf) or buf[m.end()] == 10 else len(m.group(1))

    lines, offsets, indents = [], [], []
    hits = [(m.start(1), m.end(1) - m.start(1)) for m in _BLANKS_THEN_LINE.finditer(visible)]
    hits = [(p, k) for p, k in hits if p < ours]
    if hits:
        lines = np.searchsorted(feeds, [p for p, _ in hits]).tolist()
        offsets, indents = [start + p for p, _ in hits], [k for _, k in hits]
    return {
        "n_lines": n_lines, "first_offset": start, "first_indent": lead_of(0), "last_blank": lead_of(last_start) < 0,
        "cand_line": lines, "cand_offset": offsets, "cand_indent": indents,
    }


def _trailing_blank(buf: bytes) -> bytes:
    """White space at the end, cut so that what stays ends in a visible character."""
    end = len(buf)
    while end:
        cut = max(0, end - 4096)
        m = _LAST_VISIBLE.search(buf, cut, end)
        if m.start() > cut:
            return buf[m.start():]
        end = cut
    return buf


def _tables(size: int, read: Callable[[int, int], bytes], range_bytes: int) -> Iterator[dict]:
    n = max(1, -(-size // range_bytes))
    for k in range(n):
        yield {"range_no": k, "n_ranges": n, "lo": k * range_bytes} | scan_range(read, size, k * range_bytes, (k + 1) * range_bytes)


_FIELDS = [x.split()[0] for x in TABLE_SCHEMA.split(", ")]


def scan_texts(items: DataFrame, keys: list[str], text_col: str, range_bytes: int = RANGE_BYTES, carried: list[str] | None = None) -> DataFrame:
    """Boundary tables of the texts in a column, one row per range. `keys`, `carried` columns and `delivery` go along.

    `delivery` names one row of several that came under a key, by size and
    hash of its text and by its carried columns. Null texts and null keys are
    left out.
    """
    carried = carried or []
    kept = items.where(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, text_col]))
    text = F.col(text_col).cast("binary")
    delivery = F.concat_ws("-", F.lpad(F.octet_length(text).cast("string"), 12, "0"), F.hex(F.xxhash64(text_col, *carried)))
    source = kept.select(*keys, *carried, delivery.alias("delivery"), text.alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text") + ", " + TABLE_SCHEMA

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                data = row[-1]
                rows += [(*row[:-1], *(t[f] for f in _FIELDS)) for t in _tables(len(data), lambda at, n, data=data: data[at:at + n], range_bytes)]
            yield pd.DataFrame(rows, columns=[*pdf.columns[:-1], *_FIELDS])

    return source.mapInPandas(scan, schema)


def _opened(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def scan_files(listing: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Boundary tables of files, one row per range; `listing` has path and length.

    Each range is a row of its own before it is read, so that the ranges of a
    single large file spread over all tasks.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / range_bytes))
    ranges = (
        listing.where("path IS NOT NULL AND length IS NOT NULL")
        .select("path", F.col("length").cast("bigint").alias("length"), n.cast("bigint").alias("n_ranges"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_ranges") - 1)).alias("range_no"))
    )
    spread = ranges.repartition(F.col("path"), F.col("range_no"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, length, n_ranges, k in pdf.itertuples(index=False):
                with _opened(path) as f:
                    t = scan_range(lambda at, n, f=f: f.read_at(n, at), length, k * range_bytes, (k + 1) * range_bytes)
                rows.append((path, str(length), *(({"range_no": k, "n_ranges": n_ranges, "lo": k * range_bytes} | t)[f] for f in _FIELDS)))
            yield pd.DataFrame(rows, columns=["path", "delivery", *_FIELDS])

    return spread.mapInPandas(scan, "path string, delivery string, " + TABLE_SCHEMA)


# -- 2. stitching ------------------------------------------------------------
def stitch(tables: DataFrame, keys: list[str], carried: list[str] | None = None) -> DataFrame:
    """(keys, carried, n_lines, line, offset): the natural boundaries of each item; one row without line if there is none.

    `line` counts from 1. Of several deliveries under a key the greatest name
    counts, with its own carried columns, repeated ones once. Only counts and flags meet in the windows; the
    candidates stay in their rows.
    """
    carried = carried or []
    item = Window.partitionBy(*keys)
    before = item.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    once = tables.dropDuplicates([*keys, "delivery", "range_no"])
    summary = once.select(
        *keys, "delivery", "range_no", "n_lines", "last_blank", "first_indent", F.array_min("cand_indent").alias("least"),
    ).withColumn("_best", F.max("delivery").over(item)).where("delivery = _best")
    placed = (
        summary.withColumn("base", F.coalesce(F.sum("n_lines").over(before), F.lit(0)))
        .withColumn("after_blank", F.coalesce(F.last(F.when(F.col("n_lines") > 0, F.col("last_blank")), ignorenulls=True).over(before), F.lit(False)))
        .withColumn("opens", F.col("after_blank") & (F.col("n_lines") > 0) & (F.col("first_indent") >= 0))
        .withColumn("total", F.sum("n_lines").over(item))
        .withColumn("indent", F.min(F.least("least", F.when(F.col("opens"), F.col("first_indent")))).over(item))
        .select(*keys, "delivery", "range_no", "base", "opens", "total", "indent")
    )
    full = once.join(placed, [*keys, "delivery", "range_no"])
    first = F.when(F.col("opens"), F.array(F.struct(F.lit(0).cast("bigint").alias("l"), F.col("first_offset").alias("o"), F.col("first_indent").alias("i")))).otherwise(F.array())
    inner = F.zip_with(
        F.arrays_zip("cand_line", "cand_offset"), "cand_indent",
        lambda a, i: F.struct(a["cand_line"].alias("l"), a["cand_offset"].alias("o"), i.alias("i")),
    )
    natural = F.filter(F.concat(first, inner), lambda x: x["i"] == F.col("indent"))
    rows = full.select(*keys, *carried, F.col("total").alias("n_lines"), "range_no", "base", F.explode_outer(natural).alias("b"))
    return rows.where("b IS NOT NULL OR range_no = 0").select(*keys, *carried, "n_lines", (F.col("base") + F.col("b.l") + 1).alias("line"), F.col("b.o").alias("offset"))


# -- 3. cutting --------------------------------------------------------------
def next_end(starts: list[int], n: int, end: int, limit: int, overlap: int) -> int:
    """Last line of the piece after the one that ended at `end`; `starts` are the lines behind the boundaries."""
    reach = max(1, end - overlap + 1) + limit - 1
    if n <= reach:
        return n
    k = bisect.bisect_right(starts, reach + 1) - 1
    return starts[k] - 1 if k >= 0 and starts[k] - 1 > end else reach


def _walk(starts: list[int], n: int, end: int, last: int, limit: int, overlap: int) -> list[int]:
    """Piece ends from behind `end` to `last`."""
    ends = []
    while end < n:
        end = next_end(starts, n, end, limit, overlap)
        if end > last:
            break
        ends.append(end)
    return ends


def cut(boundaries: DataFrame, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP, stretch_lines: int = STRETCH_LINES) -> DataFrame:
    """(keys, n_lines, first, last): the pieces of items with more than `limit` lines, by lines from 1.

    `boundaries` as from `stitch`.
    """
    if not 0 <= overlap < limit <= stretch_lines:
        raise ValueError("0 <= overlap < limit <= stretch_lines must hold")
    long = boundaries.where(F.col("n_lines") > limit)
    of = lambda line: F.floor((line - 1) / stretch_lines)
    # each stretch exists without boundaries too, and sees those that it can reach beyond its end
    seeds = long.groupBy(*keys).agg(F.max("n_lines").alias("n_lines")).select(
        *keys, "n_lines", F.explode(F.sequence(F.lit(0).cast("bigint"), of(F.col("n_lines")))).alias("stretch"), F.lit(None).cast("bigint").alias("line")
    )
    seen = long.where("line IS NOT NULL").select(*keys, "n_lines", of(F.col("line")).alias("stretch"), "line")
    ahead = seen.where(((F.col("line") - 1) % stretch_lines <= limit) & (F.col("stretch") > 0)).withColumn("stretch", F.col("stretch") - 1)
    stretches = (
        seeds.unionByName(seen).unionByName(ahead)
        .groupBy(*keys, "n_lines", "stretch")
        .agg(F.sort_array(F.collect_list("line")).alias("starts"))
    )
    whole = stretches.where(F.col("n_lines") <= stretch_lines).withColumn("entered", F.lit(0).cast("bigint"))
    parted = stretches.where(F.col("n_lines") > stretch_lines)

    @F.pandas_udf("array<bigint>")
    def through(starts: pd.Series, n: pd.Series, stretch: pd.Series) -> pd.Series:
        """Ends with which the stretch is left, for each end with which it may be entered."""
        out = []
        for s, total, k in zip(starts, n, stretch):
            s, edge = list(s), k * stretch_lines
            enters = [edge - j for j in range(limit)] if k else [0]
            memo: dict[int, int] = {}
            exits = []
            for e in enters:
                trail, last = [e], min(edge + stretch_lines, total)
                while trail[-1] not in memo:
                    nxt = next_end(s, total, trail[-1], limit, overlap) if trail[-1] < total else last + 1
                    if nxt > last:
                        memo[trail[-1]] = trail[-1]
                        break
                    trail.append(nxt)
                for t in trail:
                    memo[t] = memo[trail[-1]]
                exits.append(memo[e])
            out.append(exits)
        return pd.Series(out)

    @F.pandas_udf("array<struct<first: bigint, last: bigint>>")
    def pieces(starts: pd.Series, n: pd.Series, stretch: pd.Series, entered: pd.Series) -> pd.Series:
        out = []
        for s, total, k, end in zip(starts, n, stretch, entered):
            ends = _walk(list(s), total, end, (k + 1) * stretch_lines, limit, overlap)
            out.append([{"first": max(1, e - overlap + 1), "last": l} for e, l in zip([end, *ends], ends)])
        return pd.Series(out)

    fields = {f.name: f.dataType.simpleString() for f in boundaries.schema}
    maps = parted.select(*keys, "stretch", through("starts", "n_lines", "stretch").alias("exits"))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, end, entered = pdf.sort_values("stretch"), 0, []
        for k, exits in zip(pdf["stretch"], pdf["exits"]):
            entered.append(end)
            end = exits[k * stretch_lines - end if k else 0]
        return pdf[[*keys, "stretch"]].assign(entered=entered)

    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", stretch bigint, entered bigint"
    entries = maps.groupBy(*keys).applyInPandas(compose, schema)
    ready = whole.unionByName(parted.join(entries, [*keys, "stretch"]))
    found = ready.select(*keys, "n_lines", F.explode(pieces("starts", "n_lines", "stretch", "entered")).alias("p"))
    return found.select(*keys, "n_lines", F.col("p.first").alias("first"), F.col("p.last").alias("last"))


# -- 4. the operator ---------------------------------------------------------
def split_texts(
    items: DataFrame, keys: list[str], text_col: str = "content", limit: int = LIMIT, overlap: int = OVERLAP,
    range_bytes: int = RANGE_BYTES, stretch_lines: int = STRETCH_LINES, carried: list[str] | None = None,
) -> DataFrame:
    """(keys, carried, n_lines, first, last): pieces of every text with more than `limit` lines.

    Lines are what line feeds separate, an empty last one included, and count
    from 1. A natural boundary lies before a visible line that follows a blank
    one, if no such line of the text is indented less. From the second piece
    on the first `overlap` lines repeat the piece before. A piece ends at the
    end of the text if that is in reach, else at the last boundary in reach
    that adds a line, else at its `limit`-th line. Texts up to the limit,
    null and empty ones give no rows; a text delivered again under its key
    counts once, of differing ones the longest. `carried` columns, which must
    not be null, are those of the row whose text counts.
    """
    tables = cut_lineage(scan_texts(items, keys, text_col, range_bytes, carried))
    return cut(stitch(tables, keys, carried), [*keys, *(carried or [])], limit, overlap, stretch_lines)


def split_files(
    listing: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES, stretch_lines: int = STRETCH_LINES,
) -> DataFrame:
    """(path, n_lines, first, last): as `split_texts`, for files (path, length) that nobody loads whole."""
    tables = cut_lineage(scan_files(listing, range_bytes))
    return cut(stitch(tables, ["path"]), ["path"], limit, overlap, stretch_lines)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of the files below a folder, from the listing alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select("path", "length")


def piece_texts(items: DataFrame, pieces: DataFrame, keys: list[str], text_col: str = "content") -> DataFrame:
    """(keys, first, last, text): the pieces with their text.

    Each text meets the list of its pieces once and is searched for line feeds
    once; the pieces are cut from it by byte offset.
    """
    named = items.where(F.col(text_col).isNotNull()).groupBy(*keys).agg(F.max(F.struct(F.octet_length(text_col), text_col)).alias("_t"))
    wanted = pieces.groupBy(*keys).agg(F.collect_list(F.struct("first", "last")).alias("_pieces"))
    joined = wanted.join(named, keys).select(*keys, "_pieces", F.col(f"_t.{text_col}").cast("binary").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name in keys) + ", first bigint, last bigint, text binary"

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keys, "first", "last", "text"]
        for pdf in batches:
            rows, held = [], 0
            for *key, wanted, data in pdf.itertuples(index=False):
                feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
                starts, ends = np.append(0, feeds + 1), np.append(feeds, len(data))
                for p in wanted:
                    rows.append((*key, p["first"], p["last"], data[starts[p["first"] - 1]: ends[p["last"] - 1]]))
                    held += len(rows[-1][-1])
                if held > HELD_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return joined.mapInPandas(slices, schema).withColumn("text", F.col("text").cast("string"))


def split_files_with_texts(
    listing: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES, stretch_lines: int = STRETCH_LINES,
) -> DataFrame:
    """(path, first, last, text): the pieces of files with their texts; the files are scanned once for boundaries and offsets."""
    tables = cut_lineage(scan_files(listing, range_bytes))
    return file_piece_texts(listing, cut(stitch(tables, ["path"]), ["path"], limit, overlap, stretch_lines), range_bytes, tables)


def file_piece_texts(listing: DataFrame, pieces: DataFrame, range_bytes: int = RANGE_BYTES, tables: DataFrame | None = None) -> DataFrame:
    """(path, first, last, text): pieces of files, each read by offset from the range that owns its first line.

    `tables` are the boundary tables from which the pieces were cut, if they
    are at hand; else the files are scanned for them.
    """
    tables = (scan_files(listing, range_bytes) if tables is None else tables).select("path", "range_no", "lo", "n_lines", "first_offset").where("n_lines > 0")
    before = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = tables.withColumn("base", F.coalesce(F.sum("n_lines").over(before), F.lit(0)))
    # both sides are cut at the same lines, so that a piece meets the few ranges near it, not all of its file
    block = lambda line: F.floor(line / STRETCH_LINES)
    held = placed.withColumn("_block", F.explode(F.sequence(block(F.col("base") + 1), block(F.col("base") + F.col("n_lines")))))
    wanted = pieces.select("path", "first", "last", block(F.col("first")).alias("_block"))
    owner = wanted.join(held, ["path", "_block"]).where(F.col("first").between(F.col("base") + 1, F.col("base") + F.col("n_lines")))
    work = owner.groupBy("path", "range_no", "base", "first_offset").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("pieces"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, _, base, offset, wanted in pdf.itertuples(index=False):
                with io.BufferedReader(_opened(path)) as f:
                    f.seek(offset)
                    held, at = [], base + 1  # lines from `at` on, not yet passed by all pieces
                    for p in wanted:
                        while at + len(held) <= p["last"]:
                            held.append(f.readline())
                        held, at = held[p["first"] - at:], p["first"]
                        text = b"".join(held[: p["last"] - p["first"] + 1])
                        text = text[:-1] if text.endswith(b"\n") and held[p["last"] - p["first"]].endswith(b"\n") else text
                        yield pd.DataFrame([(path, p["first"], p["last"], text.decode("utf-8", "replace"))], columns=["path", "first", "last", "text"])

    return work.mapInPandas(fetch, "path string, first bigint, last bigint, text string")
