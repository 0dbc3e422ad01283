"""Evaluation passages in a training corpus, found with a stored positional inverted index.

The corpus is indexed once, in segments of bounded size: for each of its terms
a segment stores the sorted positions, and beside them where its documents
begin. The index lies in the shared folder, its postings in parts by term, and
any number of query blocks are answered from it; texts aren't read again. A
block takes the postings of its own words only, which are brought together by
segment. Within a segment a window of consecutive test words is looked up from
its rarest term on: the posting list of that term, shifted by the term's
offset in the window, is intersected with the shifted list of the next rarest,
and so on.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from lodeglass.session import ensure_checkpoint_dir, spread

MIN_WORDS = 12
#: Characters of text in one index segment.
SEGMENT_CHARS = 4 << 20
#: Words of test items that go to the executors at once; larger query sets pass in blocks.
BLOCK_WORDS = 1_000_000
#: Places of a segment that one step of a search with gaps looks at.
PLACES = 50_000

_WORD = re.compile("[a-z0-9]+")


def words(text: str) -> list[str]:
    """Longest runs of a-z and 0-9 after lower-casing."""
    return _WORD.findall(text.lower())


class QuerySet:
    """Test items as numbered words; items with fewer than `min_words` words can't match and are left out."""

    def __init__(self, items: list[tuple], min_words: int):
        self.min_words = min_words
        self.vocabulary: dict[str, int] = {}
        self.ids, self.codes = [], []
        for item_id, text in items:
            found = words(text)
            if len(found) >= min_words:
                self.ids.append(item_id)
                self.codes.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found], np.int32))


class Segment:
    """Positional postings of some documents, for the words that the query set knows."""

    @classmethod
    def stored(cls, starts: np.ndarray, postings: list[tuple[int, np.ndarray]], n_codes: int) -> Segment:
        """The segment whose documents begin at `starts` (the last of which is its end), from (code, positions) of the index."""
        self = cls.__new__(cls)
        self.starts = np.asarray(starts, np.int64)
        self.at = np.full(int(self.starts[-1]), -1, np.int32)
        self.counts = np.zeros(n_codes, np.int64)
        postings = sorted(postings, key=lambda x: x[0])
        for code, positions in postings:
            self.at[positions] = code
            self.counts[code] = len(positions)
        self._ends = np.cumsum(self.counts)
        self._positions = np.concatenate([p for _, p in postings]) if postings else np.zeros(0, np.int64)
        return self

    def __init__(self, texts: list[str], queries: QuerySet):
        known, codes, starts = queries.vocabulary.get, [], [0]
        for text in texts:
            codes += [known(w, -1) for w in words(text)]
            codes.append(-1)  # no passage runs over the end of a document
            starts.append(len(codes))
        self.at = np.array(codes, np.int32)
        self.starts = np.array(starts, np.int64)
        order = np.argsort(self.at, kind="stable")
        order = order[np.searchsorted(self.at[order], 0):]
        self.counts = np.bincount(self.at[order], minlength=len(queries.vocabulary)) if len(order) else np.zeros(len(queries.vocabulary), np.int64)
        self._ends = np.cumsum(self.counts)
        self._positions = order

    def postings(self, code: int) -> np.ndarray:
        end = self._ends[code]
        return self._positions[end - self.counts[code]: end]

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1

    def exact(self, item: np.ndarray, width: int) -> set[int]:
        """Documents with `width` consecutive words of the item."""
        found: set[int] = set()
        counts = self.counts[item]
        windows = np.lib.stride_tricks.sliding_window_view(counts, width)
        for w in np.flatnonzero(windows.min(axis=1)):
            rarest = np.argsort(counts[w: w + width], kind="stable")
            starts = self.postings(item[w + rarest[0]]) - rarest[0]
            for k in rarest[1:]:
                listed = self.postings(item[w + k])
                place = np.searchsorted(listed, starts + k)
                starts = starts[listed[np.minimum(place, len(listed) - 1)] == starts + k]
                if not len(starts):
                    break
            found.update(self.documents(starts).tolist())
        return found

    def near(self, item: np.ndarray, width: int, misses: int) -> dict[int, int]:
        """Documents with a window of the item of which all but `misses` words stand in their places; the most such words.

        Of any ``misses + 1`` terms of such a window one at least is in place,
        so the shifted lists of the window's rarest ones, put together, hold
        all places to look at.
        """
        best: dict[int, int] = {}
        counts = self.counts[item]
        for w in range(len(item) - width + 1):
            if np.count_nonzero(counts[w: w + width]) < width - misses:
                continue
            rarest = np.argsort(counts[w: w + width], kind="stable")[: misses + 1]
            starts = np.unique(np.concatenate([self.postings(item[w + k]) - k for k in rarest]))
            starts = starts[(starts >= 0) & (starts + width <= len(self.at))]
            if not len(starts):
                continue
            places = starts[:, None] + np.arange(width)
            docs = self.documents(starts)
            within = starts + width < self.starts[docs + 1]  # the last place of a document is its end mark
            hits = (self.at[places] == item[w: w + width]).sum(axis=1)
            good = within & (hits >= width - misses)
            for doc, n in zip(docs[good].tolist(), hits[good].tolist()):
                best[doc] = max(best.get(doc, 0), n)
        return best

    def near_with_gaps(self, item: np.ndarray, width: int, misses: int, gaps: int) -> dict[int, int]:
        """Documents that hold all but `misses` words of a window of the item in their order, within ``width + gaps`` words; the most such words.

        One at least of the window's ``misses + 1`` rarest terms is among
        them. If the one at offset k stands at p, the stretch begins between
        ``p - k - gaps - misses`` and ``p - k + misses``; only where the words
        around hold enough of the window's are its beginnings looked at.
        """
        best: dict[int, int] = {}
        counts, need, span = self.counts[item], width - misses, width + gaps
        around = np.arange(-gaps - misses, misses + span)
        member = np.zeros(len(self.counts) + 1, bool)  # the last one is that of -1
        for w in range(len(item) - width + 1):
            if np.count_nonzero(counts[w: w + width]) < need:
                continue
            window, rarest = item[w: w + width], np.argsort(counts[w: w + width], kind="stable")[: misses + 1]
            found = [(self.postings(window[k]), k) for k in rarest]
            docs = np.concatenate([self.documents(p) for p, _ in found])
            keys = np.unique(docs * (len(self.at) + width) + np.concatenate([p - k for p, k in found]) + width)
            if not len(keys):
                continue
            docs, begin = keys // (len(self.at) + width), keys % (len(self.at) + width) - width
            member[window] = True
            for part in range(0, len(keys), PLACES):
                doc = docs[part: part + PLACES]
                places = begin[part: part + PLACES, None] + around
                inside = (places >= self.starts[doc, None]) & (places < self.starts[doc + 1, None] - 1)  # without the end mark
                codes = np.where(inside, self.at[np.clip(places, 0, len(self.at) - 1)], -1)
                enough = np.flatnonzero(member[codes].sum(axis=1) >= need)
                if len(enough):
                    views = np.lib.stride_tricks.sliding_window_view(codes[enough], span, axis=1)
                    hits = _in_order(views.reshape(-1, span), window).reshape(len(enough), -1).max(axis=1)
                    for d, n in zip(doc[enough].tolist(), hits.tolist()):
                        if n >= need:
                            best[d] = max(best.get(d, 0), n)
            member[window] = False
        return best


def _in_order(stretches: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The most words of `window` that each row of `stretches` holds in their order."""
    before = np.zeros((len(stretches), len(window) + 1), np.int16)
    for k in range(stretches.shape[1]):
        now = np.zeros_like(before)
        np.maximum(before[:, 1:], before[:, :-1] + (stretches[:, k, None] == window), out=now[:, 1:])
        before = np.maximum.accumulate(now, axis=1)
    return before[:, -1]


def _slices(lengths: list[int], segment_chars: int) -> Iterator[slice]:
    """Slices of at most `segment_chars` characters, or of one text that is longer."""
    begin = held = 0
    for k, n in enumerate(lengths):
        if held and held + n > segment_chars:
            yield slice(begin, k)
            begin, held = k, 0
        held += n
    if len(lengths) > begin:
        yield slice(begin, len(lengths))


class PassageIndex:
    """A stored index: rows (part, segment, term, positions, ids).

    A row with a term holds the term's positions in the segment; the row
    without holds the ids of the segment's documents, and as positions where
    each begins, the segment's end last.
    """

    #: Parts by term, so that a query reads the parts of its own words.
    PARTS = 64

    def __init__(self, spark: SparkSession, folder: str, doc_col: str, schema: StructType | None = None):
        self.spark, self.folder, self.doc_col, self.schema = spark, folder, doc_col, schema

    def rows(self) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(self.schema) if self.schema else reader).parquet(self.folder)


def build_index(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", folder: str | None = None, segment_chars: int | None = None) -> PassageIndex:
    """Index a corpus into `folder`, or a new one below the shared checkpoint folder.

    Null ids and texts are left out. Texts are tokenized here and never again;
    nothing is shuffled.
    """
    spark, room = documents.sparkSession, segment_chars or SEGMENT_CHARS
    folder = folder or f"{ensure_checkpoint_dir(spark)}/passages-{uuid.uuid4().hex}"
    docs = spread(documents.where(F.col(doc_col).isNotNull() & F.col(text_col).isNotNull()).select(doc_col, text_col))
    schema = StructType().add("segment", LongType()).add("term", StringType()).add("positions", ArrayType(IntegerType())).add("ids", ArrayType(documents.schema[doc_col].dataType))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for pdf in batches:
            for part in _slices(pdf[text_col].str.len().tolist(), room):
                ids, codes, starts, vocabulary = pdf[doc_col].iloc[part].tolist(), [], [0], {}
                for text in pdf[text_col].iloc[part]:
                    codes += [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
                    codes.append(-1)  # no passage runs over the end of a document
                    starts.append(len(codes))
                at = np.array(codes, np.int32)
                order = np.argsort(at, kind="stable").astype(np.int32)
                order = order[np.searchsorted(at[order], 0):]
                ends = np.cumsum(np.bincount(at[order], minlength=len(vocabulary)))[:-1] if vocabulary else []
                lists = np.split(order, ends) if vocabulary else []
                rows = [[number, None, np.array(starts, np.int32), ids], *([number, w, p, None] for w, p in zip(vocabulary, lists))]
                number += 1
                yield pd.DataFrame(rows, columns=schema.names)

    found = docs.mapInPandas(index, schema).withColumn("part", F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(PassageIndex.PARTS)).cast("int")))
    found.write.partitionBy("part").parquet(folder)
    return PassageIndex(spark, folder, doc_col, found.schema)  # known even where no part was written


def _blocks(items: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple]]:
    rows = items.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(item_col, text_col).dropDuplicates()
    block, held = [], 0
    for item_id, text in rows.toLocalIterator():
        n = len(words(text))
        if block and held + n > block_words:
            yield block
            block, held = [], 0
        block.append((item_id, text))
        held += n
    yield block


def find_passages(
    documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", min_words: int = MIN_WORDS, misses: int = 0, block_words: int = BLOCK_WORDS, gaps: int = 0,
) -> DataFrame:
    """(doc_id, item_id, matched): documents that hold `min_words` consecutive words of an item.

    With `misses` up to that many of the words may be others (proximity
    matches); `matched` is then the most words found in place, else
    `min_words`. With `gaps` the words needn't stand in fixed places: all but
    `misses` of them must stand in their order within ``min_words + gaps``
    words of the document, so that words may be put in or left out as well;
    `matched` is then the most words found in order. Rows are distinct. Null ids and texts are left out; items with
    fewer words can't match, nor can documents, unless words may be left out. Repeated documents and items each
    report under their own id. Other columns are ignored. The corpus is
    indexed once; the items, a stated query set, are answered from the index
    in blocks of `block_words` words.
    """
    _checked(min_words, misses, gaps)
    return search_index(build_index(documents, doc_col, text_col), items, item_col, item_text_col, min_words, misses, block_words, gaps)


def _checked(min_words: int, misses: int, gaps: int) -> None:
    if not 0 <= misses < min_words:
        raise ValueError("0 <= misses < min_words must hold")
    if gaps < 0:
        raise ValueError("gaps must not be negative")


def _searcher(queries: QuerySet, doc_col: str, item_col: str, misses: int, gaps: int):
    """What answers a block of items for one segment, given the segment's rows of the index."""
    width = queries.min_words

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        about = pdf[pdf["term"].isna()].iloc[0]
        postings = [(queries.vocabulary[t], np.asarray(p, np.int64)) for t, p in zip(pdf["term"], pdf["positions"]) if t is not None]
        segment, out = Segment.stored(about["positions"], postings, len(queries.vocabulary)), []
        for item_id, item in zip(queries.ids, queries.codes):
            if gaps:
                hits = segment.near_with_gaps(item, width, misses, gaps)
            else:
                hits = segment.near(item, width, misses) if misses else dict.fromkeys(segment.exact(item, width), width)
            out += [(about["ids"][doc], item_id, n) for doc, n in hits.items()]
        return pd.DataFrame(out, columns=[doc_col, item_col, "matched"])

    return search


def search_index(
    index: PassageIndex, items: DataFrame, item_col: str = "item_id", item_text_col: str = "text",
    min_words: int = MIN_WORDS, misses: int = 0, block_words: int = BLOCK_WORDS, gaps: int = 0,
) -> DataFrame:
    """(doc_id, item_id, matched) as `find_passages`, from a stored index.

    Each block is answered and its rows written to the shared folder before
    the next is taken up, so that the driver holds the words of one block.
    """
    _checked(min_words, misses, gaps)
    spark, doc_col = index.spark, index.doc_col
    rows = index.rows()
    schema = StructType().add(doc_col, rows.schema["ids"].dataType.elementType).add(item_col, items.schema[item_col].dataType).add("matched", IntegerType())
    folder, written = f"{ensure_checkpoint_dir(spark)}/matches-{uuid.uuid4().hex}", 0
    for block in _blocks(items, item_col, item_text_col, block_words):
        queries = QuerySet(block, min_words)
        if not queries.ids:
            continue

        asked = spark.createDataFrame([(w,) for w in queries.vocabulary], "term string")
        asked = asked.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PassageIndex.PARTS)).cast("int"))
        # at most block_words words
        wanted = rows.join(F.broadcast(asked), ["part", "term"], "left_semi").unionByName(rows.where("part = -1"))
        found = wanted.groupBy("segment").applyInPandas(_searcher(queries, doc_col, item_col, misses, gaps), schema)
        found.groupBy(doc_col, item_col).agg(F.max("matched").alias("matched")).write.mode("append").parquet(folder)
        written += 1
    if not written:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(folder)
    # an item's texts may have stood in several blocks
    return found if written == 1 else found.groupBy(doc_col, item_col).agg(F.max("matched").alias("matched"))
