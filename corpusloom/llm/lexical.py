"""Ranked lexical search by windowed bucket scoring.

Terms are maximal runs of ASCII letters and digits and of anything beyond ASCII;
only A-Z are lower-cased. A first pass over the documents keeps, per document, its
number of terms and the postings of the terms that items ask for, and from that
table come the corpus statistics. A second pass reads the postings in order of
doc_id. A window is the rows of ``WINDOW`` consecutive doc_ids, ``WINDOW`` rows at
most (more rows of the same ids make further windows): its postings are sorted by
term once, each with what it adds to a score. Every item then scatters the
postings of its terms into an array of WINDOW sums, ORs the terms' occupancy
bitsets, and harvests the occupied sums into its heap of ``k``. A window whose
largest possible sum can't pass the heap's least is skipped. A task emits its
heaps, at most k rows an item, which a windowed top-k merges.

All sums are 64-bit integers; a term's weight comes from one double logarithm.

Items are worked off in blocks whose terms, ``TERMS`` different ones at most unless
a single item has more, are broadcast; each block reads all documents. The driver
holds one block at a time.

Documents: null and term-less texts count nowhere. Rows without an id count in the
statistics and are not returned. Repeated rows are documents of their own, each of
which is returned. Texts are read in pieces, whole, whatever their length. Items:
null ids take no part, nor do texts without a term; repeated rows count once, and
an id with several texts asks for the terms of all. Ties go to the smaller doc_id.
Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm import common

WINDOW, TERMS, K = 8192, 1 << 15, 10

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_PIECE = 1 << 20


def words(data: bytes) -> Iterator[list[bytes]]:
    """The terms of UTF-8 bytes, piece by piece; none straddles two pieces."""
    data, at = data.translate(_TABLE), 0
    while at < len(data):
        end = at + _PIECE
        if end < len(data):
            cut = data.find(b" ", end)
            end = len(data) if cut < 0 else cut
        yield data[at:end].split()
        at = end


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with a term: doc_id, n (its terms), and its wanted terms by number with their occurrences."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.encode(docs[text_col].cast("string"), "UTF-8").alias("data")).where("data IS NOT NULL")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        number, sizes, ends, terms, tfs = sent.value.get, [], [0], [], []
        for data in b.column("data"):
            n, found = 0, Counter()
            for some in words(data.as_py()):
                n += len(some)
                found.update(map(number, some))
            found.pop(None, None)
            sizes.append(n)
            terms += found.keys()
            tfs += found.values()
            ends.append(len(terms))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return common.map_rows(rows, count, "doc_id long, n long, terms array<int>, tfs array<int>").where("n > 0")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Block:
    """Items with their terms by number and how often each asks for them."""

    def __init__(self, items: list[tuple[object, Counter]]):
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for _, asked in items for t in asked}))}
        self.ids = [i for i, _ in items]
        self.terms = [np.array([self.vocabulary[t] for t in asked], dtype=np.int64) for _, asked in items]
        self.times = [np.array(list(asked.values()), dtype=np.int64) for _, asked in items]


def blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[Block]:
    """The items in order of their ids, in blocks of at most ``most`` terms, an item with more alone."""
    rows = items.select(items[id_col].alias("id"), items[text_col].cast("string").alias("body")).where("id IS NOT NULL AND body IS NOT NULL").distinct().orderBy("id", "body")
    held: list[tuple[object, Counter]] = []
    for r in rows.toLocalIterator():
        asked = Counter(w for some in words(r["body"].encode()) for w in some)
        if held and held[-1][0] == r["id"]:
            held[-1][1].update(asked)
            continue
        if held and sum(len(c) for _, c in held) + len(asked) > most:
            yield Block(held)
            held = []
        if asked:
            held.append((r["id"], asked))
    if held:
        yield Block(held)


class Scorer:
    """Scores windows of documents for every item of a block and keeps each item's k best. Windows come in order of doc_id."""

    def __init__(self, block: Block, weights: np.ndarray, documents: int, length: int, k: int, window: int):
        self.block, self.weights, self.documents, self.length, self.k, self.window = block, weights, documents, length, k, window
        self.sums = np.zeros(window, dtype=np.int64)
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in block.ids]  # (score, -doc_id)

    def add(self, ids: np.ndarray, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """One window: the documents, and postings as row of the window, term and occurrences."""
        if not len(row):
            return
        m = 25 + 75 * n * self.documents // self.length
        gain = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
        order = np.argsort(term, kind="stable")
        row, term, gain = row[order], term[order], gain[order]
        starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        here = np.full(len(self.weights), -1, dtype=np.int64)
        here[term[starts]] = np.arange(len(starts))
        most, ends, bits = np.maximum.reduceat(gain, starts), np.append(starts[1:], len(term)), {}
        for heap, terms, times in zip(self.heaps, self.block.terms, self.block.times, strict=True):
            at = here[terms]
            own, times = at[at >= 0], times[at >= 0]
            floor = heap[0][0] if len(heap) == self.k else 0
            if not len(own) or int((most[own] * times).sum()) <= floor:
                continue
            occupied = np.zeros(self.window // 8, dtype=np.uint8)
            for t, q in zip(own.tolist(), times.tolist(), strict=True):
                slots = row[starts[t] : ends[t]]
                self.sums[slots] += q * gain[starts[t] : ends[t]]
                if t not in bits:
                    mark = np.zeros(self.window, dtype=bool)
                    mark[slots] = True
                    bits[t] = np.packbits(mark)
                occupied |= bits[t]
            self.harvest(heap, np.flatnonzero(np.unpackbits(occupied)), ids, floor)

    def harvest(self, heap: list[tuple[int, int]], slots: np.ndarray, ids: np.ndarray, floor: int) -> None:
        scores = self.sums[slots]
        self.sums[slots] = 0
        good = scores > floor
        slots, scores = slots[good], scores[good]
        if len(scores) > self.k:
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            slots, scores = slots[scores >= edge], scores[scores >= edge]
            best = np.lexsort((ids[slots], -scores))[: self.k]
            slots, scores = slots[best], scores[best]
        for entry in zip(scores.tolist(), (-ids[slots]).tolist(), strict=True):
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def _pieces(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows of rows sorted by doc_id: ids, n, and the postings' rows in the window, terms and occurrences."""
    held: list[tuple[np.ndarray, ...]] = []
    size, current = 0, None

    def whole() -> tuple[np.ndarray, ...]:
        starts = np.cumsum([0, *(len(h[0]) for h in held)])
        parts = zip(*((ids, n, row + s, term, tf) for (ids, n, row, term, tf), s in zip(held, starts, strict=False)), strict=True)
        return tuple(np.concatenate(p) for p in parts)

    for b in batches:
        ids, n = b.column("doc_id").to_numpy(), b.column("n").to_numpy()
        lists = b.column("terms")
        sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        term, tf = lists.flatten().to_numpy(), b.column("tfs").flatten().to_numpy().astype(np.int64)
        span = ids // window
        at = 0
        while at < len(ids):
            if held and (span[at] != current or size == window):
                yield whole()
                held, size = [], 0
            current = span[at]
            end = min(at + int(np.searchsorted(span[at:], current, side="right")), at + window - size)
            row = np.repeat(np.arange(end - at), sizes[at:end])
            held.append((ids[at:end], n[at:end], row, term[ends[at] : ends[end]], tf[ends[at] : ends[end]]))
            size += end - at
            at = end
    if held:
        yield whole()


def _ranked(docs: DataFrame, block: Block, kind: str, k: int, window: int, id_col: str, text_col: str) -> DataFrame | None:
    spark = docs.sparkSession
    stored = common.written(postings(docs, block.vocabulary, id_col, text_col), "postings")
    n, length = stored.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n:
        return None
    weights = np.zeros(len(block.vocabulary), dtype=np.int64)
    for r in stored.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the block
        weights[r["term"]] = weight(n, r["count"])
    sent = spark.sparkContext.broadcast((block, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value, n, length, k, window)
        for piece in _pieces(batches, window):
            scorer.add(*piece)
        found = [(i, -d, s) for i, heap in zip(scorer.block.ids, scorer.heaps, strict=True) for s, d in heap]
        ids, doc_ids, scores = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(doc_ids, pa.int64()), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"])

    arrow = to_arrow_type(spark.createDataFrame([], f"item_id {kind}").schema["item_id"].dataType)
    # the second key deals out rows of one id that is very frequent
    rows = stored.where("doc_id IS NOT NULL AND size(terms) > 0").withColumn("salt", F.xxhash64("n", "terms", "tfs", F.monotonically_increasing_id()))
    ordered = rows.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id").select("doc_id", "n", "terms", "tfs")
    common.lean(spark)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    found = ordered.mapInArrow(run, f"item_id {kind}, doc_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, window: int = WINDOW, terms: int = TERMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per item its k best documents of a score above 0: item_id, rank, doc_id, score. window: a multiple of 8."""
    if window < 8 or window % 8 or k < 1:
        raise ValueError("window must be a multiple of 8, k at least 1")
    kind = items.schema[item_col].dataType.simpleString()
    found = [r for b in blocks(items, item_col, item_text, terms) if (r := _ranked(docs, b, kind, k, window, id_col, text_col)) is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found if len(found) == 1 else [common.written(f, "ranked") for f in found])


SQL = r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM terms GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM terms SEMI JOIN asked USING (term) GROUP BY doc_id, term),
df AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term),
scored AS (SELECT item_id, doc_id, sum(times * (w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
