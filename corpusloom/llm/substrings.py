"""Exact substring dedup by seed and extend.

Seeds are winnowed anchors: among the ``length - seed + 1`` seeds (runs of
``seed`` words) inside a window of ``length`` words, the least hash, leftmost
first, is the window's anchor, so equal windows have equal anchors at equal
offsets. The windows that share one anchor occurrence form a run; an occurrence
carries the anchor's hash A and the hash C of its context, the words its run
covers. Occurrences meet on their anchor, and matches extend from it both ways:

* Equal contexts match over their whole length: every occurrence whose (A, C)
  also stands in a smaller document is covered from end to end. This settles the
  inside of every repeat with one row per anchor.
* Where one anchor has several contexts, a repeat ends inside the run. Only the
  smallest document of each such context extends its match window by window
  (any other is covered already); a window that also stands in a smaller
  document's context is covered.

Overlapping covered windows merge into maximal repeats. Members of a group meet
in aggregates and joins on pairs of 64-bit hashes (anchor and context, anchor and
window), never pair by pair, so thousands of copies cost thousands of rows. Keys
that more than one in ``common.HOT`` rows share, a line of every document say, are
joined from a bounded broadcast, so no task gathers them. A window counts as
covered only by a strictly smaller document id, judged on the input. Repeats
inside one document stay.

Null text has no words. Null ids count as larger than any other and as equal to
one another. Repeated rows with one id never cover each other. Texts shorter
than ``length`` words stay as they are. Long texts are read whole; memory is
bounded by a batch of documents and the longest text. Other columns, whatever
their names, are kept or ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common

LENGTH, SEED = 50, 20
#: Occurrences in one bundle, and windows in one batch, at most: both bound the bytes that a task holds at once.
BUNDLE, WINDOWS = 64, 1 << 17
_WORD = re.compile(r"[^\x20\x09-\x0d]+")


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the position of the least, leftmost first."""
    n = len(values) - width + 1
    least, at, span = values, np.arange(len(values)), 1
    while 2 * span <= width:
        right = least[span:] < least[:-span]
        least, at, span = np.where(right, least[span:], least[:-span]), np.where(right, at[span:], at[:-span]), 2 * span
    gap = width - span
    if gap:
        right = least[gap : gap + n] < least[:n]
        at = np.where(right, at[gap : gap + n], at[:n])
    return at[:n]


class Runs:
    """The anchor occurrences of one text."""

    def __init__(self, words: np.ndarray, length: int = LENGTH, seed: int = SEED):
        self.length, n = length, len(words)
        self.count = max(0, n - length + 1)
        if not self.count:
            self.first = self.last = self.anchor = self.context = np.zeros(0, dtype=np.int64)
            return
        self.rolling = Rolling = common.Rolling(words)
        seeds = Rolling.windows(seed)
        at = _leftmost_least(seeds, length - seed + 1)
        cut = np.flatnonzero(at[1:] != at[:-1]) + 1
        self.first = np.concatenate(([0], cut))
        self.last = np.concatenate((cut, [len(at)])) - 1
        where = at[self.first]
        self.anchor = seeds[where].view(np.int64)
        context = Rolling.slices(self.first, self.last + length)
        self.context = common.mixed(context + (where - self.first).astype(np.uint64)).view(np.int64)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen runs: each window's start, its anchor and its hash."""
        size = (self.last - self.first + 1)[chosen]
        start = np.repeat(self.first[chosen] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return start, np.repeat(self.anchor[chosen], size), self.rolling.slices(start, start + self.length).view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str, *columns) -> DataFrame:
    """id with null as the largest, a hash of the text (rows that repeat an id stay apart), the text, and what else is wanted."""
    kept = common.text_of(docs, *columns, F.coalesce(docs[id_col].cast("long"), F.lit(common.MAX_ID)).alias("id"), text_col=text_col)
    return kept.select("id", F.xxhash64("text").alias("body"), "text", *kept.columns[: len(columns)])


#: One occurrence inside a bundle.
_MEMBER = np.dtype([("id", "<i8"), ("body", "<i8"), ("first", "<i4"), ("last", "<i4")])


def occurrences(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Anchor occurrences, those of equal (anchor, context) in a batch of documents bundled in rows of up to ``BUNDLE``.

    anchor, context, least and most id, the bitmap slot ``tag`` of the least, ``batch``, which names the batch of
    documents, and ``members``, the occurrences packed as _MEMBER.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, body = b.column("id").to_numpy(), b.column("body").to_numpy()
        found = [Runs(common.word_hashes(t.as_py().encode()), length, seed) for t in b.column("text")]
        n = [len(r.first) for r in found]
        joined = lambda name: np.concatenate([getattr(r, name) for r in found]) if found else np.zeros(0, dtype=np.int64)
        anchor, context = joined("anchor"), joined("context")
        members = np.zeros(len(anchor), dtype=_MEMBER)
        members["id"], members["body"], members["first"], members["last"] = np.repeat(ids, n), np.repeat(body, n), joined("first"), joined("last")
        order = np.lexsort((members["id"], context, anchor))
        anchor, context, members = anchor[order], context[order], members[order]
        starts = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])))) if len(anchor) else np.zeros(0, dtype=np.int64)
        within = np.arange(len(anchor)) - np.repeat(starts, np.diff(np.append(starts, len(anchor))))
        starts = np.flatnonzero(within % BUNDLE == 0)
        ends = np.append(starts[1:], len(anchor))
        anchor, context, least, most = anchor[starts], context[starts], members["id"][starts], members["id"][ends - 1] if len(starts) else members["id"]
        packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((np.append(starts, len(members)) * _MEMBER.itemsize).astype(np.int32)), pa.py_buffer(members.tobytes())])
        batch = np.full(len(starts), ids[0] ^ body[0] if len(ids) else 0)
        columns = [pa.array(c) for c in (anchor, context, np.ascontiguousarray(least), np.ascontiguousarray(most), common.slots(anchor, context, least).astype(np.int32), batch)]
        return pa.RecordBatch.from_arrays([*columns, packed], ["anchor", "context", "least", "most", "tag", "batch", "members"])

    return common.map_rows(_keyed(docs, id_col, text_col), run, "anchor long, context long, least long, most long, tag int, batch long, members binary")


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats per document: id, body, spans array<struct<start, end>> in words, sorted and disjoint; only documents that have one."""
    seen, bundles = common.kept(occurrences(docs, length, seed, id_col, text_col))
    contexts, _ = common.kept(seen.groupBy("anchor", "context").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min_by("tag", "least").alias("tag"), F.count("*").alias("bundles")))
    copied = contexts.where("least < most").select("anchor", "context", F.col("least").alias("first_id"))
    hot = common.hot_keys(contexts.where("least < most"), ["anchor", "context"], "bundles", bundles)

    def cover(b: pa.RecordBatch) -> pa.RecordBatch:
        packed = b.column("members").to_pylist()
        m = np.frombuffer(b"".join(packed), dtype=_MEMBER)
        m = m[m["id"] > np.repeat(b.column("first_id").to_numpy(), [len(x) // _MEMBER.itemsize for x in packed])]
        m = m[np.lexsort((m["first"], m["body"], m["id"]))]
        ids, body, start, end = (np.ascontiguousarray(m[n]) for n in ("id", "body", "first", "last"))
        end = end + np.int32(length)  # later runs of a document end later
        document = np.concatenate(([True], (ids[1:] != ids[:-1]) | (body[1:] != body[:-1])))[: len(ids)]
        fresh = document | np.concatenate(([True], start[1:] > end[:-1]))[: len(ids)]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(ids))[: len(first)] - 1
        spans = pa.StructArray.from_arrays([pa.array(start[first]), pa.array(end[last])], ["start", "end"])
        heads = np.flatnonzero(document[first])
        return pa.RecordBatch.from_arrays([pa.array(ids[first][heads]), pa.array(body[first][heads]), pa.ListArray.from_arrays(pa.array(np.append(heads, len(first)).astype(np.int32)), spans)], ["id", "body", "spans"])

    # Bundles of later documents go back together by batch, so a document's contexts merge before they are grouped.
    later = common.spread_join(seen.select("anchor", "context", "most", "batch", "members"), copied, ["anchor", "context"], hot).where("most > first_id").select("batch", "first_id", "members")
    whole, _ = common.kept(common.map_rows(later.repartition("batch").sortWithinPartitions("batch"), cover, "id long, body long, spans array<struct<start:int,end:int>>"))
    branching = contexts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    bits = common.bitmap(contexts.join(branching, "anchor", "left_semi").select("tag"))
    _dropped(docs, seen, contexts)

    def extend(batches):
        held, rows = [], 0
        for b in batches:
            for i, body, t in zip(b.column("id").to_pylist(), b.column("body").to_pylist(), b.column("text"), strict=True):
                runs = Runs(common.word_hashes(t.as_py().encode()), length, seed)
                tag = common.slots(runs.anchor, runs.context, np.full(len(runs.first), i))
                chosen = np.flatnonzero(bits.value[tag >> 6] >> (tag & 63) & 1)
                for at in range(0, len(chosen), WINDOWS // length):
                    start, anchor, window = runs.windows(chosen[at : at + WINDOWS // length])
                    held.append((np.full(len(start), i), np.full(len(start), body), start.astype(np.int32), anchor, window))
                    rows += len(start)
                    if rows >= WINDOWS:
                        yield _table(held)
                        held, rows = [], 0
        if held:
            yield _table(held)

    steps, windows = common.kept(_keyed(docs, id_col, text_col).mapInArrow(extend, "id long, body long, start int, anchor long, window long"))
    met, _ = common.kept(steps.groupBy("anchor", "window").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("rows")).where("least < most"))
    hot = common.hot_keys(met, ["anchor", "window"], "rows", windows)
    partly = common.spread_join(steps, met.select("anchor", "window", "least"), ["anchor", "window"], hot).where("id > least")
    partly = partly.groupBy("id", "body").agg(F.collect_list(F.struct("start", (F.col("start") + length).cast("int").alias("end"))).alias("spans"))
    both = whole.union(partly).groupBy("id", "body").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def merge(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for s in b.column("spans"):
            flat = s.values.flatten()
            out.append(_merged(flat[0].to_numpy(), flat[1].to_numpy()))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("body"), pa.array(out, kind)], ["id", "body", "spans"])

    found = common.written(common.map_rows(both, merge, "id long, body long, spans array<struct<start:int,end:int>>"), "spans")
    _dropped(docs, whole, steps, met)
    return found


def _dropped(docs: DataFrame, *stored: DataFrame) -> None:
    for table in stored:
        table.unpersist()
    common.release(docs.sparkSession)


def _table(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["id", "body", "start", "anchor", "window"])


def _merged(start: np.ndarray, end: np.ndarray) -> list[dict]:
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(start[1:] > end[:-1]) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(start)])) - 1
    return [{"start": int(a), "end": int(b)} for a, b in zip(start[first], end[last], strict=True)]


def _with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, *columns) -> DataFrame:
    """id, body, text, the wanted columns and the row's spans or null. Rows that a bitmap of (id, body) shows to have none aren't shuffled."""
    keyed = _keyed(docs, id_col, text_col, *columns).withColumn("slot", common.slot("id", "body"))
    keyed = common.marked(keyed, spans.select(common.slot("id", "body").alias("slot")), "slot", "maybe").drop("slot")
    plain = keyed.where(~F.col("maybe")).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return plain.drop("maybe").unionByName(keyed.where("maybe").drop("maybe").join(spans, ["id", "body"], "left"))


def _spans(value: pa.Scalar) -> list[tuple[int, int]]:
    return [(s["start"], s["end"]) for s in value.as_py() or []]


def removed_digests(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: ``doc_id``, n_words, n_removed and the digest of the kept words joined by one space."""
    joined = _with_spans(docs, repeats(docs, length, seed, id_col, text_col), id_col, text_col, docs[id_col].alias("doc_id")).select("doc_id", "text", "spans")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, sha = [], [], []
        for t, s in zip(b.column("text"), b.column("spans"), strict=True):
            words = t.as_py().encode().split()
            kept, at, lost = [], 0, 0
            for start, end in _spans(s):
                kept += words[at:start]
                at, lost = end, lost + end - start
            kept += words[at:]
            n.append(len(words)), gone.append(lost), sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return common.map_rows(joined, run, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what stands between kept words stays as it was."""
    if not spans:
        return text
    words, out, at = [m.span() for m in _WORD.finditer(text)], [], 0
    for start, end in spans:
        out.append(text[at : words[start][0]])
        at = words[end][0] if end < len(words) else len(text)
    return "".join([*out, text[at:]])


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, every row and column, with repeated passages cut out of the text."""
    plain, name = common.numbered(docs)
    id_col, text_col, kind = name[id_col], name[text_col], docs.schema[text_col].dataType
    others = [c for c in plain.columns if c != text_col]
    joined = _with_spans(plain, repeats(plain, length, seed, id_col, text_col), id_col, text_col, plain[text_col].isNull().alias("none"), *others)

    @F.pandas_udf("string")
    def shortened(texts, spans):
        return texts.combine(spans, lambda t, s: None if t is None else cut(t, [(x["start"], x["end"]) for x in s]))

    # A null in place of the text of every row without a repeat: those don't travel to Python.
    changed = shortened(F.when(F.col("spans").isNotNull(), F.col("text")), "spans")
    whole = F.when(~F.col("none"), F.coalesce("changed", F.col("text"))).cast(kind).alias(text_col)
    return joined.withColumn("changed", changed).select(*(whole if c == text_col else c for c in plain.columns)).toDF(*docs.columns)
