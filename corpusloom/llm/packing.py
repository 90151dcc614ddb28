"""Order-preserving packing into windows of ``size`` tokens by dynamic programming.

The documents of a task, in their order, form one token stream; each document
ends with the id ``end``. A cut may stand after a document (free), after a
sentence, or, where neither is near, after every ``step`` tokens. With i < j cuts
at most ``size`` apart,

    best(j) = penalty(j) + WINDOW + min over i of best(i) + padding(j - i)

where padding is ``size`` - (j - i), or nothing for a power of two, since such
sequences aren't padded: padding plus truncation penalties, and a small price for
each window, so that short windows must be worth it. The minimum over the sliding
window comes from a monotone queue, that over the powers of two from at most ten
looked-up cuts, so the whole pass is linear in the cuts. Among equally cheap i the
queue's latest wins, then the nearest at a power of two.

The tables are carried on from document to document. A cut is decided as soon as
every cut that may still be continued from, those within the last ``size`` tokens,
descends from it; then it is emitted and what lies before is dropped. The result
is that of the whole stream at once, and memory is what is undecided: up to 1.7
million tokens, some 20 MB, on documents of sf0.1, the task's whole split at worst. Tasks pack independently: no shuffle, one
window that ends with the task's stream. Sequence ids hold the task's number in
their high bits.

A null text is empty: the end id alone. Long texts are cut like others; memory
holds the ids of one. Repeated rows are packed like others, each on its own. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusloom.llm import common, tokenizer

SIZE, STEP = 1024, 16
#: Truncation penalties and the price of a window, in padded tokens.
SENTENCE, INSIDE, WINDOW = 1, 8, 128
#: Ids between two looks for decided cuts.
LOOK = 1 << 15
_ENDS: dict[str, np.ndarray] = {}


def sentence_ends(name: str) -> np.ndarray:
    """For each id whether its bytes close a sentence: a full stop, question or exclamation mark at their end, or a line break."""
    if name not in _ENDS:
        v = tokenizer.vocabulary(name).token_bytes
        out = np.zeros(max(v) + 1, dtype=bool)
        for i, b in v.items():
            out[i] = b.rstrip(b" ").endswith((b".", b"!", b"?")) or b"\n" in b
        _ENDS[name] = out
    return _ENDS[name]


def candidates(closes: np.ndarray, document_ends: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions (0 excluded, the stream's end included) and their penalties."""
    n = len(closes)
    penalty = np.full(n + 1, -1, dtype=np.int64)
    penalty[1:][closes] = SENTENCE
    penalty[document_ends] = 0
    penalty[n] = 0
    cuts = np.flatnonzero(penalty >= 0)
    cuts = cuts[cuts > 0]
    before = np.concatenate(([0], cuts[:-1]))
    extra = np.maximum(cuts - before - 1, 0) // step
    if extra.any():
        base = np.repeat(before, extra)
        turn = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        inside = base + step * turn
        penalty[inside] = INSIDE
        cuts = np.flatnonzero(penalty >= 0)
        cuts = cuts[cuts > 0]
    return cuts, penalty[cuts]


class Chain:
    """The cheapest chain of cuts over a stream that grows; indices count the cuts that are still held."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.at, self.cost, self.came = np.zeros(1, dtype=np.int64), [0], [0]
        self.rising, self.queue = [0], [0]  # best(i) + i of each cut; the cuts that may still be continued from, by rising values

    def extend(self, cuts: np.ndarray, penalties: np.ndarray) -> None:
        """More cuts, no two neighbours more than ``size`` apart."""
        first = len(self.at)
        self.at = at = np.concatenate((self.at, cuts))
        oldest = np.searchsorted(at, cuts - self.size)
        # the cuts a power of two before each, the nearest first, found by their places in the stream
        base = int(cuts[0]) - self.size
        index = np.full(int(cuts[-1]) - base + 1, -1, dtype=np.int64)
        index[at[oldest[0] :] - base] = np.arange(oldest[0], len(at))
        powers = np.array([1 << k for k in range(self.size.bit_length()) if 1 << k < self.size], dtype=np.int64)
        found = index[cuts[:, None] - base - powers]
        place, ways = found[found >= 0].tolist(), np.cumsum((found >= 0).sum(axis=1)).tolist()
        queue, cost, came, rising = self.queue, self.cost, self.came, self.rising
        head, way, last = 0, 0, rising[-1]
        steps = zip(cuts.tolist(), (self.size - cuts).tolist(), (penalties + WINDOW).tolist(), oldest.tolist(), ways, strict=True)
        for n, (j, gap, price, old, until) in enumerate(steps, first):
            while queue[head] < old:
                head += 1
            origin = queue[head]
            least = rising[origin] + gap
            if way < until:
                for w in place[way:until]:
                    if cost[w] < least:
                        least, origin = cost[w], w
                way = until
            least += price
            cost.append(least)
            came.append(origin)
            least += j
            if last >= least:  # the cut before stands last in the queue
                while len(queue) > head and rising[queue[-1]] >= least:
                    queue.pop()
            rising.append(least)
            queue.append(n)
            last = least
        del queue[:head]

    def decided(self) -> list[int]:
        """The cuts that every continuation shares; they are forgotten but for the last, from which the rest goes on."""
        # powers of two reach cuts that left the queue, so all cuts within size are open
        open_ = set(range(int(np.searchsorted(self.at, self.at[-1] - self.size)), len(self.at)))
        heap = [-i for i in open_]
        heapq.heapify(heap)
        while len(heap) > 1:
            i = -heapq.heappop(heap)
            if (origin := self.came[i]) not in open_:
                open_.add(origin)
                heapq.heappush(heap, -origin)
        return self._forget(-heap[0])

    def finish(self) -> list[int]:
        """All cuts left, up to the stream's end."""
        return self._forget(len(self.at) - 1)

    def _forget(self, last: int) -> list[int]:
        out, k = [], last
        while k:
            out.append(k)
            k = self.came[k]
        chain = self.at[out[::-1]].tolist()
        self.queue = [i - last for i in self.queue if i >= last]
        self.at, self.cost, self.rising = self.at[last:].copy(), self.cost[last:], self.rising[last:]
        self.came = np.maximum(np.array(self.came[last:]) - last, 0).tolist()
        return chain


class Packer:
    """Packs one task's stream and yields rows (document, start, length, crc, tokens, sequence, offset)."""

    def __init__(self, name: str, size: int, end: int, first_sequence: int, step: int = STEP, look: int = LOOK):
        self.ends, self.size, self.end, self.sequence, self.step, self.look = sentence_ends(name), size, end, first_sequence, step, look
        self.chain = Chain(size)
        self.held: deque[tuple[object, int, np.ndarray]] = deque()  # (document, its place in the stream, its ids)
        self.fresh: list[np.ndarray] = []  # ids that the chain doesn't cover yet
        self.tokens = self.emitted = self.looked = self.open = 0

    def add(self, document: object, ids: np.ndarray | list[int]) -> Iterator[tuple]:
        own = np.empty(len(ids) + 1, dtype="<u4")
        own[:-1], own[-1] = ids, self.end
        self.held.append((document, self.tokens, own))
        self.fresh.append(own)
        self.tokens += len(own)
        if self.tokens - self.looked >= max(self.look, self.open):  # the more is open, the later the next look
            self._look()
            yield from self._cut(self.chain.decided())
            self.open = self.tokens - self.emitted

    def flush(self) -> Iterator[tuple]:
        if self.fresh:
            self._look()
        if self.tokens > self.emitted:
            yield from self._cut(self.chain.finish())

    def _look(self) -> None:
        cuts, penalties = candidates(self.ends[np.concatenate(self.fresh)], np.cumsum([len(x) for x in self.fresh]), self.step)
        self.chain.extend(cuts + self.looked, penalties)
        self.fresh, self.looked = [], self.tokens

    def _cut(self, chain: list[int]) -> Iterator[tuple]:
        for stop in chain:
            offset = 0
            while self.emitted < stop:
                document, place, own = self.held[0]
                start = self.emitted - place
                length = min(stop, place + len(own)) - self.emitted
                yield document, start, length, zlib.crc32(own[start : start + length].tobytes()), len(own), self.sequence, offset
                self.emitted, offset = self.emitted + length, offset + length
                if start + length == len(own):
                    self.held.popleft()
            self.sequence += 1


def pack(docs: DataFrame, size: int = SIZE, end: int = 0, name: str = tokenizer.DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kept = common.text_of(docs, docs[id_col].alias("doc_id"), text_col=text_col)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    common.lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(name, size, end, TaskContext.get().partitionId() << 40)
        kind = None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for b in batches:
            kind = b.column("doc_id").type
            rows = []
            for document, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                rows += packer.add(document.as_py(), tokenizer.encode_array(text.as_py(), name))
            if rows:
                yield table(rows)
        if rows := list(packer.flush()):
            yield table(rows)

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:]))
