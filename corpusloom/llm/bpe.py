"""BPE by a segment tree over adjacent pair ranks.

A word's symbols are the leaves; leaf i holds the rank of the pair (i, next i),
so the root yields the lowest rank and, among equals, the leftmost position.
Merging that pair changes two ranks at most, each a logarithmic point update.
When the root holds no rank, nothing can be merged and the symbols are the ids.

``encode_word`` does this for one word. ``encode_words`` runs many trees of one
size side by side as rows of a matrix, one merge per word and step. Both are
exact; words are cached up to a fixed number per process.

A null or empty text has no ids. Long texts are encoded whole, word by word; a long
word has a tree of its own, so time stays n log n. Among pairs of one rank the
leftmost merges first. Repeated rows each get a row; an empty table gives an empty
result; other columns, whatever their names, are neither read nor returned.
Decoding joins the token bytes and replaces malformed UTF-8, as the library does.
Files other than plain byte-level BPE are refused.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusloom.llm import common, tokenizer

_NONE = 1 << 40  # above any rank and position
#: Words of more bytes get a tree of their own.
_WIDE = 128
_KEEP = 200_000

_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
#: The tokenizer's word pattern for texts whose letters all lie below U+0250, and for any text.
_LATIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[ɐ-\U0010ffff]")
_ANY = regex.compile(tokenizer.PATTERN)


def words_of(text: str) -> list[str]:
    return (_ANY if _BEYOND.search(text) else _LATIN).findall(text)


class Encoder:
    """Encoding and decoding with one vocabulary file."""

    def __init__(self, name: str = tokenizer.DEFAULT):
        self.vocabulary = v = tokenizer.vocabulary(name)
        self.byte_ids = np.array(v.byte_ids, dtype=np.int64)
        pairs = sorted((a << 20 | b, rank, merged) for (a, b), (rank, merged) in v.merges.items())
        self.keys, self.ranks, self.merged = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        self.cache: dict[str, bytes] = {}
        self.pieces = [v.token_bytes.get(i, b"") for i in range(max(v.token_bytes) + 1)]

    def encode_word(self, data: bytes) -> list[int]:
        """One tree; n log n however long the word is."""
        merges, ids = self.vocabulary.merges, [self.vocabulary.byte_ids[b] for b in data]
        n = len(ids)
        size = 1 << max(0, (n - 1).bit_length())
        shift, none = size.bit_length(), (_NONE, 0)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        leaf = lambda i: (merges.get((ids[i], ids[after[i]]), none)[0] << shift) + i if after[i] < n else _NONE << shift
        tree = [_NONE << shift] * (2 * size)
        for i in range(n):
            tree[size + i] = leaf(i)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        while tree[1] >> shift < _NONE:
            i = tree[1] & ((1 << shift) - 1)
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, _NONE << shift)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and merged id of each pair."""
        want = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        hit = self.keys[at] == want
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) > _WIDE:
                out[k] = np.array(self.encode_word(w), dtype="<u4").tobytes()
            elif w:
                by_size.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(k)
        for size, chosen in by_size.items():
            step = max(64, (1 << 19) // size)
            for at in range(0, len(chosen), step):
                part = chosen[at : at + step]
                for k, ids in zip(part, self._side_by_side([words[k] for k in part], size), strict=True):
                    out[k] = ids
        return out

    def _side_by_side(self, words: list[bytes], size: int) -> list[bytes]:
        m, shift = len(words), size.bit_length()
        none = _NONE << shift
        lengths = np.array([len(w) for w in words])
        ids = self.byte_ids[np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), dtype=np.uint8)].reshape(m, size)
        place = np.arange(size)
        # one spare column on either side takes writes that fall off the word
        after = np.tile(np.arange(1, size + 2), (m, 1))
        before = np.tile(np.arange(-1, size), (m, 1))
        tree = np.full((m, 2 * size), none, dtype=np.int64)
        rank, _ = self._pairs(ids[:, :-1], ids[:, 1:])
        last = place[None, :-1] + 1 < lengths[:, None]
        tree[:, size : 2 * size - 1] = np.where(last & (rank < _NONE), (rank << shift) + place[:-1], none)
        k = size
        while k > 1:
            np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2], out=tree[:, k // 2 : k])
            k >>= 1
        live = np.flatnonzero(tree[:, 1] < none)
        while len(live):
            i = tree[live, 1] & ((1 << shift) - 1)
            j = after[live, i]
            _, merged = self._pairs(ids[live, i], ids[live, j])
            ids[live, i] = merged
            far = after[live, j]
            after[live, i] = far
            before[live, far] = i
            self._put(tree, live, j, np.full(len(live), none), size)
            end = lengths[live]
            for p, q in ((i, far), (before[live, i], i)):
                ok = (p >= 0) & (q < end)
                rank, _ = self._pairs(ids[live, np.maximum(p, 0)], ids[live, np.minimum(q, size - 1)])
                self._put(tree, live[p >= 0], p[p >= 0], np.where(ok & (rank < _NONE), (rank << shift) + p, none)[p >= 0], size)
            live = live[tree[live, 1] < none]
        keep = np.zeros((m, size + 1), dtype=bool)
        at, rows = np.zeros(m, dtype=np.int64), np.arange(m)
        while len(rows):
            keep[rows, at] = True
            at = after[rows, at]
            more = at < lengths[rows]
            rows, at = rows[more], at[more]
        flat = ids[keep[:, :size]].astype("<u4").tobytes()
        ends = 4 * np.cumsum(keep.sum(axis=1))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, size: int) -> None:
        k = leaf + size
        tree[rows, k] = value
        while size > 1:
            k = k >> 1
            tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
            size >>= 1

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, as little-endian unsigned 32-bit integers."""
        if len(self.cache) > _KEEP:
            self.cache.clear()
        cache, split, new = self.cache, [], {}
        for text in texts:
            parts = [(words_of(p), special) if special is None else ([], special) for p, special in self.vocabulary.parts(text)]
            split.append(parts)
            for ws, _ in parts:
                new.update((w, None) for w in ws if w not in cache)
        if new:
            cache.update(zip(new, self.encode_words([w.encode() for w in new]), strict=True))
        special_ids = {i: np.array([i], dtype="<u4").tobytes() for i in self.vocabulary.added.values()}
        return [b"".join(b"".join(map(cache.__getitem__, ws)) if special is None else special_ids[special] for ws, special in parts) for parts in split]

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The text that the ids stand for, added tokens included."""
        ids = np.frombuffer(ids, dtype="<u4") if isinstance(ids, bytes) else ids
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def encoder(name: str = tokenizer.DEFAULT) -> Encoder:
    return Encoder(name)


def bpe_ids(docs: DataFrame, name: str = tokenizer.DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: ``doc_id`` and ``ids``, an array of token ids of its whole text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        flat = encoder(name).encode_batch(b.column("text").to_pylist())
        ends = np.cumsum([0] + [len(x) // 4 for x in flat])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(flat), dtype="<u4").astype(np.int32)))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    kept = common.text_of(docs, docs[id_col].alias("doc_id"), text_col=text_col)
    return common.map_rows(kept, run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_digests(docs: DataFrame, name: str = tokenizer.DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoding and decoding in one pass: n_tokens and the digests of ids and of the decoded text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(name)
        flat = e.encode_batch(b.column("text").to_pylist())
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(x) // 4 for x in flat], pa.int64()), pa.array([sha(x) for x in flat]), pa.array([sha(e.decode(x).encode()) for x in flat])],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    kept = common.text_of(docs, docs[id_col].alias("doc_id"), text_col=text_col)
    return common.map_rows(kept, run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
