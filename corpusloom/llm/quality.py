"""Supervised subword embeddings for document quality.

Every word and every character n-gram (2 to 4 letters of a word between its
boundary marks) is hashed to one of ``BUCKETS`` learned vectors; a word that
repeats the one before it adds, beside its own, ``REPEATED`` times the feature
"a word twice". A document is the mean of the vectors of all its features, and a
softmax over two classes scores it. numpy stochastic gradient descent (AdaGrad
steps) learns vectors and output weights from a bounded number of labelled rows,
``ROWS``.

The mean and the output layer are linear, so for scoring each bucket's vector is
folded into the amount it adds to the log odds; scores are those of the model.

Null and empty texts have no feature and get the score of the output bias. All
of a text counts, in pieces of 65,536 letters cut at white space, which change
no feature; memory is bounded by a piece and the longest word. Repeated rows
score alike, and among training rows with one id the smaller label counts. A
score of exactly the threshold predicts 1. Without labels of both classes every
score is the share of label 1 among the rows (0.5 without any). An empty table
gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.llm.labelled import held_out, training_rows

BUCKETS, DIM, ROWS, EPOCHS, RATE, THRESHOLD = 1 << 16, 16, 3000, 12, 0.15, 0.3
GRAMS, REPEATED = (2, 3, 4), 12
_PIECE = 1 << 16


def features(text: str) -> np.ndarray:
    """The bucket of every word and n-gram occurrence, and of every repeat."""
    out, at, last = [], 0, None
    while at < len(text):
        end = min(len(text), at + _PIECE)
        while end < len(text) and not _is_blank(text[end]):
            end += 1
        hashes, last = _features(text[at:end], last)
        out.append((common.mixed(hashes) >> common.U(48)).astype(np.uint16))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint16)


def _is_blank(letter: str) -> bool:
    return letter <= " " or letter == "\xa0"


def _features(text: str, before: int | None) -> tuple[np.ndarray, int | None]:
    """Hashes of a piece, and its last word; before: the last word of the piece before."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    blank = (letters <= 32) | (letters == 0xA0)
    letters = np.concatenate(([32], np.where(blank, 32, letters), [32])).astype(np.uint64)
    blank = letters == 32
    inside = ~blank
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    words = common.Rolling(letters).slices(edges[::2], edges[1::2])
    again = np.count_nonzero(words[1:] == words[:-1]) + (before is not None and len(words) > 0 and int(words[0]) == before)
    # n-grams hold at most a boundary mark at either end
    found = [words, np.full(REPEATED * again, 0xA9A1, dtype=np.uint64)]
    for n in GRAMS:
        if len(letters) < n:
            continue
        h = np.full(len(letters) - n + 1, n, dtype=np.uint64)
        ok = ~(blank[: len(h)] & blank[1 : 1 + len(h)])
        for k in range(n):
            h = h * common.U(0x100000001B3) + letters[k : k + len(h)]
            if 0 < k < n - 1:
                ok &= ~blank[k : k + len(h)]
        found.append(h[ok])
    return np.concatenate(found), int(words[-1]) if len(words) else before


class Model:
    """Amounts per bucket and bias."""

    def __init__(self, amounts: np.ndarray, bias: float):
        self.amounts, self.bias = amounts.astype(np.float32), float(bias)

    def score(self, text: str | None) -> float:
        f = features(text or "")
        z = self.bias + (float(self.amounts[f].mean(dtype=np.float64)) if len(f) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def sgd(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM, seed: int = 3) -> Model:
    """documents: distinct buckets and their shares."""
    share = float(labels.mean()) if len(labels) else 0.5
    if len(labels) == 0 or share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS), np.log((share + 1e-3) / (1 - share + 1e-3)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out = rng.uniform(-1, 1, (2, dim)).astype(np.float32)
    bias = np.log(np.array([1 - share, share], dtype=np.float32))
    seen_v, seen_o = np.full(BUCKETS, 1e-8, dtype=np.float32), np.full(2, 1e-8, dtype=np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(documents)):
            ids, weight = documents[i]
            if not len(ids):
                continue
            rows = vectors[ids]
            hidden = weight @ rows
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            to_hidden = p @ out
            # one AdaGrad sum a vector, so rare buckets move as far as common ones
            g = weight * weight * (to_hidden @ to_hidden)
            seen_v[ids] += g
            vectors[ids] = rows - (step * weight / np.sqrt(seen_v[ids]))[:, None] * to_hidden
            seen_o += p * p * (hidden @ hidden)
            out -= (step * p / np.sqrt(seen_o))[:, None] * hidden
            bias -= 0.1 * step * p
    return Model(vectors @ (out[1] - out[0]), bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Features are made on the executors; at most ``rows`` documents' distinct buckets reach the driver."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, shares = [], []
        for t in b.column("text"):
            f, n = np.unique(features(t.as_py()), return_counts=True)
            ids.append(f.tobytes())
            shares.append((n / max(1, n.sum())).astype(np.float32).tobytes())
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], ["id", "label", "ids", "shares"])

    made = common.map_rows(training_rows(docs, labels, label, rows, id_col, text_col), run, "id long, label int, ids binary, shares binary").toArrow().sort_by([("id", "ascending"), ("ids", "ascending")])
    documents = [(np.frombuffer(a.as_py(), dtype=np.uint16), np.frombuffer(b.as_py(), dtype=np.float32)) for a, b in zip(made.column("ids"), made.column("shares"), strict=True)]
    return sgd(documents, made.column("label").to_numpy())


def scorer(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of the text column, as a column of docs."""
    common.lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return score(F.coalesce(docs[text_col].cast("string"), F.lit("")))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: ``doc_id``, held_out, score, predicted."""
    out = docs.select(docs[id_col].alias("doc_id"), scorer(docs, model, text_col).alias("score"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
