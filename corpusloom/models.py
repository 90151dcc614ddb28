"""Model calls as columns: any function over batches of texts, run once per distinct prompt.

Adapters take a list of texts and return vectors or completions; they are made
once per partition. ``hashed_embedder`` and ``fixed_chat`` are deterministic
stand-ins for tests. Answers are cached in Parquet under a key of prompt, scope
and policy; only complete answers without personal data are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import redaction
from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.shared import require

Embedder = Callable[[list[str]], list[list[float]]]
Chat = Callable[[list[tuple[str, str]]], list[dict]]


def hashed_embedder(dimension: int) -> Callable[[], Embedder]:
    """Unit vectors of signed word hashes: equal texts, equal vectors; shared words, nearer vectors."""

    def make() -> Embedder:
        def embed(texts: list[str]) -> list[list[float]]:
            out = []
            for t in texts:
                v = np.zeros(dimension)
                for w in t.lower().split() or [""]:
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                    v[h % dimension] += 1 if h >> 63 else -1
                if not v.any():
                    v[0] = 1
                out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
            return out

        return embed

    return make


def fixed_chat(reply: Callable[[str, str], str]) -> Callable[[], Chat]:
    """A chat that answers by a function of both messages and always ends properly."""
    return lambda: lambda prompts: [{"text": reply(s, u), "finish_reason": "stop", "complete": True, "model": "fixed", "input_tokens": None, "output_tokens": None} for s, u in prompts]


#: How each backend says that an answer is whole.
COMPLETE = {"azure": "stop", "ollama": "stop", "bedrock": "end_turn"}


def complete(backend: Column, finish_reason: Column, refusal: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in COMPLETE.items() for x in pair])
    return F.coalesce((F.element_at(table, backend) == finish_reason) & (refusal.isNull() | (backend != "azure")), F.lit(False))


def query_prompt(backend: Column, text: Column, prefix: str = "search_query: ") -> Column:
    """What a question is embedded as; only one backend marks queries."""
    return F.when(backend == "ollama", F.concat(F.lit(prefix), text)).otherwise(text)


def embedded(prompts: DataFrame, make: Callable[[], Embedder], dimension: int, key: str = "content_hash", text_col: str = "prompt", batch: int = 16, policy: Callable[[Column], Column] = redaction.document_policy) -> DataFrame:
    """key, embedding of each distinct key. A vector of the wrong length, not finite or zero fails the job.

    Texts pass a redaction policy on their way to the model, whatever the caller has done: an adapter never sees what a
    pattern finds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = make()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                got = embed(part.column(text_col).to_pylist())
                if len(got) != part.num_rows:
                    raise ValueError("one vector a text is expected")
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(got, pa.list_(pa.float32()))], [key, "embedding"])

    made = prompts.select(key, text_col).dropDuplicates([key]).withColumn(text_col, policy(F.col(text_col))["text"]).mapInArrow(run, f"{key} string, embedding array<float>")
    return require(made, V.valid(F.col("embedding"), dimension), F.lit("invalid embedding"))


REPLY = "text string, finish_reason string, complete boolean, model string, input_tokens long, output_tokens long"


def chatted(prompts: DataFrame, make: Callable[[], Chat], key: str = "prompt_key") -> DataFrame:
    """key and the reply columns of each distinct prompt (key, system, user)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = make()
        for b in batches:
            replies = pd.DataFrame(chat(list(zip(b["system"], b["user"], strict=True))), columns=[c.split()[0] for c in REPLY.split(", ")])
            replies.insert(0, key, b[key].to_numpy())
            yield replies

    return prompts.select(key, "system", "user").dropDuplicates([key]).mapInPandas(run, f"{key} string, {REPLY}")


def prompt_key(scope: Column, system: Column, user: Column) -> Column:
    return T.fingerprint(scope=scope, system=system, user=user)


def cache_safe(text: Column) -> Column:
    """No personal data in the text, as it stands and, if it is JSON, in its decoded strings; both are normalised."""
    return redaction.json_clean(text)


def usable(cache: DataFrame) -> DataFrame:
    """Cached replies that may be used: complete and safe. What is left out is computed anew and replaced."""
    return cache.where(F.coalesce("complete", F.lit(False)) & cache_safe(F.col("text")))


def cached_chat(prompts: DataFrame, cache: DataFrame, make: Callable[[], Chat], key: str = "prompt_key") -> tuple[DataFrame, DataFrame]:
    """Replies for every prompt row, and those of them to append to the cache. Only distinct misses are sent.

    The new replies are written to the shared folder once, so neither result calls the model again.
    """
    from corpusloom.shared import written

    good = usable(cache).dropDuplicates([key]).select(key, *[c.split()[0] for c in REPLY.split(", ")])
    wanted = prompts.select(key, "system", "user").dropDuplicates([key])
    fresh = written(chatted(wanted.join(good, key, "left_anti"), make, key), "replies")
    everything = good.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False)))
    return prompts.join(everything, key, "left"), usable(fresh)


def in_order(responses: Column) -> Column:
    """Vectors of a reply (array<struct<index, embedding>>) in the order of their indexes, which must be exactly 0..n-1; else null."""
    sorted_ = F.array_sort(responses, lambda a, b: a["index"] - b["index"])
    n = F.size(responses)
    whole = (n > 0) & (F.transform(sorted_, lambda r: r["index"].cast("int")) == F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
    return F.when(whole, F.transform(sorted_, lambda r: r["embedding"]))
