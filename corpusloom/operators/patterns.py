"""Which of many strings stand in which texts: one pass a text, whatever the number of strings.

The strings are put into an Aho-Corasick automaton, once, on the driver, and
broadcast; a text is then read once and gives every string that ends anywhere in
it, those inside others too. Strings are taken in blocks of at most ``BLOCK``
characters (a longer one alone), so neither the driver nor a worker holds more than
a block; each block reads the texts once, and nothing is shuffled.

Equal strings each give their pairs, and so do repeated texts. Null texts hold
nothing, the empty string stands in every other text, null strings in none. Texts
are read whole. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK = 1 << 21
#: An automaton of a block takes some 40 bytes a character at most; more is refused rather than broadcast.
MOST = 64 * BLOCK


def _blocks(strings: DataFrame, most: int) -> Iterator[list[tuple[object, str]]]:
    held, size = [], 0
    for key, text in strings.toLocalIterator():
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append((key, text))
        size += len(text)
    if held:
        yield held


def automaton(strings: list[tuple[object, str]], most: int = MOST) -> bytes:
    """The pickled automaton of (key, string) pairs, each string with all its keys."""
    import ahocorasick

    keys: dict[str, list] = {}
    for key, text in strings:
        keys.setdefault(text, []).append(key)
    made = ahocorasick.Automaton()
    for text, own in keys.items():
        if text:
            made.add_word(text, own)
    made.make_automaton()
    out = pickle.dumps((made if len(made) else None, keys.get("", [])))
    if len(out) > max(most, 64 * max(len(t) for _, t in strings)):
        raise ValueError(f"an automaton of {len(out)} bytes is too large to broadcast")
    return out


def occurrences(texts: DataFrame, strings: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str = "item_id", string_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Pairs (id_col, key_col): the texts and the strings that stand in them."""
    spark = texts.sparkSession
    kinds = texts.schema[id_col].dataType, strings.schema[key_col].dataType
    schema = f"{id_col} {kinds[0].simpleString()}, {key_col} {kinds[1].simpleString()}"
    arrow = to_arrow_type(kinds[1])
    rows = texts.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).where("__text IS NOT NULL")

    def found(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made, everywhere = pickle.loads(sent.value)
            for b in batches:
                at, keys = [], []
                for row, text in enumerate(b.column(1).to_pylist()):
                    met = {id(own): own for _, own in made.iter(text)} if made is not None else {}
                    own = [*everywhere, *(k for o in met.values() for k in o)]
                    at += [row] * len(own)
                    keys += own
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(keys, arrow)], [id_col, key_col])

        return rows.mapInArrow(run, schema)

    wanted = strings.select(F.col(key_col), F.col(string_col).cast("string")).where(F.col(string_col).isNotNull())
    passes = [found(spark.sparkContext.broadcast(automaton(some))) for some in _blocks(wanted, block)]
    return reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], schema)
