"""Filter interaction audit by the Walsh-Hadamard transform.

Which of five filters a document fails is a mask of five bits. Per part and label
the documents' masks are summed as 32 signed parity sums, one a subset of filters:
a document counts -1 where it fails an odd number of the subset, else 1. The
transform is its own inverse but for a factor of 32, so the sums give back the
number of documents of each mask exactly. All orders of the filters, 120, are then
evaluated from those cells alone, and a filter's Shapley value is closed: of the
orders, 120 / f let it be the one that removes a document with f failures.

Texts are judged in Arrow batches and never shuffled; the rest is SQL functions, one
join and one window. Identical texts meet by SHA-256, and rows of one digest are
counted per part and label before they move on, so a group of copies is a few rows,
whatever its size.

Filters: A under 200 words; B fewer different words than half of the words; C over
3 % of the characters are A-Z; D holds any of ``#$%&*|``; E a smaller doc_id has the
same text. Null texts count as empty (so A fails), a null part as the empty string.
A row without an id is no copy of another, nor another of it, and has no label.
Repeated rows count each; rows of one id are no copies of each other. A label
counts if any row of the id has it. Texts are read whole. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import common

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
_UPPER, _SIGNS, _SPACE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|", b" \t\n\v\f\r"
_CONTINUED, _PIECE = bytes(range(0x80, 0xC0)), 1 << 20


def own_failures(data: bytes) -> int:
    """The bits of A to D for a UTF-8 text."""
    n, different, at = 0, set(), 0
    while at < len(data):
        end = at + _PIECE
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        words = data[at:end].split()
        n, at = n + len(words), end
        different.update(words)
    without = lambda some: len(data) - len(data.translate(None, some))
    fails = (n < 200, 100 * len(different) < 50 * n, 100 * without(_UPPER) > 3 * (len(data) - without(_CONTINUED)), without(_SIGNS) > 0)
    return sum(f << k for k, f in enumerate(fails))


def judged(rows: DataFrame) -> DataFrame:
    """rows (id, part, body) with a digest and the bits of A to D in place of the text."""

    def judge(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("body").cast(pa.binary()).to_pylist()
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([own_failures(t) for t in texts], pa.int32())], ["id", "part", "digest", "mask"])

    return common.map_rows(rows, judge, "id long, part string, digest binary, mask int")


def masks(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Numbers of documents by part, label and mask of failures: part, good, bad, mask, n; a combination may have several rows."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    read = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("body"))
    rows = judged(read.where("id IS NOT NULL")).groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    lone = judged(read.where("id IS NULL")).groupBy("part", "mask").agg(F.count("*").alias("n"))
    flags = labels.select(labels[id_col].cast("long").alias("id"), (labels["quality"] == 1).alias("good"), (labels["toxic"] == 1).alias("bad")).where("id IS NOT NULL")
    flags = flags.groupBy("id").agg(F.bool_or("good").alias("good"), F.bool_or("bad").alias("bad"))
    known = rows.join(flags, "id", "left").na.fill(False, ["good", "bad"])
    # a digest's rows of one part and label: how many, and how many of them have the smallest id
    met = known.groupBy("digest", "part", "good", "bad", "mask").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    originals = F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0)
    halves = met.withColumn("originals", originals).select("part", "good", "bad", F.explode(F.array(F.struct("mask", F.col("originals").alias("n")), F.struct((F.col("mask") + CELLS // 2).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))).alias("x"))
    return halves.select("part", "good", "bad", "x.mask", "x.n").unionByName(lone.select("part", F.lit(False).alias("good"), F.lit(False).alias("bad"), "mask", "n"))


def _sign(a: Column, b: Column) -> Column:
    return 1 - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)


def transformed(rows: DataFrame) -> DataFrame:
    """Per part and label the 32 signed parity sums, one a subset of filters: part, good, bad, sums array<long>."""
    sums = [F.sum(F.col("n") * _sign(F.col("mask"), F.lit(s))) for s in range(CELLS)]
    return rows.groupBy("part", "good", "bad").agg(F.array(*sums).alias("sums"))


def inverted(sums: DataFrame) -> DataFrame:
    """The sums turned back into the number of documents of each mask, exactly: part, good, bad, cells array<long>."""
    subsets = F.sequence(F.lit(0), F.lit(CELLS - 1))
    cell = lambda m: F.aggregate(subsets, F.lit(0).cast("long"), lambda acc, s: acc + _sign(m, s) * F.get("sums", s))
    return sums.select("part", "good", "bad", F.transform(subsets, lambda m: F.shiftright(cell(m), len(FILTERS))).alias("cells"))


def evaluated(cells: DataFrame) -> DataFrame:
    """Every order and step of every part, from its cells alone."""

    def summed(name: str, which: Column | None = None) -> Column:
        each = [F.get("cells", F.lit(m)) for m in range(CELLS)]
        return F.array(*[F.sum(c if which is None else F.when(which, c).otherwise(0)) for c in each]).alias(name)

    parts = cells.groupBy("part").agg(summed("every"), summed("good", F.col("good")), summed("toxic", F.col("bad")))
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    bits = F.array(*[F.pow(F.lit(2), F.ascii(F.substring("filter_order", k + 1, 1)) - ord(FILTERS[0])).cast("int") for k in range(len(FILTERS))])
    steps = parts.select("*", F.explode(orders).alias("filter_order")).withColumn("bits", bits).select("*", F.posexplode("bits").alias("at", "own"))
    before = F.aggregate(F.slice("bits", 1, F.col("at")), F.lit(0), lambda acc, b: acc + b)
    steps = steps.withColumn("before", before)
    cells_of = F.sequence(F.lit(0), F.lit(CELLS - 1))
    fails, earlier = (lambda m: m.bitwiseAND(F.col("own")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)

    def count(column: str, test, times=lambda m: F.lit(1)) -> Column:
        return F.aggregate(cells_of, F.lit(0).cast("long"), lambda acc, m: acc + F.when(test(m), F.get(column, m) * times(m)).otherwise(0))

    removed = lambda m: fails(m) & ~earlier(m)
    return steps.select(
        "part",
        "filter_order",
        (F.col("at") + 1).cast("int").alias("step"),
        count("every", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        count("every", removed).alias("removed"),
        count("every", lambda m: fails(m) & earlier(m)).alias("redundant"),
        count("every", lambda m: m == F.col("own")).alias("unique_fails"),
        count("good", removed).alias("good_lost"),
        count("toxic", removed).alias("toxic_lost"),
        count("every", fails, lambda m: F.floor(120 / F.greatest(F.bit_count(m), F.lit(1)))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return evaluated(inverted(transformed(masks(docs, labels, part_col, id_col, text_col))))


#: Straight from the definitions: every order is applied to every mask, and the Shapley value sums over the orders.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
  (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > least)::INT AS mask FROM w LEFT JOIN g USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(bad) AS bad FROM f GROUP BY part, mask),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own, list_sum([0] || list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own,
  coalesce(sum(n) FILTER (mask & own::INT = 0 AND mask & earlier::INT = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & own::INT <> 0 AND mask & earlier::INT = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & own::INT <> 0 AND mask & earlier::INT <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own::INT), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & own::INT <> 0 AND mask & earlier::INT = 0), 0) AS good_lost, coalesce(sum(bad) FILTER (mask & own::INT <> 0 AND mask & earlier::INT = 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
