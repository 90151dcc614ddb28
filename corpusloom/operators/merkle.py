"""Merkle trees over (id, hash) tables: a digest that no order or partitioning changes, and differences found by descent.

A row's line is the SHA-256 of its id's and its hash's digests and of how often the
row stands there, so repeated rows are one line. Lines are dealt into leaves by
their first hex digits, as many as give about ``LEAF`` lines a leaf at any size of
the table, since lines are spread evenly whatever the ids. A leaf's digest is that
of its sorted lines; a node's is that of its children, 16 at most, in order. Every
level is one aggregate over the level below it and is stored.

Two trees of one depth are compared from the root down: a level's nodes are joined
only below nodes that differ, so equal parts are never read, and only the rows of
differing leaves meet at last. Null ids and hashes are values of their own. An
empty table has a root over no lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.shared import written

LEAF = 1024


def depth_for(rows: int, leaf: int = LEAF) -> int:
    """Hex digits of a leaf's prefix, so that a leaf holds about ``leaf`` lines at most."""
    depth = 0
    while leaf * 16**depth < rows:
        depth += 1
    return depth


def _digest(column: Column) -> Column:
    return F.coalesce(F.sha2(column.cast("string"), 256), F.lit("null"))


def lines(table: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """id, hash and line of each different row."""
    rows = table.groupBy(table[id_col].alias("id"), table[hash_col].alias("hash")).agg(F.count("*").alias("n"))
    return rows.select("id", "hash", "n", F.sha2(F.concat_ws("\t", _digest(F.col("id")), _digest(F.col("hash")), F.col("n").cast("string")), 256).alias("line"))


@dataclass(frozen=True)
class Tree:
    """levels[k]: prefix (k hex digits), rows, digest."""

    levels: list[DataFrame]

    @property
    def depth(self) -> int:
        return len(self.levels) - 1

    def root(self) -> DataFrame:
        """One row: rows, digest."""
        digest = F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256))
        return self.levels[0].agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows"), digest.alias("digest"))


def tree(stored: DataFrame, depth: int) -> Tree:
    """The tree over lines."""
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256).alias("digest")
    levels = [written(stored.groupBy(F.substring("line", 1, depth).alias("prefix")).agg(F.sum("n").alias("rows"), joined("line")), "merkle")]
    for k in range(depth - 1, -1, -1):
        child = F.concat_ws(":", "prefix", "digest")
        levels.insert(0, written(levels[0].withColumn("child", child).groupBy(F.substring("prefix", 1, k).alias("prefix")).agg(F.sum("rows").alias("rows"), joined("child")), "merkle"))
    return Tree(levels)


def root(table: DataFrame, id_col: str = "chunk_id", hash_col: str = "content_hash", leaf: int = LEAF) -> DataFrame:
    """One row (rows, digest): equal for equal bags of (id, hash)."""
    stored = written(lines(table, id_col, hash_col), "lines")
    return tree(stored, depth_for(stored.count(), leaf)).root()


def differing_leaves(old: Tree, new: Tree) -> DataFrame:
    """The prefixes of leaves that aren't the same in both."""
    if old.depth != new.depth:
        raise ValueError("trees of different depths can't be compared")
    found = None
    for k, (a, b) in enumerate(zip(old.levels, new.levels, strict=True)):
        if found is not None:
            above = found.select(F.col("prefix").alias("above"))
            a, b = (x.join(above, F.substring("prefix", 1, k - 1) == F.col("above"), "left_semi") for x in (a, b))
        both = a.select("prefix", F.col("digest").alias("then")).join(b.select("prefix", F.col("digest").alias("now")), "prefix", "full_outer")
        found = written(both.where(~F.col("then").eqNullSafe(F.col("now"))).select("prefix"), "differing")
        if found.isEmpty():
            break
    return found if found.isEmpty() or k == old.depth else found.limit(0)


def changes(old: DataFrame, new: DataFrame, id_col: str = "chunk_id", hash_col: str = "content_hash", leaf: int = LEAF) -> DataFrame:
    """Ids whose rows differ: ``id`` and change, which is removed, added or changed.

    An id is changed if it has rows on both sides that the other lacks, and removed or added if only one side has such rows.
    """
    stored = [written(lines(t, id_col, hash_col), "lines") for t in (old, new)]
    depth = depth_for(max(s.count() for s in stored), leaf)
    leaves = differing_leaves(*(tree(s, depth) for s in stored))
    then, now = (s.join(leaves, F.substring("line", 1, depth) == F.col("prefix"), "left_semi").select("id", "line") for s in stored)
    both = then.select("line", F.col("id").alias("then"), F.lit(True).alias("was")).join(now.select("line", F.col("id").alias("now"), F.lit(True).alias("is")), "line", "full_outer").where("was IS NULL OR is IS NULL")
    sides = both.groupBy(F.when(F.col("was"), F.col("then")).otherwise(F.col("now")).alias("id")).agg(F.bool_or("was").alias("was"), F.bool_or("is").alias("is"))
    return sides.select("id", F.when(F.col("was") & F.col("is"), "changed").when(F.col("was"), "removed").otherwise("added").alias("change"))
