"""What the training-data operators share: scratch space, Arrow helpers, hashing."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, in local mode only, one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if sc_dir.isDefined():
            return sc_dir.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that written() made and nothing reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> tuple[DataFrame, int]:
    """df and its number of rows, computed now and stored on the executors' disks for several uses, which so never compute it side by side; a lost executor's part is computed anew from its lineage."""
    stored = df.persist(StorageLevel.DISK_ONLY)
    return stored, stored.count()


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


#: A key is hot if more than one in HOT of a table's rows have it (and HOT_ROWS at least), so there are fewer than HOT hot keys at any size.
HOT, HOT_ROWS = 4096, 256


def hot_bound(total: int) -> int:
    return max(HOT_ROWS, total // HOT)


def hot_keys(counted: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame | None:
    """The hot keys of a table of keys and their numbers of ``rows``, ``total`` in all, as a local table of fewer than HOT rows; None if there are none."""
    found = counted.where(F.col(rows) > hot_bound(total)).select(*keys).collect()
    return counted.sparkSession.createDataFrame(found, counted.select(*keys).schema) if found else None


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """Inner join with a right side of one row a key: rows of hot keys stay where they are and meet a broadcast of fewer than HOT rows, the others are shuffled. left should be stored, since it is read twice."""
    if hot is None:
        return left.join(right, keys)
    few = right.join(F.broadcast(hot), keys, "left_semi")
    return left.join(F.broadcast(hot), keys, "left_anti").join(right, keys).union(left.join(F.broadcast(few), keys))


#: Bits of a bitmap that goes to Python: 8 MiB at any size of the input; overfull, it only lets more rows through.
MAP_BITS = 26
#: The same for one that stays on the JVM, a broadcast of at most 2 ** (SLOT_BITS - 6) rows of two longs.
SLOT_BITS = 24


def slots(*columns: np.ndarray) -> np.ndarray:
    """Slots of the bitmap for rows of 64-bit columns."""
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        h = mixed(h ^ np.ascontiguousarray(c).view(np.uint64))
    return (h >> U(64 - MAP_BITS)).astype(np.int64)


def _words(tags: DataFrame) -> DataFrame:
    return tags.select(F.shiftright("tag", 6).alias("word"), F.expr("shiftleft(1L, tag & 63)").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def bitmap(tags: DataFrame) -> Broadcast:
    """A broadcast bitmap of the slots in column ``tag``; at most 2 ** (MAP_BITS - 6) rows of 16 bytes reach the driver."""
    got = _words(tags).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return tags.sparkSession.sparkContext.broadcast(out)


def slot(*columns: Column) -> Column:
    """A slot of a bitmap on the JVM."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << SLOT_BITS)).cast("int")


def marked(rows: DataFrame, tags: DataFrame, tag: str, name: str) -> DataFrame:
    """rows with a boolean column: whether their slot in column ``tag`` is among the ``tag`` of tags. True for all that are, and for few others."""
    bits = F.broadcast(_words(tags.select(F.col(tag).alias("tag"))).withColumnsRenamed({"word": "__word", "bits": "__bits"}))
    found = rows.join(bits, F.shiftright(tag, 6) == F.col("__word"), "left")
    return found.withColumn(name, F.coalesce(F.expr(f"shiftright(__bits, {tag} & 63) & 1") == 1, F.lit(False))).drop("__word", "__bits")


#: Spark's defaults and what is set in their place: rows and bytes in an Arrow batch. Whole texts are long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1024"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def lean(spark: SparkSession) -> None:
    """Whole texts go to Python in small batches, so that neither the JVM nor a worker holds ten thousand of them. What the session has set otherwise stays."""
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, ours)


def map_rows(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for a function from batch to batch."""

    lean(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):  # whole texts: keep the working set small
                if (out := function(batch.slice(start, 512))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed to c0, c1 and so on, so that none can clash with an operator's own, and the new name of each; ``toDF`` takes the old ones back."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def text_of(docs: DataFrame, *columns, text_col: str = "text") -> DataFrame:
    """Only the wanted columns and the text, so that the scan reads nothing else and no extra column can clash."""
    return docs.select(*columns, F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of their key: the same for any partitioning."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(rows)


U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE += (5 - _BASE) % 8  # 5 modulo 8: an odd base of the largest order
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64; kept for the lengths met so far."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        out = np.ones(size, dtype=np.uint64)
        step, filled = base, 1
        while filled < size:
            np.multiply(out[:filled], U(step), out=out[filled : 2 * filled])
            step, filled = step * step % (1 << 64), 2 * filled
        if size > 1 << 18:
            return out
        _powers[base] = have = out
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Rolling:
    """Polynomial hashes of any slice of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(_BASE, max(n, 1))[:n], out=self.sums[1:])
        self.inverse = powers(_INVERSE, n + 1)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_PIECE, _LONG_WORD = 1 << 16, 256


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, in order; words never straddle the pieces it works in."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        raw = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        inside = np.concatenate(([False], ~_SPACE[raw], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[::2], edges[1::2]
        hashes = Rolling(raw.astype(np.uint64) + U(1)).slices(first, last)
        for k in np.flatnonzero(last - first > _LONG_WORD).tolist():  # a polynomial modulo 2 ** 64 can be made to collide over a thousand bytes
            hashes[k] = xxhash.xxh64_intdigest(raw[first[k] : last[k]].tobytes(), 9)
        out.append(hashes)
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
