"""Tables in the folder that driver and executors share, and settings of the pipeline."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, in local mode only, an own folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, fixes row order, survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, into: dict, **figures: Column) -> DataFrame:
    """As ``written``; aggregates of df are observed while it is written and put into a dict, so no job counts anything again."""
    seen = Observation(name)
    out = written(df.observe(seen, *[c.alias(k) for k, c in figures.items()]), name)
    into.update(seen.get)
    return out


def require(df: DataFrame, condition: Column, message: Column) -> DataFrame:
    """df; a row for which the condition isn't true fails the job. A filter, so no plan leaves it out, whatever columns it reads."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


#: Spark's defaults and what is set in their place: rows and bytes in an Arrow batch.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "512"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def lean(spark: SparkSession | None = None) -> None:
    """Whole texts go to Python in small batches from now on: what a worker holds depends on a batch and its longest text, not on the table. What the session has set otherwise stays.

    Where rows are at hand, give their session: it need not be the active one.
    """
    spark = spark or SparkSession.active()
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key) == default:  # with a default of one's own, get() gives that for what isn't set
            spark.conf.set(key, ours)


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """df with each row's zero-based place in the given total order, without moving all rows to one task.

    Rows are range-partitioned and sorted once; a row's place is its place in
    its partition plus the sizes of the partitions before it, one row each.
    """
    local = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    sizes = sorted((r["__part"], r["count"]) for r in local.groupBy("__part").count().collect())
    offsets, before = [], 0
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__part int, __start long")
    return local.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def ordinals(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """df with each row's zero-based place among the rows of its key, without a task per key.

    Rows are range-partitioned and sorted by key and order once, so a key's rows are
    contiguous and a large key lies in several partitions. What a row lacks is its
    key's first place in its partition, one row a key and partition, and how many
    rows of the key lie in partitions before: that concerns the first and the last
    key of a partition only, so at most two rows a partition reach the driver.
    Rows of one key and order have places in no set order; null keys are a key.
    """
    local = written(df.withColumn("__key", F.struct(*keys)).repartitionByRange("__key", *order).sortWithinPartitions("__key", *order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ordinals")
    pieces = written(local.groupBy("__part", "__key").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"), F.max("__at").alias("__last")), "pieces")
    ends = local.groupBy("__part").agg(F.max("__at").alias("__end"))
    edge = pieces.join(F.broadcast(ends), "__part").where("__first = 0 OR __last = __end")
    before, offsets, key = 0, [], None
    for r in edge.select("__part", "__key", "__first", "__n").orderBy("__part", "__first").collect():
        before = before if r["__key"] == key else 0
        if before:
            offsets.append((r["__part"], r["__first"], before))
        key, before = r["__key"], before + r["__n"]
    earlier = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part int, __first long, __before long"))
    firsts = pieces.select("__part", "__key", "__first").join(earlier, ["__part", "__first"], "left")
    place = F.col("__at") - F.col("__first") + F.coalesce("__before", F.lit(0))
    return local.join(firsts, ["__part", "__key"]).withColumn(name, place).drop("__part", "__key", "__at", "__first", "__before")


@dataclass(frozen=True)
class Settings:
    """Tunable limits with their allowed ranges; an invalid combination is refused at once."""

    dimension: int = 64
    batch_size: int = 16
    max_batches: int = 40
    chunk_bytes: int = 1500
    overlap_bytes: int = 200
    top_k: int = 6
    min_similarity: float = 0.30
    query_max_bytes: int = 2000
    prompt_max_bytes: int = 1900

    def __post_init__(self) -> None:
        for field, low, high in (("dimension", 1, 2000), ("batch_size", 1, 128), ("max_batches", 1, 1000), ("chunk_bytes", 256, 4000), ("overlap_bytes", 0, self.chunk_bytes - 1), ("top_k", 1, 20), ("min_similarity", 0, 1), ("query_max_bytes", 1, 1 << 20), ("prompt_max_bytes", 1, 1 << 20)):
            if not low <= getattr(self, field) <= high:
                raise ValueError(f"{field} must lie in {low}..{high}")

    @property
    def variants(self) -> dict[str, int]:
        """How many neighbours each evaluation variant retrieves."""
        return {"baseline": self.top_k, "wider": min(20, self.top_k + 4), "focused": max(1, self.top_k // 2)}


def table_name(name: str) -> str:
    """A safe table name: at most 40 letters, digits and underscores."""
    if not 0 < len(name) <= 40 or not all(c.isascii() and (c.isalnum() or c == "_") for c in name):
        raise ValueError("table names are at most 40 letters, digits and underscores")
    return name
