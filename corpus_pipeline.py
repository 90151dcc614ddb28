"""From raw documents to packed training sequences, in five stages.

Each stage works on what its predecessor kept: toxic documents go, low-quality
documents go, one document of each near-duplicate group stays, repeated passages
are cut out of the texts that stay, and the rest is packed. All but the last
return the columns of documents, whatever their names. A score of exactly its
threshold rejects a toxic document and keeps one of low quality. Null texts count
as empty, null ids as larger than any other; repeated rows are judged alike and
one of them stays, since they are copies. Long texts are read whole at every stage.
Empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common, packing, quality, simhash, substrings, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    grammar = toxicity.fit(docs, _labels(spark, sf_dir))
    return docs.where(toxicity.scorer(docs, grammar) < toxicity.THRESHOLD)


def without_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, _labels(spark, sf_dir))
    return docs.where(quality.scorer(docs, model) >= quality.THRESHOLD)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, simhash.near_duplicate_groups(docs))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substrings.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("quality", without_low_quality),
    ("simhash", without_near_copies),
    ("substrings", without_repeated_passages),
    ("packing", packed),
]

#: Learned models, XXH64 and tokenizers can't be put in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each one's result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
