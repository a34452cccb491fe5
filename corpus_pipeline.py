"""Corpus pipeline: five stages over documents, each written and read again.

language: language ID; documents that the models reject go.
near_duplicates: n-gram Jaccard join (five words, 0.8); one of each group stays.
repeats: repeated passages of 200 bytes (some fifty short words) are cut out of what is left.
benchmark: documents that hold a benchmark passage go.
mixture: documents are sampled to tempered source, language and topic weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from saltfinger.llm import decontaminate, jaccard_join, language_id, mixing, suffix_dedup
from saltfinger.llm.screen import new_folder


def _sized(spark: SparkSession) -> None:
    """Python gets at most 2000 whole texts, and batches of some 16 MB, at once, also
    where a stage's rows are written after its function has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 2000:
        spark.conf.set(name, "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _sized(spark)
    return language_id.known(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _sized(spark)
    return jaccard_join.keep_one(docs, n=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _sized(spark)
    return suffix_dedup.drop_repeats(docs, suffix_dedup.PASSAGE)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _sized(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _sized(spark)
    return mixing.sample(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("benchmark", benchmark), ("mixture", mixture)]

#: No stage but the last fits SQL; each is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. Each stage's rows are written as Parquet
    to the shared folder and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{i}-{name}")
        docs = spark.read.parquet(f"{path}/{i}-{name}")
    return docs
