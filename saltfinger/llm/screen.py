"""Bounded membership screens and other plumbing that several operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A screen never has more 64-bit words than this (16 MB). Beyond it, more keys
#: pass that are not members, which costs time only: members always pass.
MAX_WORDS = 1 << 21


class Screen:
    """Which 64-bit keys may be in a set: no member is missed, a few others pass.

    The broadcast size is bounded by ``MAX_WORDS`` whatever the set's size. Each
    key sets three bits of one 64-bit word; the words are OR-ed by Spark.
    """

    def __init__(self, spark: SparkSession, words: np.ndarray):
        self.n = len(words)
        self.words = spark.sparkContext.broadcast(words)

    @classmethod
    def of(cls, keys: DataFrame, column: str, words_per_key: float = 0.25) -> Screen:
        spark = keys.sparkSession
        keys = keys.select(F.col(column).alias("k")).where("k IS NOT NULL")
        size = 1024
        count = keys.count()
        while size < MAX_WORDS and size < count * words_per_key:
            size *= 2
        bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(k, {by}) & 63 AS int))" for by in (58, 52, 46))
        rows = (
            keys.select((F.col("k").bitwiseAND(size - 1)).cast("int").alias("w"), F.expr(bits).alias("m"))
            .groupBy("w").agg(F.expr("bit_or(m)").alias("m")).toArrow()
        )
        words = np.zeros(size, np.int64)
        words[rows["w"].to_numpy()] = rows["m"].to_numpy()
        return cls(spark, words)

    def __getstate__(self):
        return {"n": self.n, "words": self.words}

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """Boolean for each key, a signed or unsigned 64-bit array."""
        k = np.ascontiguousarray(keys).view(np.uint64)
        one, low = np.uint64(1), np.uint64(63)
        mask = (one << ((k >> np.uint64(58)) & low)) | (one << ((k >> np.uint64(52)) & low)) | (one << ((k >> np.uint64(46)) & low))
        word = self.words.value.view(np.uint64)[(k & np.uint64(self.n - 1)).astype(np.int64)]
        return (word & mask) == mask


def row_key() -> Column:
    """Key of a document row: its doc_id and text. Rows of one key are copies."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def split(docs: DataFrame, key: Column, screen: Screen) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in the screen, rows whose key is not); the first
    with the key as column __k. Neither is shuffled."""
    keyed = docs.withColumn("__k", key)

    def part(want: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                ok = screen.may_hold(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
                yield batch.filter(pa.array(ok if want else ~ok))

        return keyed.mapInArrow(run, keyed.schema)

    return part(True), part(False).drop("__k")


def without(docs: DataFrame, key: Column, bad: DataFrame) -> DataFrame:
    """docs less the rows whose 64-bit key is in bad(__k). Only rows that the
    screen lets through are shuffled."""
    maybe, clean = split(docs, key, Screen.of(bad, "__k"))
    return maybe.join(bad.select("__k").distinct(), "__k", "left_anti").drop("__k").unionAll(clean)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only
    where it is unset, as in local tests, a temporary folder takes its place."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), f"saltfinger-{os.getuid()}")
    return at.rstrip("/")


#: Spark's setting by which a query's shuffle files go when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that Python gets at once in such a query: whole texts are some thousand bytes each.
_BATCH, _BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there. The shuffle
    files that df was made from are of no more use and go at once, so that rounds of
    a job do not fill the executors' disks."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    before = {name: spark.conf.get(name) for name in (_CLEANUP, _BATCH)}
    spark.conf.set(_CLEANUP, "true")
    spark.conf.set(_BATCH, str(min(int(before[_BATCH]), _BATCH_ROWS) if int(before[_BATCH]) > 0 else _BATCH_ROWS))
    try:
        return df.select("*").checkpoint()  # Spark reads the first setting when a DataFrame is made
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes behind df (file sizes for a scan)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(size, 1 << 50)


def parts(df: DataFrame, each: int, least: int = 16, most: int = 1 << 16) -> int:
    """How many pieces of about ``each`` input bytes df makes."""
    return max(least, min(most, -(-input_bytes(df) // each)))
