"""Exact ranks over a whole table, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .screen import cut, input_bytes


def range_parts(df: DataFrame, each: int, most: int = 1 << 16) -> int:
    """How many ranges of about ``each`` input bytes to deal df out to: the number of
    shuffle partitions at least, and just that where the size is not known."""
    size, least = input_bytes(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 50 else max(least, min(most, size // each))


def ranked(df: DataFrame, order: list[Column], groups: list[str] | None = None, name: str = "rank", each: int = 8 << 20) -> DataFrame:
    """df with its rows' places, from 1, in the given order, as column ``name``;
    with groups, within each group (order then begins with these columns, ascending).

    Rows are dealt out by range, so a large group or a common value spreads over many
    tasks if order tells its rows apart. Each range is sorted and its rows are numbered;
    only a row for each range and group meets in one place, for the places before it.
    """
    groups = groups or []
    n = range_parts(df, each)
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = dealt.groupBy(F.col("__part").alias("__p"), *(F.col(g).alias(f"__{g}") for g in groups)).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*(f"__{g}" for g in groups)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1)
    same = F.col("__part") == F.col("__p")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    return dealt.join(sizes, same).select(*df.columns, (F.col("__row") + F.col("__before")).alias(name))
