"""Windows, segments and profile indices over sample tables.

A sample table has key columns (file, profile), a dense index ``i`` from 0 in each
key, a time ``t`` in seconds and value columns. Missing values are null: NaN is
made null before any aggregate, since Spark orders NaN above everything.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def real(x: Column | str) -> Column:
    """x with NaN as null."""
    c = F.col(x) if isinstance(x, str) else x
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def _size(n: int | str) -> Column:
    """A number of samples: known now, or a column of the key's rows."""
    return F.col(n) if isinstance(n, str) else F.lit(n)


def block_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str], n: int | str, index: str = "i", out: str = "b") -> DataFrame:
    """Means of blocks of n samples; a last block that is not full has no row."""
    b = F.floor(F.col(index) / _size(n)).alias(out)
    rows = df.groupBy(*keys, b).agg(F.count("*").alias("__n"), F.first(_size(n)).alias("__all"), *(F.avg(real(v)).alias(v) for v in values))
    return rows.where("__n = __all").drop("__n", "__all")


def window_of(index: Column, n_fft: Column, n_diss: Column) -> Column:
    """The windows of n_diss samples, n_diss - n_fft / 2 apart, that hold index."""
    step = n_diss - F.floor(n_fft / 2)
    first = F.greatest(F.lit(0), F.ceil((index - n_diss + 1) / step))
    return F.sequence(first.cast("long"), F.floor(index / step).cast("long"))


def window_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str], n_fft: int | str, n_diss: int | str, index: str = "i", out: str = "win") -> DataFrame:
    """Means of the complete overlapping windows. Each sample goes to the one or
    two windows that hold it; partial sums are made before the shuffle."""
    spread = df.select(*keys, *(real(v).alias(v) for v in values), _size(n_diss).alias("__all"), F.explode(window_of(F.col(index), _size(n_fft), _size(n_diss))).alias(out))
    rows = spread.groupBy(*keys, out).agg(F.count("*").alias("__n"), F.first("__all").alias("__all"), *(F.avg(v).alias(v) for v in values))
    return rows.where("__n = __all").drop("__n", "__all")


def kept_samples(n, n_diss, n_fft, ratio=1):
    """Samples that complete windows take of n, aligned to ratio; null or None if
    none fits. Columns or numbers."""
    columns = any(isinstance(x, Column) for x in (n, n_diss, n_fft, ratio))
    down = F.floor if columns else math.floor
    step = n_diss - down(n_fft / 2)
    windows = lambda m: down((m - n_diss) / step) + 1
    if not columns and n < n_diss:
        return None
    aligned = down((n_diss + (windows(n) - 1) * step) / ratio) * ratio
    kept = n_diss + (windows(aligned) - 1) * step
    return F.when(n >= n_diss, kept) if columns else kept if aligned >= n_diss else None


def trim_windows(df: DataFrame, keys: Sequence[str], n_diss: int | str, n_fft: int | str, chop_start: bool = True, ratio: int = 1, index: str = "i", keep: Column | None = None) -> DataFrame:
    """The samples of complete windows, from the end if chop_start, re-indexed.
    Keys with less than one window have no rows. ``keep`` gives the number of
    samples where another table's windows decide."""
    own = Window.partitionBy(*keys)
    sized = df.withColumn("__n", F.count("*").over(own)).withColumn("__keep", kept_samples(F.col("__n"), _size(n_diss), _size(n_fft), ratio) if keep is None else keep)
    start = F.col("__n") - F.col("__keep") if chop_start else F.lit(0)
    kept = sized.where((F.col(index) >= start) & (F.col(index) < start + F.col("__keep")))
    return kept.withColumn(index, (F.col(index) - start).cast("long")).drop("__n", "__keep")


def with_window_sizes(files: DataFrame, fft_len: float, diss_len: float) -> DataFrame:
    """files with n_fft, n_diss and ratio by their rates fs_fast and fs_slow, and
    both sizes in slow samples (half to even, as Python rounds)."""
    size = lambda seconds: F.bround(F.col("fs_fast") * seconds, 0).cast("int")
    own = files.withColumns({"n_fft": size(fft_len), "n_diss": size(diss_len), "ratio": (F.col("fs_fast") / F.col("fs_slow")).cast("int")})
    return own.withColumns({f"{n}_slow": F.floor(F.col(n) / F.col("ratio")).cast("int") for n in ("n_fft", "n_diss")})


def gap_segments(df: DataFrame, keys: Sequence[str], gap: float = 5.0, factor: float = 10.0, time: str = "t", index: str = "i") -> DataFrame:
    """df with ``segment``: a new one after each step over max(gap, factor * the
    key's median step)."""
    order = Window.partitionBy(*keys).orderBy(index)
    stepped = df.withColumn("__dt", F.col(time) - F.lag(time).over(order))
    limit = F.greatest(F.lit(gap), factor * F.median("__dt").over(Window.partitionBy(*keys)))
    marked = stepped.withColumn("__new", F.coalesce((F.col("__dt") > limit).cast("int"), F.lit(0)))
    return marked.withColumn("segment", F.sum("__new").over(order).cast("long")).drop("__dt", "__new")


def segment_shape(df: DataFrame, keys: Sequence[str], pressure: str, index: str = "i", time: str = "t") -> DataFrame:
    """For each (keys, segment): bounds, greatest pressure, rising and falling
    steps, dominant fraction, pressures at and direction by the ends."""
    by = [*keys, "segment"]
    step = F.col(pressure) - F.lag(pressure).over(Window.partitionBy(*by).orderBy(index))
    rows = df.withColumn("__d", step).groupBy(*by).agg(
        F.min(index).alias("start_idx"), F.max(index).alias("end_idx"), F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.max(real(pressure)).alias("max_pressure"),
        F.count_if(F.col("__d") > 0).alias("n_pos"), F.count_if(F.col("__d") < 0).alias("n_neg"), F.min_by(pressure, index).alias("first_pressure"), F.max_by(pressure, index).alias("last_pressure"),
        F.count("*").alias("n_samples"), F.count(real(pressure)).alias("n_valid"),
    )
    moved = F.col("n_pos") + F.col("n_neg")
    fraction = F.when(moved > 0, F.greatest("n_pos", "n_neg") / moved).otherwise(F.lit(1.0))
    return rows.withColumn("fraction", fraction).withColumn("direction", F.when(F.col("last_pressure") >= F.col("first_pressure"), "down").otherwise("up"))


def monotonic_profiles(shape: DataFrame, direction: str = "down", min_pressure: float = 1.0, least: float = 0.8) -> DataFrame:
    """The segments that are one profile as a whole: long and deep enough, moving
    one way in ``least`` of their steps, in the asked direction."""
    down = F.col("n_pos") >= F.col("n_neg")
    way = {"down": down, "up": ~down, "both": F.lit(True)}[direction]
    return shape.where((F.col("end_idx") > F.col("start_idx")) & (F.col("max_pressure") >= min_pressure) & (F.col("fraction") >= least) & way)


def number_profiles(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """segments with profile_index, from 0 in the order of their start."""
    order = Window.partitionBy(*keys).orderBy("start_idx", "end_idx")
    return segments.withColumn("profile_index", F.row_number().over(order) - 1)


def samples_of(samples: DataFrame, profiles: DataFrame, keys: Sequence[str], time: str = "t", bucket: float = 3600.0) -> DataFrame:
    """Samples with the profile_index of the profiles whose times hold theirs, both
    ends included. The range join is an equi-join on buckets of time: a profile
    goes to the buckets it spans, a sample to its own."""
    spans = F.sequence(F.floor(F.col("start_time") / bucket), F.floor(F.col("end_time") / bucket))
    right = profiles.select(*keys, "profile_index", "start_time", "end_time", F.explode(spans).alias("__b"))
    left = samples.withColumn("__b", F.floor(F.col(time) / bucket))
    return left.join(right, [*keys, "__b"]).where(F.col(time).between(F.col("start_time"), F.col("end_time"))).drop("__b", "start_time", "end_time")


def extract_profile(samples: DataFrame, profiles: DataFrame, keys: Sequence[str], profile_index: int, time: str = "t") -> DataFrame:
    """The samples of one profile; ValueError if the index is not there."""
    own = profiles.where(F.col("profile_index") == profile_index)
    if not own.head(1):
        raise ValueError(f"no profile {profile_index}")
    return samples_of(samples, own, keys, time)


def first_valid(value: str, index: str = "i") -> Column:
    """Aggregate: the first value that is not missing, null if all are."""
    return F.min_by(real(value), F.when(real(value).isNotNull(), F.col(index)))


def deepest_first(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """The k samples of greatest value of each key, ties by index."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value), "i")
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")
