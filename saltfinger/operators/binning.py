"""Depth binning of many profiles onto one grid."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.physics import depth
from .quality import combine_pair, mask_low_quality, restore_missing
from .windows import real

#: Variables that are binned unless others are asked for.
DEFAULT_VARIABLES = (
    "eps_1", "eps_2", "eps_1_fm", "eps_2_fm", "eps_1_qc", "eps_2_qc", "k_max_1", "k_max_2", "W", "temperature", "salinity", "density", "nu", "conductivity",
    "absolute_salinity", "conservative_temperature", "potential_density", "N2", "lat", "lon", "sh1_despike_frac", "sh2_despike_frac", "pressure",
)


def bin_edges(low: float, high: float, width: float) -> list[float]:
    """Edges low, low + width, ... up to the first at or over high."""
    return [low + i * width for i in range(math.ceil((high + width - low) / width))]


def bin_number(x: Column, low: float, width: float, bins: int) -> Column:
    """0-based bin of (low + b * width, low + (b + 1) * width]; null outside."""
    guess = F.ceil((x - low) / width).cast("long") - 1
    # the quotient may round across an edge: settle by the edges themselves
    b = F.when(x <= F.lit(low) + guess * width, guess - 1).when(x > F.lit(low) + (guess + 1) * width, guess + 1).otherwise(guess)
    return F.when((b >= 0) & (b < bins), b)


def bin_profiles(windows: DataFrame, keys: Sequence[str], variables: Sequence[str], low: float = 0.0, high: float = 1000.0, width: float = 2.0, pressure: str = "pressure", lat: str | None = None, latitude: float = 45.0, time: str | None = None, as_depth: bool = True) -> DataFrame:
    """(keys, depth, variables): means by (lo, hi] bin; for flags (``*_qc``) the
    greatest. depth is the bin's middle. Depth follows from pressure at the
    profile's mean latitude. One partial and one final aggregation."""
    edges = bin_edges(low, high, width)
    x = real(pressure)
    if as_depth:
        where = F.lit(latitude) if lat is None or lat not in windows.columns else F.coalesce(F.avg(real(lat)).over(Window.partitionBy(*keys)), F.lit(latitude))
        x = depth(real(pressure), where)
    own = [v for v in variables if v in windows.columns]
    b = windows.withColumn("__b", bin_number(x, low, width, len(edges) - 1)).where("__b IS NOT NULL")
    agg = [F.max(v).alias(v) if v.endswith("_qc") else F.avg(real(v)).alias(v) for v in own]
    if time:
        agg.append(F.avg(real(time)).alias(time))
    rows = b.groupBy(*keys, "__b").agg(*agg)
    return rows.select(*keys, (F.lit(low) + (F.col("__b") + 0.5) * width).alias("depth"), *own, *([time] if time else []))


def dense(binned: DataFrame, keys: Sequence[str], low: float, high: float, width: float) -> DataFrame:
    """binned with a row for every bin of every profile."""
    count = len(bin_edges(low, high, width)) - 1
    grid = binned.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("__b")).select(*keys, (F.lit(low) + (F.col("__b") + 0.5) * width).alias("depth"))
    return grid.join(binned, [*keys, "depth"], "left")


def combined(binned: DataFrame) -> DataFrame:
    """binned with eps and eps_qc of the two probes, if all four columns are there."""
    if not {"eps_1", "eps_2", "eps_1_qc", "eps_2_qc"} <= set(binned.columns):
        return binned
    eps, flag = combine_pair(F.col("eps_1"), F.col("eps_2"), F.col("eps_1_qc"), F.col("eps_2_qc"))
    return binned.withColumns({"eps": eps, "eps_qc": flag})


def order_profiles(binned: DataFrame, keys: Sequence[str], time: str = "time") -> DataFrame:
    """binned with profile_time (least time) and profile, the rank by it from 0;
    profiles without time come last. The ranking has a row for each profile."""
    firsts = binned.groupBy(*keys).agg(F.min(real(time)).alias("profile_time"))
    ranked = firsts.withColumn("profile", F.row_number().over(Window.orderBy(F.asc_nulls_last("profile_time"), *keys)) - 1)
    return binned.join(ranked, list(keys))


def bin_product(windows: DataFrame, keys: Sequence[str], low: float = 0.0, high: float = 1000.0, width: float = 2.0, variables: Sequence[str] | None = None, latitude: float = 45.0, questionable: float = 1e-7, bad: float = 1e-9, ctd: DataFrame | None = None, ctd_width: float | None = None, constants: Mapping[str, str] | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The gridded product of dissipation windows, and of fine CTD bins if given.

    Masks doubtful estimates, bins, takes the fine variant of a variable where
    there is one, restores missing flags, combines the probes, orders profiles by
    time, and fills the grid. With ctd_width also returns the fine table on its
    own grid.
    """
    asked = list(variables or DEFAULT_VARIABLES)
    flags = {v: f"{v}_qc" for v in asked if f"{v}_qc" in windows.columns and v.startswith("eps_")}
    time = "time" if "time" in windows.columns else None
    lat = "lat" if "lat" in windows.columns else None
    masked = mask_low_quality(windows, flags, questionable, bad)
    fine = [v for v in asked if ctd is not None and f"{v}_hires" in ctd.columns]
    coarse = [v for v in asked if v not in fine]
    out = bin_profiles(masked, keys, coarse, low, high, width, lat=lat, latitude=latitude, time=time)
    if fine:
        renamed = ctd.select(*keys, F.col("pressure_hires").alias("pressure"), *(F.col(f"{v}_hires").alias(v) for v in fine if v != "pressure"))
        hires = bin_profiles(renamed, keys, [v for v in fine], low, high, width, latitude=latitude)
        out = out.join(hires, [*keys, "depth"], "full")
    for flag in flags.values():
        if flag in out.columns:
            out = out.withColumn(flag, restore_missing(F.col(flag)))
    out = combined(dense(out, keys, low, high, width))
    for flag in flags.values():
        if flag in out.columns:
            out = out.withColumn(flag, restore_missing(F.col(flag)))
    if time:
        out = order_profiles(out, keys, time)
    for name, value in (constants or {}).items():
        out = out.withColumn(name, F.lit(value))
    if ctd is None or not ctd_width:
        return out
    names = [c for c in ctd.columns if c.endswith("_hires")]
    own = ctd.select(*keys, F.col("pressure_hires").alias("pressure"), *(F.col(c).alias(c.removesuffix("_hires")) for c in names if c != "pressure_hires"))
    grid = bin_profiles(own, keys, [c for c in own.columns if c not in keys], low, high, ctd_width, latitude=latitude)
    return out, dense(grid, keys, low, high, ctd_width).withColumnRenamed("depth", "ctd_depth")
