"""Detection of casts in pressure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import windows
from .series import values_of
from .windows import number_profiles, real

#: Peak criteria in dbar and samples.
PEAKS = {"height": 25.0, "distance": 200, "width": 200, "prominence": 25.0}


def _first_beyond(x: np.ndarray, ahead: bool) -> np.ndarray:
    """For each sample the nearest higher one before it (ahead: after it), or -1
    (the length). A stack of falling values makes it linear."""
    n = len(x)
    out = np.full(n, n if ahead else -1, np.int64)
    stack: list[int] = []
    values = x.tolist()
    for i in range(n - 1, -1, -1) if ahead else range(n):
        while stack and values[stack[-1]] <= values[i]:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return out


def _range_minima(x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least value of each x[first:end], by doubled blocks."""
    length = end - first
    out = np.empty(len(first))
    level, table = 0, x
    for power in range(int(length.max()).bit_length() if len(length) else 0):
        now = (length >> power) == 1
        a = first[now]
        out[now] = np.minimum(table[a], table[end[now] - (1 << power)])
        level = 1 << power
        if len(table) > level:
            table = np.minimum(table[:-level], table[level:])
    return out


def find_peaks(x: np.ndarray, height: float | None = None, distance: float | None = None, prominence: float | None = None, width: float | None = None, plateau: tuple[int, int] | None = None) -> np.ndarray:
    """Local maxima (middles of plateaus) that meet the criteria, in this order.
    ``plateau`` bounds the samples of a flat top, both ends included, before all others."""
    change = np.flatnonzero(np.diff(x)) + 1
    starts, ends = np.concatenate(([0], change)), np.concatenate((change, [len(x)]))
    level = x[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    if plateau is not None:
        flat = ends[top] - starts[top]
        top = top[(flat >= plateau[0]) & (flat <= plateau[1])]
    peaks = (starts[top] + ends[top] - 1) // 2
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance is not None and len(peaks):
        keep = np.ones(len(peaks), bool)
        for i in np.argsort(x[peaks], kind="stable")[::-1].tolist():
            if keep[i]:
                a, z = np.searchsorted(peaks, peaks[i] - distance, "right"), np.searchsorted(peaks, peaks[i] + distance, "left")
                keep[a:i] = False
                keep[i + 1 : z] = False
        peaks = peaks[keep]
    if not len(peaks) or (prominence is None and width is None):
        return peaks.astype(np.int64)
    left, right = _first_beyond(x, False)[peaks] + 1, _first_beyond(x, True)[peaks] - 1
    rise = x[peaks] - np.maximum(_range_minima(x, left, peaks + 1), _range_minima(x, peaks, right + 1))
    good = np.ones(len(peaks), bool) if prominence is None else rise >= prominence
    out = []
    for p, a, z, r in zip(*(v[good].tolist() for v in (peaks, left, right, rise)), strict=True):
        if width is None or _width(x, p, a, z, x[p] - r / 2) >= width:
            out.append(p)
    return np.array(out, np.int64)


def _width(x: np.ndarray, p: int, left: int, right: int, level: float) -> float:
    """Distance between the crossings of a level on either side of a peak, which are
    looked for in steps that double."""

    def crossing(step: int, bound: int) -> float:
        at, reach = p, 64
        while at != bound:
            end = min(at + reach, bound) if step > 0 else max(at - reach, bound)
            part = x[at : end + 1] if step > 0 else x[end : at + 1][::-1]
            below = np.flatnonzero(part < level)
            if len(below):
                b = at + step * int(below[0])
                return b - step * (level - x[b]) / (x[b - step] - x[b])
            at, reach = end, reach * 2
        return float(bound)

    return crossing(1, right) - crossing(-1, left)


def find_cycles(pressure: np.ndarray, min_pressure: float = 0.0, peaks: Mapping | None = None) -> list[tuple[int, int, int, int]]:
    """(down start, down end, up start, up end) of each dive: from the trough
    before a pressure peak to the peak, and from it to the trough after."""
    tops = find_peaks(pressure, **dict(peaks or PEAKS)).tolist()
    out = []
    for i, p in enumerate(tops):
        a = tops[i - 1] if i else 0
        z = tops[i + 1] if i + 1 < len(tops) else len(pressure) - 1
        before = pressure[a : p + 1]
        start = a + len(before) - 1 - int(np.argmin(before[::-1]))
        end = p + int(np.argmin(pressure[p : z + 1]))
        if min_pressure > 0:
            deep = np.flatnonzero(pressure[start : p + 1] >= min_pressure)
            start = start + int(deep[0]) if len(deep) else p
            deep = np.flatnonzero(pressure[p : end + 1] >= min_pressure)
            end = p + int(deep[-1]) if len(deep) else p
        out.append((start, p, p, end))
    return out


def profile_index(slow: DataFrame, keys: Sequence[str], pressure: str = "P_smooth", time: str = "t", whole_file: bool = True, direction: str = "down", min_pressure: float = 0.0, peaks: Mapping | None = None, gap: float = 5.0, factor: float = 10.0) -> DataFrame:
    """(keys, profile_index, start_idx, end_idx, start_time, end_time, direction)
    of every profile. Only pressure and time are read.

    Series with gaps in time are cut at them, and a stretch that goes one way is a
    profile as a whole; Spark's windows do that. Other stretches, and series
    without gaps, go to the peak finder, a stretch at a time. A series with missing
    pressures, or in which nothing is found, is one profile if whole_file is set.
    """
    peaks = dict(peaks or PEAKS)
    kinds = {f.name: f.dataType.simpleString() for f in slow.schema if f.name in keys}
    own = slow.select(*keys, "i", F.col(time).alias("t"), real(pressure).alias("p"))
    stretches = windows.gap_segments(own, keys, gap, factor)
    per = Window.partitionBy(*keys)
    shape = windows.segment_shape(stretches, keys, "p").withColumn("__gaps", F.max("segment").over(per) > 0)
    shape = shape.withColumn("__whole", F.min(F.col("n_samples") == F.col("n_valid")).over(per))
    good = shape.where("__whole")
    least = float(peaks.get("height", max(min_pressure, 1.0)))
    one_way = windows.monotonic_profiles(good.where("__gaps"), direction, least)
    rest = good.where(~F.col("__gaps") | ((F.col("end_idx") > F.col("start_idx")) & (F.col("max_pressure") >= least)))
    rest = rest.join(one_way.select(*keys, "segment"), [*keys, "segment"], "left_anti")
    table = "start_idx long, end_idx long, start_time double, end_time double, direction string"
    names = [c.split()[0] for c in table.split(", ")]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        p, t, index = values_of(group, "p"), values_of(group, "t"), group.column("i").to_numpy()
        found = [(s, e) for d0, d1, u0, u1 in (find_cycles(p, min_pressure, peaks) if len(p) > 2 else []) for way, s, e in (("down", d0, d1), ("up", u0, u1)) if direction in (way, "both") and e > s]
        first, last = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
        ways = np.where(p[last] >= p[first], "down", "up") if found else []
        same = {k: pa.array([group.column(k)[0].as_py()] * len(found), group.column(k).type) for k in keys}
        return pa.table(same | {"start_idx": index[first], "end_idx": index[last], "start_time": t[first], "end_time": t[last], "direction": pa.array(ways, pa.string())})

    cycles = stretches.join(rest.select(*keys, "segment"), [*keys, "segment"], "left_semi").groupBy(*keys, "segment").applyInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + table)
    found = one_way.select(*keys, *names).unionByName(cycles)
    if whole_file:
        ends = shape.groupBy(*keys).agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.min_by("first_pressure", "start_idx").alias("__p0"), F.max_by("last_pressure", "start_idx").alias("__p1"))
        way = F.when(F.col("__p1") >= F.col("__p0"), "down").otherwise("up")
        none = ends.join(found.select(*keys).distinct(), list(keys), "left_anti").withColumn("direction", way)
        found = found.unionByName(none.select(*keys, *names))
    return number_profiles(found, keys).select(*keys, F.col("profile_index").cast("long"), *names)
