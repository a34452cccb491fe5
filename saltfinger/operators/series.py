"""Order-dependent series operators: one grouped Arrow call for each key.

Every operator takes a sample table, sends each key's rows, ordered by index, to a
NumPy kernel, and returns the table with columns replaced or added. Keys are a
file, or a file and a profile, so a group is one cast of one instrument.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import kernels


def values_of(table: pa.Table, name: str) -> np.ndarray:
    """A column as float64, null as NaN."""
    return table.column(name).cast(pa.float64()).to_numpy().astype(float, copy=True)


def rate_of(table: pa.Table, fs: float | str) -> float:
    """A sampling rate: known now, or the column of that name."""
    return float(table.column(fs)[0].as_py()) if isinstance(fs, str) else fs


def by_key(df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table], dict[str, np.ndarray | list]], added: Sequence[str], index: str = "i", error: str | None = None) -> DataFrame:
    """df with columns from fn, called with each key's rows in order. ``added``
    are 'name type' strings; a name that df has is replaced. With ``error`` a key
    for which fn fails has nulls, and what went wrong in the column of that name."""
    if error:
        added = [*added, f"{error} string"]
    schema = T.StructType([f for f in df.schema if f.name not in {a.split()[0] for a in added}])
    for a in added:
        schema = schema.add(*a.split(" ", 1))
    kept = [f.name for f in df.schema if f.name in schema.names and f.name not in {a.split()[0] for a in added}]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(index)
        try:
            new = fn(table)
            if error:
                new[error] = pa.nulls(table.num_rows, pa.string())
        except Exception as e:
            if not error:
                raise
            kinds = {"double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
            new = {name: pa.nulls(table.num_rows, kinds[kind]) for name, kind in (a.split(" ", 1) for a in added)} | {error: [f"{type(e).__name__}: {e}"] * table.num_rows}
        return pa.table({**{c: table.column(c) for c in kept}, **{name: x if isinstance(x := new[name], pa.Array) else pa.array(x, from_pandas=True) for name in (a.split()[0] for a in added)}})

    return df.groupBy(*keys).applyInArrow(run, schema)


def despiked(x: np.ndarray, fs: float, max_passes: int = 6, thresh: float = 8.0, smooth: float = 0.5, replace_sec: float = 0.04) -> tuple[np.ndarray, np.ndarray]:
    """(cleaned, changed) of a series; as it is if it is short or has gaps."""
    clean = kernels.despike(x, thresh, smooth, fs, int(replace_sec * fs), max_passes)[0] if len(x) >= 5 and np.isfinite(x).all() else x
    return clean, (clean != x) & ~(np.isnan(clean) & np.isnan(x))


def highpassed(x: np.ndarray, fs: float, cutoff: float) -> np.ndarray:
    return kernels.sosfiltfilt(kernels.butter1("high", cutoff, fs), x) if len(x) > 6 and np.isfinite(x).all() else x


def despike(df: DataFrame, keys: Sequence[str], variables: Sequence[str], fs: float | str, suffix: str = "_clean", force: bool = False, **options) -> DataFrame:
    """df with <v>_clean and <v>_despike_mask for each variable that is there. A
    variable that has both already is left alone unless force is set. Options are
    those of ``despiked``."""
    todo = [v for v in variables if v in df.columns and (force or not {f"{v}{suffix}", f"{v}_despike_mask"} <= set(df.columns))]
    if not todo:
        return df

    def run(table):
        out = {}
        for v in todo:
            out[f"{v}{suffix}"], out[f"{v}_despike_mask"] = despiked(values_of(table, v), rate_of(table, fs), **options)
        return out

    return by_key(df, keys, run, [c for v in todo for c in (f"{v}{suffix} double", f"{v}_despike_mask boolean")])


def highpass(df: DataFrame, keys: Sequence[str], variables: Sequence[str], fs: float | str, cutoff: float, suffix: str = "_clean") -> DataFrame:
    """Zero-phase first-order high pass of <v>_clean."""
    names = [f"{v}{suffix}" for v in variables if f"{v}{suffix}" in df.columns]
    if not names:
        return df
    return by_key(df, keys, lambda table: {n: highpassed(values_of(table, n), rate_of(table, fs), cutoff) for n in names}, [f"{n} double" for n in names])


def speed(df: DataFrame, keys: Sequence[str], pressure: str, fs: float | str, out: str, pitch: str | None = None, attack: float = 3.0, dbar_to_m: float = 1.005) -> DataFrame:
    """|dP/dt| in m/s, along the path if pitch (degrees) is given."""

    def run(table):
        p = values_of(table, pressure)
        angle = values_of(table, pitch) if pitch else None
        return {out: kernels.gradient_speed(p, rate_of(table, fs), angle, attack, dbar_to_m) if len(p) > 1 else np.full(len(p), np.nan)}

    return by_key(df, keys, run, [f"{out} double"])


def lag(df: DataFrame, keys: Sequence[str], value: str, samples: float, out: str) -> DataFrame:
    """value delayed by a fractional number of samples."""
    return by_key(df, keys, lambda table: {out: kernels.lag_series(values_of(table, value), samples)}, [f"{out} double"])


def smooth_slow(df: DataFrame, keys: Sequence[str], fs: float | str, pressure: str = "P", speed: str = "W", period: float = 0.5, order: int = 4, pitch: str | None = None, attack: float = 3.0, dbar_to_m: float = 1.005, gap: float = 2.0, factor: float = 4.0, error: str | None = None) -> DataFrame:
    """df with <pressure>_smooth, <speed>_smooth and, where it is not there, speed
    from pressure; filters do not cross gaps in time."""
    if pressure not in df.columns:
        raise ValueError(f"no pressure column {pressure!r}")
    has_speed = speed in df.columns

    def run(table):
        rate = rate_of(table, fs)
        sos = kernels.butter_low(order, 1 / period, rate)
        t, p = values_of(table, "t"), values_of(table, pressure)
        pressure_smooth = kernels.gap_aware_filtfilt(sos, p, t, gap, factor)
        angle = values_of(table, pitch) if pitch else None
        w = values_of(table, speed) if has_speed else kernels.gradient_speed(pressure_smooth, rate, angle, attack, dbar_to_m) if len(p) > 1 else np.full(len(p), np.nan)
        return {f"{pressure}_smooth": pressure_smooth, f"{speed}_smooth": kernels.gap_aware_filtfilt(sos, w, t, gap, factor), speed: w}

    added = [f"{pressure}_smooth double", f"{speed}_smooth double"] + ([] if has_speed else [f"{speed} double"])
    return by_key(df, keys, run, added, error=error)


def low_pass(df: DataFrame, keys: Sequence[str], value: str, fs: float, cutoff: float, out: str) -> DataFrame:
    """Causal first-order low pass from a state of rest."""
    sos = kernels.butter1("low", cutoff, fs)
    return by_key(df, keys, lambda table: {out: kernels.sosfilt(sos, values_of(table, value))[0]}, [f"{out} double"])


def match_conductivity(df: DataFrame, keys: Sequence[str], fs: float | str, conductivity: str = "JAC_C", speed: str = "W_smooth", lag: float = 0.0234, cutoff: float = 0.73, reference: float = 0.62) -> DataFrame:
    """conductivity delayed and smoothed to the thermometer's response at each
    key's mean absolute speed."""

    def run(table):
        w = np.abs(values_of(table, speed))
        mean = float(np.nanmean(w)) if np.isfinite(w).any() else float("nan")
        return {conductivity: kernels.match_conductivity(values_of(table, conductivity), rate_of(table, fs), mean, lag, cutoff, reference)}

    return by_key(df, keys, run, [f"{conductivity} double"])


def deconvolve(df: DataFrame, keys: Sequence[str], pre: str, fs: float, gain: float, out: str, low: str | None = None) -> DataFrame:
    """High-resolution counts of a pre-emphasised channel; low is the slow channel
    on the same rows, null between its samples."""

    def run(table):
        slow = values_of(table, low) if low else None
        return {out: kernels.deconvolve(values_of(table, pre), fs, gain, slow[~np.isnan(slow)] if slow is not None else None)}

    return by_key(df, keys, run, [f"{out} double"])


def temperature_gradient(df: DataFrame, keys: Sequence[str], pre: str, params: dict, fs: float, out: str, method: str = "high_pass", smooth: str | None = None) -> DataFrame:
    """dT/dt (K/s) of a pre-emphasised thermistor."""

    def run(table):
        return {out: kernels.temperature_gradient(values_of(table, pre), params, fs, method, values_of(table, smooth) if smooth else None)}

    return by_key(df, keys, run, [f"{out} double"])
