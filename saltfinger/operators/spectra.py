"""Spectra of dissipation windows and the dissipation rates that follow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spectral
from .series import despiked, highpassed, values_of
from .windows import kept_samples


def _rows_of(y: np.ndarray, others: np.ndarray | None, fs: float, n_fft: int, n_diss: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, spectra by window), without what is coherent with others."""
    if others is not None:
        return spectral.clean_spectra(y, others, fs, n_fft, n_diss)
    return spectral.window_psd(y, fs, n_fft, n_diss)


def _references(table: pa.Table, names: Sequence[str]) -> np.ndarray | None:
    others = np.stack([values_of(table, r) for r in names], axis=1) if names else None
    return others if others is not None and np.isfinite(others).all() else None


SPECTRUM = "win long, probe string, frequency array<double>, psd array<double>"


def window_spectra(fast: DataFrame, keys: Sequence[str], probes: Sequence[str], fs: float, n_fft: int, n_diss: int, references: Sequence[str] = (), suffix: str = "_clean") -> DataFrame:
    """(keys, win, probe, frequency, psd) for every probe's <probe>_clean that is
    there, shear without what is coherent with the references that are."""
    own = [p for p in probes if f"{p}{suffix}" in fast.columns]
    refs = [r for r in references if r in fast.columns]
    kinds = {f.name: f.dataType.simpleString() for f in fast.schema if f.name in keys}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        rows: list[tuple] = []
        others = _references(table, refs)
        for p in own:
            y = values_of(table, f"{p}{suffix}")
            if len(y) >= n_diss:
                f, psd = _rows_of(y, others if p.startswith("sh") else None, fs, n_fft, n_diss)
                rows += [(w, p, f.tolist(), row.tolist()) for w, row in enumerate(psd)]
        return _table(table, keys, SPECTRUM, rows)

    need = [*keys, "i", *(f"{p}{suffix}" for p in own), *refs]
    return fast.select(*need).groupBy(*keys).applyInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + SPECTRUM)


def _table(group: pa.Table, keys: Sequence[str], schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    same = {k: pa.array([group.column(k)[0].as_py()] * len(rows), group.column(k).type) for k in keys}
    return pa.table(same | {name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, cols, strict=True)})


CLEANED = f"{SPECTRUM}, spikes double, error string"


def profile_spectra(fast: DataFrame, keys: Sequence[str], probes: Sequence[str], shear: Sequence[str], references: Sequence[str] = (), cutoff: float | None = None, chop_start: bool = True, force: bool = False, despike: Mapping | None = None) -> DataFrame:
    """(keys, win, probe, frequency, psd, spikes, error) of each profile, in one pass:
    despike, high-pass shear, trim to complete windows, and take spectra. spikes is
    the share of a window's samples that despiking changed. fast has fs_fast, n_fft,
    n_diss and ratio; a probe that comes with <probe>_clean and its mask is not
    despiked again unless force is set. A profile that fails, or is shorter than a
    window, is one row with what went wrong."""
    own = [p for p in probes if p in fast.columns or f"{p}_clean" in fast.columns]
    refs = [r for r in references if r in fast.columns]
    done = [p for p in own if not force and {f"{p}_clean", f"{p}_despike_mask"} <= set(fast.columns)]
    kinds = {f.name: f.dataType.simpleString() for f in fast.schema if f.name in keys}
    options = dict(despike or {})

    def spectra_of(table: pa.Table) -> list[tuple]:
        table = table.sort_by("i")
        fs, n_fft, n_diss, ratio = (table.column(c)[0].as_py() for c in ("fs_fast", "n_fft", "n_diss", "ratio"))
        keep = kept_samples(table.num_rows, n_diss, n_fft, ratio)
        if not keep:
            raise ValueError(f"profile of {table.num_rows} samples is shorter than a window of {n_diss}")
        start = table.num_rows - keep if chop_start else 0
        others = _references(table, refs)
        others = others[start : start + keep] if others is not None else None
        step, rows = n_diss - n_fft // 2, []
        for p in own:
            if p in done:
                y, mask = values_of(table, f"{p}_clean"), values_of(table, f"{p}_despike_mask")
            else:
                y, mask = despiked(values_of(table, p), fs, **options)
            if p in shear and cutoff:
                y = highpassed(y, fs, cutoff)
            y, mask = y[start : start + keep], np.asarray(mask, float)[start : start + keep]
            f, psd = _rows_of(y, others if p.startswith("sh") else None, fs, n_fft, n_diss)
            rows += [(w, p, f.tolist(), row.tolist(), float(mask[w * step : w * step + n_diss].mean()), None) for w, row in enumerate(psd)]
        return rows

    def run(table: pa.Table) -> pa.Table:
        try:
            rows = spectra_of(table)
        except Exception as e:  # the row of the status table
            rows = [(None, None, None, None, None, f"{type(e).__name__}: {e}")]
        return _table(table, keys, CLEANED, rows)

    extra = [c for p in done for c in (f"{p}_clean", f"{p}_despike_mask")]
    need = [*keys, "i", "fs_fast", "n_fft", "n_diss", "ratio", *(p for p in own if p not in done), *refs, *extra]
    return fast.select(*dict.fromkeys(need)).groupBy(*keys).applyInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + CLEANED)


def to_wavenumber(psd: Column, speed: Column, probe: Column) -> Column:
    """Spectra from the time derivative to the spatial one: 1 / W^4 for shear,
    1 / W^2 for temperature gradients."""
    power = F.when(probe.startswith("sh"), speed * speed * speed * speed).otherwise(speed * speed)
    return F.transform(psd, lambda x: x / power)


def epsilon(frequency: Column, psd: Column, speed: Column, nu: Column, **options) -> Column:
    """struct<eps, k_max, mad> of a shear spectrum; fields are null where no
    estimate can be made."""

    @F.pandas_udf("eps double, k_max double, mad double")
    def fit(f, p, w, n):
        import pandas as pd

        out = [
            spectral.estimate_epsilon(np.asarray(a, float), np.asarray(b, float), float(c), float(d), **options) if a is not None and b is not None and c == c and d == d and c is not None and d is not None else (np.nan,) * 3
            for a, b, c, d in zip(f, p, w, n, strict=True)
        ]
        return pd.DataFrame(out, columns=["eps", "k_max", "mad"])

    return fit(frequency, psd, speed, nu)


def inertial(k: Column, phi: Column, eps: Column, nu: Column, limit: Column, reach: Column) -> Column:
    """struct<eps, k_max, used> of the level fit in the inertial subrange."""

    @F.pandas_udf("eps double, k_max double, used long")
    def fit(k, phi, eps, nu, limit, reach):
        import pandas as pd

        rows = [spectral.inertial_fit(np.asarray(a, float), np.asarray(b, float), *x) for a, b, *x in zip(k, phi, eps, nu, limit, reach, strict=True)]
        return pd.DataFrame([(e, last, int(mask.sum())) for e, last, mask in rows], columns=["eps", "k_max", "used"])

    return fit(k, phi, eps, nu, limit, reach)


def whole_variance(e: Column, k_max: Column, nu: Column) -> Column:
    """Dissipation with unresolved variance."""

    @F.pandas_udf("double")
    def whole(e, k, nu):
        import pandas as pd

        return pd.Series([spectral.whole_variance(*x) for x in zip(e, k, nu, strict=True)], dtype=float)

    return whole(e, k_max, nu)


def misfit(k: Column, phi: Column, eps: Column, nu: Column) -> Column:
    """Mean |log10(phi / Nasmyth)| over all bins but the first."""

    @F.pandas_udf("double")
    def off(k, phi, eps, nu):
        import pandas as pd

        return pd.Series([spectral.misfit(np.asarray(a, float), np.asarray(b, float), e, n, np.ones(len(a), bool)) for a, b, e, n in zip(k, phi, eps, nu, strict=True)], dtype=float)

    return off(k, phi, eps, nu)
