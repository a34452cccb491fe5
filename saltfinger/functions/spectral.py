"""Spectral kernels: power spectra, coherent noise removal, dissipation fits."""

from __future__ import annotations

import math

import numpy as np

from .physics import nasmyth, nasmyth_resolved, single_pole


def _check(y: np.ndarray, n_fft: int, n_diss: int) -> None:
    if y.ndim != 1:
        raise ValueError("the series must be one-dimensional")
    if n_fft % 2 or n_diss % (n_fft // 2):
        raise ValueError("n_fft must be even and n_diss a multiple of n_fft / 2")
    if len(y) < n_diss:
        raise ValueError("the series is shorter than a window")


def _segments(y: np.ndarray, n_fft: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(y, n_fft)[:: n_fft // 2]


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _halved(p: np.ndarray) -> np.ndarray:
    p[..., 0] *= 0.5
    p[..., -1] *= 0.5
    return p


def window_psd(y: np.ndarray, fs: float, n_fft: int, n_diss: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, spectra by window): Hann segments half overlapping, averaged
    over those of each dissipation window."""
    y = np.asarray(y, float)
    _check(y, n_fft, n_diss)
    w = hann(n_fft)
    power = _halved(2 * np.abs(np.fft.rfft(_segments(y, n_fft) * w, axis=-1)) ** 2 / ((w**2).sum() * fs))
    per = (n_diss - n_fft // 2) // (n_fft // 2)
    n = len(power) // per
    return np.fft.rfftfreq(n_fft, 1 / fs), power[: n * per].reshape(n, per, -1).mean(axis=1)


def clean_spectra(y: np.ndarray, references: np.ndarray, fs: float, n_fft: int, n_diss: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, spectra by window) of y without what is coherent with the
    references (columns), with the bias of their number taken out."""
    y = np.asarray(y, float)
    _check(y, n_fft, n_diss)
    all_ = [y, *np.atleast_2d(np.asarray(references, float).T)]
    w = hann(n_fft)
    x = np.linspace(0, 1, n_fft)
    basis = np.stack([x - x.mean(), np.ones(n_fft)])
    pull = basis.T @ np.linalg.pinv(basis.T)
    spectra = [np.fft.rfft((s := _segments(v, n_fft) * w) - s @ pull.T, axis=-1) for v in all_]
    per = (n_diss - n_fft // 2) // (n_fft // 2)
    n = len(spectra[0]) // per
    f = np.stack(spectra)[:, : n * per].reshape(len(all_), n, per, -1)
    scale = 2 / ((w**2).sum() * fs)
    cross = scale * np.einsum("anpf,bnpf->nfab", f, f.conj()) / per
    cross[:, 0] *= 0.5
    cross[:, -1] *= 0.5
    yy, yc, cc = cross[..., 0, 0].real, cross[..., 0, 1:], cross[..., 1:, 1:]
    try:
        solved = np.linalg.solve(cc, yc.conj()[..., None])[..., 0]
    except np.linalg.LinAlgError:
        solved = (np.linalg.pinv(cc) @ yc.conj()[..., None])[..., 0]
    clean = yy - np.einsum("nfa,nfa->nf", yc, solved).real
    bias = 1 / (1 - 1.02 * (len(all_) - 1) / per)
    return np.fft.rfftfreq(n_fft, 1 / fs), np.maximum(clean * bias, 0)


def whole_variance(e: float, k_max: float, nu: float = 1e-6) -> float:
    """Dissipation that with its variance below k_max has e: fixed-point steps."""
    eps = e
    for _ in range(12):
        share = min(max(float(nasmyth_resolved(k_max, eps, nu)), 0.05), 0.999)
        new = e / share
        done = new / eps < 1.02
        eps = new
        if done:
            break
    return eps


def inertial_fit(k: np.ndarray, phi: np.ndarray, eps: float, nu: float, limit: float, reach: float = 0.02) -> tuple[float, float, np.ndarray]:
    """(eps, greatest k used, bins used): level fit to the Nasmyth form in the
    inertial subrange of the first guess, then again without the worst fifth of
    bins at most, if they are off by over half a decade."""
    used = np.flatnonzero((k > 0) & (k <= min(limit, reach * (eps / nu**3) ** 0.25)))

    def off(bins: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log10(phi[bins] / nasmyth(k[bins], eps, nu))

    if len(used) >= 8:
        for _ in range(3):
            eps *= 10 ** (1.5 * off(used).mean())
        error = np.abs(off(used))
        worst = np.argsort(-error, kind="stable")[: int(0.2 * len(used))]
        if (error > 0.5).any():
            used = np.delete(used, worst[error[worst] > 0.5])
            for _ in range(2):
                eps *= 10 ** (1.5 * off(used).mean())
    mask = np.zeros(len(k), bool)
    mask[used] = True
    return float(eps), float(k[used[-1]]) if len(used) else float(limit), mask


def spectral_minimum(k: np.ndarray, phi: np.ndarray, order: int = 3) -> float:
    """log10 k of the first minimum of a polynomial fit in log-log space, at 10
    cpm or beyond; RuntimeError if there is none."""
    if not 3 <= order <= 8:
        raise ValueError("order must be from 3 to 8")
    own = slice(1 if np.isclose(k[0], 0) else 0, None)
    if len(k[own]) <= order + 2:
        raise RuntimeError("too few points")
    with np.errstate(divide="ignore"):
        x, y = np.log10(k[own]), np.log10(phi[own])
    if not np.isfinite(y).all():
        raise RuntimeError("spectrum is not positive")
    p = np.polyfit(x, y, order)
    slope = np.polyder(p)
    roots = np.roots(slope)
    roots = np.sort(roots[np.isreal(roots)].real)
    low = roots[(np.polyval(np.polyder(slope), roots) > 0) & (roots >= 1.0)]
    if not len(low):
        raise RuntimeError("no minimum")
    return float(low[0])


def misfit(k: np.ndarray, phi: np.ndarray, eps: float, nu: float, mask: np.ndarray) -> float:
    """Mean absolute log10 deviation from Nasmyth over the mask less its first bin."""
    at = np.flatnonzero(mask)[1:]
    at = at[phi[at] > 0]
    if not len(at) or not np.isfinite(eps) or eps <= 0:
        return float("nan")
    return float(np.abs(np.log10(phi[at] / nasmyth(k[at], eps, nu))).mean())


def estimate_epsilon(f: np.ndarray, spectrum: np.ndarray, speed: float, nu: float = 1e-6, f_aa: float = 98.0, inertial_from: float = 1.5e-5, order: int = 3, is_wavenumber: bool = False, correct: bool = True) -> tuple[float, float, float]:
    """(dissipation rate, greatest wavenumber used, misfit) of a shear spectrum."""
    none = (float("nan"),) * 3
    f, spectrum = np.asarray(f, float), np.asarray(spectrum, float)
    if not np.isfinite(speed) or not np.isfinite(nu) or speed <= 0 or nu <= 0 or not np.isfinite(spectrum).all():
        return none
    k, phi = (f, spectrum) if is_wavenumber else (f / speed, spectrum * speed)
    if correct:
        phi = phi * single_pole(k)
    area = lambda m: 7.5 * nu * float(np.trapezoid(phi[m], k[m]))
    low = k <= 10
    if low.sum() < 3:
        low = np.arange(len(k)) < 3
    e10 = area(low)
    if not e10 > 0:
        return none
    e1 = e10 * math.sqrt(1 + 1.0774e9 * e10)
    k_aa = f_aa / speed
    if e1 >= inertial_from:
        eps, last, used = inertial_fit(k, phi, e1, nu, min(150.0, k_aa))
        return eps, last, misfit(k, phi, eps, nu, used)
    if (k * (nu**3 / e1) ** 0.25 <= 0.02).sum() >= 20:
        e1, _, _ = inertial_fit(k, phi, e1, nu, min(150.0, k_aa))
    k95 = 0.1205 * (e1 / nu**3) ** 0.25
    valid = k <= min(k_aa, k95)
    if valid.sum() < 3:
        valid = np.arange(len(k)) < 3
    try:
        minimum = spectral_minimum(k[valid], phi[valid], order)
    except (RuntimeError, np.linalg.LinAlgError):
        minimum = math.log10(k95)
    limit = 10 ** min(max(min(minimum, math.log10(k95), math.log10(k_aa)), math.log10(7)), math.log10(150))
    used = k <= limit
    if used.sum() < 3:
        used = np.arange(len(k)) < 3
    if k[used][-1] < 7 and used.sum() < len(k):
        used = np.arange(len(k)) <= int(np.flatnonzero(used)[-1]) + 1
    e3, last = area(used), float(k[used][-1])
    eps = whole_variance(e3, last, nu)
    if k[1] > 0:
        missing = 0.25 * 7.5 * nu * k[1] * float(nasmyth(k[1:2], eps, nu)[0])
        eps = whole_variance(e3 + missing, last, nu) if (eps + missing) / eps > 1.1 else eps + missing
    return float(eps), last, misfit(k, phi, eps, nu, used & (k > 0))
