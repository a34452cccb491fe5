import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from saltfinger.functions import kernels as K
from saltfinger.functions import spectral as S
from saltfinger.operators import profiles as P


def direct(section, x, z):
    b0, b1, b2, _, a1, a2 = section
    out = []
    z0, z1 = z
    for v in x:
        y = b0 * v + z0
        z0, z1 = b1 * v - a1 * y + z1, b2 * v - a2 * y
        out.append(y)
    return np.array(out), (z0, z1)


@pytest.mark.parametrize("n", [1, 5, 255, 256, 257, 700])
@pytest.mark.parametrize("sos", [K.butter1("low", 3, 64), K.butter1("high", 3, 64), K.butter_low(4, 2, 64)])
def test_blocked_filter_is_the_recursion(n, sos):
    x = np.random.default_rng(n).normal(size=n)
    y, states = K.sosfilt(sos, x, np.ones((len(sos), 2)))
    want = x
    for i, section in enumerate(sos):
        want, end = direct(section, want, (1.0, 1.0))
        assert states[i] == pytest.approx(end)
    assert y == pytest.approx(want)


def test_butterworth_is_half_power_at_cutoff():
    for sos, fc in ((K.butter1("low", 5, 64), 5), (K.butter1("high", 5, 64), 5), (K.butter_low(4, 2, 64), 2)):
        z = np.exp(-2j * np.pi * fc / 64)
        h = np.prod([(s[0] + s[1] * z + s[2] * z * z) / (1 + s[4] * z + s[5] * z * z) for s in sos])
        assert abs(h) ** 2 == pytest.approx(0.5)


def test_steady_state_and_zero_phase():
    sos = K.butter_low(4, 2, 64)
    assert K.sosfilt(sos, np.ones(50), K.steady_state(sos))[0] == pytest.approx(np.ones(50))
    ramp = np.linspace(0, 5, 300)
    assert K.sosfiltfilt(sos, ramp)[100:200] == pytest.approx(ramp[100:200], abs=1e-4)
    assert K.sosfiltfilt(sos, ramp) == pytest.approx(ramp, abs=0.02)
    with pytest.raises(ValueError, match="padding"):
        K.sosfiltfilt(sos, np.ones(10))


def test_gaps_are_not_filtered_across():
    t = np.concatenate((np.arange(100) / 64, 50 + np.arange(100) / 64))
    x = np.concatenate((np.zeros(100), np.full(100, 9.0)))
    assert K.gap_aware_filtfilt(K.butter_low(4, 2, 64), x, t) == pytest.approx(x)


def test_despike_removes_a_spike():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.1, 4096)
    y = x.copy()
    y[2000] += 50
    clean, spikes, passes, share = K.despike(y)
    assert 2000 in spikes and abs(clean[2000]) < 1 and 1 <= passes <= 6 and 0 < share < 0.02
    assert (clean[:1900] == y[:1900]).all()
    with pytest.raises(ValueError, match="5 samples"):
        K.despike(np.zeros(3))
    assert K.despike(np.zeros(100))[3] == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=3, max_size=12))
def test_pchip_passes_through_and_is_monotone(y):
    x = np.arange(len(y), dtype=float)
    assert K.pchip(x, y, x) == pytest.approx(y, abs=1e-9)
    fine = K.pchip(x, y, np.linspace(0, len(y) - 1, 200))
    assert fine.max() <= max(y) + 1e-9 and fine.min() >= min(y) - 1e-9


def test_deconvolution_restores_a_signal():
    fs, gain = 512.0, 0.9
    t = np.arange(8192) / fs
    x = 10 + np.sin(2 * np.pi * 0.2 * t)
    pre = x + gain * np.gradient(x, 1 / fs)
    assert np.abs(K.deconvolve(pre, fs, gain, x[::8]) - x)[500:].max() < 0.02
    assert np.abs(K.deconvolve(-pre, fs, gain, x[::8]) - x)[500:].max() < 0.02
    assert np.abs(K.deconvolve(pre, fs, gain) - x)[4000:].max() < 0.05


def test_gradient_methods_agree():
    fs = 512.0
    params = {"type": "therm", "diff_gain": 0.94, "a": 0, "b": 1, "adc_fs": 4.096, "adc_bits": 16, "g": 6, "e_b": 0.68, "t_0": 289.3, "beta": 3143.5}
    t = np.arange(16384) / fs
    x = 2000 * np.sin(2 * np.pi * 0.3 * t)
    pre = x + 0.94 * np.gradient(x, 1 / fs)
    a = K.temperature_gradient(pre, params, fs, "high_pass")[6000:-10]
    b = K.temperature_gradient(pre, params, fs, "first_difference")[6000:-10]
    assert np.corrcoef(a, b)[0, 1] > 0.999 and a.std() == pytest.approx(b.std(), rel=0.02)
    with pytest.raises(ValueError, match="unknown method"):
        K.temperature_gradient(pre, params, fs, "none")
    with pytest.raises(ValueError, match="diff_gain"):
        K.temperature_gradient(pre, {}, fs)


def test_conductivity_matching():
    c = np.where(np.arange(3000) / 64 < 10, 35.0, 36.0)
    moved = K.match_conductivity(c, 64.0, 0.62, lag=0.1, cutoff=5.0)
    cross = lambda x: np.argmax(x > 35.5)
    assert 6 <= cross(moved) - cross(c) <= 12
    for speed in (0.0, -1.0, float("nan"), 1e-6):
        assert (K.match_conductivity(c, 64.0, speed) == c).all()
    line = np.arange(40.0)
    assert K.lag_series(line, 1.4) == pytest.approx(line - 1.4)


def test_psd_of_a_tone_and_parseval():
    rng = np.random.default_rng(1)
    y = rng.normal(size=512 * 20)
    f, p = S.window_psd(y, 512.0, 512, 2048)
    assert f[1] == 1 and p.shape == ((len(y) - 2048) // 1792 + 1, 257)
    assert p.mean() * 256 == pytest.approx(y.var(), rel=0.05)
    for bad in ((np.zeros((2, 2)), 512, 2048), (y, 511, 2048), (y, 512, 2049), (y[:100], 512, 2048)):
        with pytest.raises(ValueError):
            S.window_psd(bad[0], 512.0, bad[1], bad[2])


def test_coherent_noise_is_removed():
    rng = np.random.default_rng(1234)
    t = np.arange(512 * 120) / 512.0
    base = rng.normal(0, 0.3, len(t))
    a = sum(x * np.sin(2 * np.pi * f * t) for f, x in ((20, 1), (40, 0.8), (60, 0.6))) + rng.normal(0, 0.05, len(t))
    b = sum(x * np.cos(2 * np.pi * f * t) for f, x in ((20, 0.7), (40, 0.5), (60, 0.4))) + rng.normal(0, 0.05, len(t))
    dirty = base + 0.9 * a + 0.6 * b
    _, want = S.window_psd(base, 512.0, 512, 8192)
    _, raw = S.window_psd(dirty, 512.0, 512, 8192)
    _, clean = S.clean_spectra(dirty, np.stack([a, b], axis=1), 512.0, 512, 8192)
    assert (clean >= 0).all() and abs(clean.sum() - want.sum()) < 0.35 * abs(raw.sum() - want.sum())


@pytest.mark.parametrize("eps", [1e-9, 1e-8, 1e-7, 1e-6, 1e-5, 1e-4, 1e-3])
@pytest.mark.parametrize("speed", [0.6, 0.7])
def test_epsilon_of_a_nasmyth_spectrum(eps, speed):
    k = np.linspace(0, 256, 1025) / speed
    phi = np.where(k > 0, S.nasmyth(np.maximum(k, 1e-9), eps, 1e-6), 0)
    got, k_max, mad = S.estimate_epsilon(k, phi, speed, is_wavenumber=True, correct=False)
    assert abs(math.log10(got / eps)) < 0.15 and k_max <= 150.1 and mad < 0.2


def test_epsilon_of_missing_input():
    f = np.linspace(0, 100, 65)
    assert all(math.isnan(x) for x in S.estimate_epsilon(f, np.full(65, np.nan), 0.7))
    assert all(math.isnan(x) for x in S.estimate_epsilon(f, np.ones(65), float("nan")))


def test_unresolved_variance_is_a_fixed_point():
    eps = S.whole_variance(1e-8, 60.0)
    assert S.nasmyth_resolved(60.0, eps, 1e-6) * eps == pytest.approx(1e-8, rel=0.02)


def test_peaks_on_plateaus_and_by_distance():
    x = np.array([0, 1, 3, 3, 3, 1, 0, 2, 0, 5, 0.0])
    assert P.find_peaks(x).tolist() == [3, 7, 9]
    assert P.find_peaks(x, distance=4).tolist() == [3, 9]
    assert P.find_peaks(x, height=3).tolist() == [3, 9]
    assert P.find_peaks(x, prominence=4).tolist() == [9]


def test_peaks_are_those_of_the_definition():
    """Prominence and width by scanning the whole series for each peak."""
    rng = np.random.default_rng(11)

    def plain(x, height, distance, prominence, width):
        tops = [i for i in range(1, len(x) - 1) if x[i] > x[i - 1] and x[i] > x[i + 1] and x[i] >= height]
        for i in sorted(tops, key=lambda i: (-x[i], -i)):
            if i in tops:
                tops = [j for j in tops if j == i or abs(j - i) >= distance]
        out = []
        for i in tops:
            a = max([j for j in range(i) if x[j] > x[i]], default=-1) + 1
            z = min([j for j in range(i + 1, len(x)) if x[j] > x[i]], default=len(x)) - 1
            rise = x[i] - max(x[a : i + 1].min(), x[i : z + 1].min())
            level = x[i] - rise / 2
            low, high = [j for j in range(a, i) if x[j] < level], [j for j in range(i + 1, z + 1) if x[j] < level]
            left = low[-1] + (level - x[low[-1]]) / (x[low[-1] + 1] - x[low[-1]]) if low else a
            right = high[0] - (level - x[high[0]]) / (x[high[0] - 1] - x[high[0]]) if high else z
            if rise >= prominence and right - left >= width:
                out.append(i)
        return out

    for _ in range(60):
        x = np.cumsum(rng.normal(size=rng.integers(3, 400)))
        args = float(rng.normal()), int(rng.integers(1, 20)), float(rng.uniform(0, 4)), float(rng.uniform(0, 10))
        assert P.find_peaks(x, *args).tolist() == plain(x, *args)


def test_peaks_of_a_long_noisy_series_are_found_in_linear_time():
    import time

    x = np.random.default_rng(12).normal(size=400_000) + np.linspace(0, 100, 400_000)
    began = time.perf_counter()
    P.find_peaks(x, 0.0, None, 0.5, 1.0)
    assert time.perf_counter() - began < 30
