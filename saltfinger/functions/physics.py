"""Physical models as column expressions; those that kernels share take arrays too."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def viscosity(salinity: Number, temperature: Number, density: Number) -> tuple[Column, Column]:
    """(kinematic, dynamic) viscosity of sea water (Millero 1974)."""
    s, t, rho = _c(salinity), _c(temperature), _c(density)
    fresh = 1.002e-3 * F.pow(F.lit(10.0), (1.1709 * (20 - t) - 1.827e-3 * (t - 20) * (t - 20)) / (t + 89.93))
    mu = fresh * (1 + (2.5116e-6 + 1.2199e-6 * t) * F.sqrt(rho * s) + (1.4342e-6 + 1.8267e-8 * t) * rho * s)
    return mu / rho, mu


def _apply(name: str, x):
    """A function of that name of columns or of arrays."""
    return getattr(F if isinstance(x, Column) else np, name)(x)


def nasmyth(k, eps, nu=1e-6):
    """Nasmyth shear spectrum at wavenumber k (cpm), of columns or arrays."""
    x = k * (nu**3 / eps) ** 0.25
    return eps**0.75 / nu**0.25 * 8.05 * x**0.33333333 / (1 + (20.6 * x) ** 3.715)


def nasmyth_resolved(k_max, eps, nu=1e-6):
    """Share of the Nasmyth variance below k_max, of columns or numbers."""
    x = (k_max * (nu**3 / eps) ** 0.25) ** 1.3333333
    return _apply("tanh", 48 * x) - 2.9 * x * _apply("exp", -22.3 * x)


def kraichnan(k: Number, chi: Number, eps: Number, nu: Number = 1e-6, kappa: Number = 1.4e-7, q: Number = 5.26) -> Column:
    """Kraichnan spectrum of the temperature gradient."""
    k, chi, eps, nu, kappa, q = map(_c, (k, chi, eps, nu, kappa, q))
    batchelor = F.pow(eps / nu / (kappa * kappa), F.lit(0.25))
    return 2 * math.pi * k * chi * F.sqrt(nu / eps) * q * F.exp(-F.sqrt(6 * q) * 2 * math.pi * k / batchelor)


def single_pole(k, k0: float = 48.0, k_max: float = 150.0):
    """Shear probe wavenumber correction, of columns or arrays."""
    over = 1 + (k / k0) * (k / k0)
    return F.when(k <= k_max, over).otherwise(F.lit(1.0)) if isinstance(k, Column) else np.where(k <= k_max, over, 1.0)


def _flicker(f: Column, knee: float) -> Column:
    return F.sqrt(1 + (f / knee) * (f / knee)) / (f / knee)


def _anti_alias(f: Column, cutoff: float) -> Column:
    one = 1 + F.pow(f / cutoff, F.lit(8.0))
    return 1 / (one * one)


def noise_shear(f: Number, kelvin: float = 295.0, boltzmann: float = 1.382e-23, full_scale: float = 4.096, bits: int = 16, gamma: float = 2.5, fs: float = 512.0, r1: float = 1e9, c1: float = 1.5e-9, r2: float = 499.0, c2: float = 0.94e-6, r3: float = 1e6, c3: float = 470e-12, probe: float = 0.0, f_aa: float = 110.0, volts: float = 9e-9, knee: float = 50.0, amps: float = 0.56e-15) -> Column:
    """Electronic noise of a shear channel (counts^2/Hz): charge amplifier,
    differentiator, anti-alias filter, sampler."""
    f = _c(f)
    w = 2 * math.pi * f
    square = lambda x: x * x
    step = full_scale / 2**bits
    charge = 1 + square(w * (r1 * c1))
    amplifier = volts**2 * _flicker(f, knee)
    first = (1 + square(w * (r1 * (probe + c1)))) / charge * (amplifier + amps**2 * r1**2 / charge) + 4 * boltzmann * kelvin * r1 / charge
    gain = square(w * (r3 * c2)) / ((1 + square(w * (r2 * c2))) * (1 + square(w * (r3 * c3))))
    return ((first + amplifier) * gain * _anti_alias(f, f_aa) + gamma * step**2 / (12 * (fs / 2))) / step**2


def noise_therm(f: Number, kelvin: float = 295.0, boltzmann: float = 1.382e-23, full_scale: float = 4.096, bits: int = 16, gamma: float = 3.0, fs: float = 512.0, r0: float = 3000.0, gain: float = 6.0, g_d: float = 0.94, f_aa: float = 110.0, volts: float = 4e-9, knee: float = 18.7, volts2: float = 8e-9, knee2: float = 42.0) -> Column:
    """Electronic noise of a thermistor channel (counts^2/Hz): bridge and first
    amplifier, pre-emphasis, anti-alias filter, sampler."""
    f = _c(f)
    step = full_scale / 2**bits
    first = gain**2 * (2 * volts**2 * _flicker(f, knee) + 4 * boltzmann * r0 * kelvin)
    w = 2 * math.pi * g_d * f
    second = (1 + w * w) * (first + 2 * volts2**2 * _flicker(f, knee2))
    return (second * _anti_alias(f, f_aa) + gamma * step**2 / (12 * (fs / 2))) / step**2


def practical_salinity(conductivity: Number, temperature: Number, pressure: Number) -> Column:
    """PSS-78 salinity from conductivity (mS/cm), temperature (ITS-90), pressure (dbar)."""
    t, p = _c(temperature) * 1.00024, _c(pressure)
    ratio = _c(conductivity) / 42.914
    r_t = 0.6766097 + t * (2.00564e-2 + t * (1.104259e-4 + t * (-6.9698e-7 + t * 1.0031e-9)))
    r_p = 1 + p * (2.070e-5 + p * (-6.370e-10 + p * 3.989e-15)) / (1 + t * (3.426e-2 + t * 4.464e-4) + (0.4215 - 3.107e-3 * t) * ratio)
    q = F.sqrt(ratio / (r_p * r_t))
    base = _series(q, [0.0080, -0.1692, 25.3851, 14.0941, -7.0261, 2.7081])
    shift = _series(q, [0.0005, -0.0056, -0.0066, -0.0375, 0.0636, -0.0144])
    return base + (t - 15) / (1 + 0.0162 * (t - 15)) * shift


def _series(x: Column, ascending: list[float]) -> Column:
    value = F.lit(ascending[-1])
    for c in reversed(ascending[:-1]):
        value = value * x + c
    return value


# Sea water by TEOS-10 (www.teos-10.org); its formulas are public.

#: Scales of the polynomials' arguments, heat capacity, standard ocean.
_SALT, _SALT_SHIFT, _CP0, _SSO = 0.0248826675584615, 0.5971840214030754, 3991.86795711963, 35.16504
#: The 75 terms of specific volume by powers of (salinity, temperature, pressure).
VOLUME = {
    (0, 0, 0): 1.0769995862e-3, (1, 0, 0): -3.1038981976e-4, (2, 0, 0): 6.6928067038e-4, (3, 0, 0): -8.5047933937e-4, (4, 0, 0): 5.8086069943e-4, (5, 0, 0): -2.1092370507e-4, (6, 0, 0): 3.1932457305e-5,
    (0, 1, 0): -1.5649734675e-5, (1, 1, 0): 3.5009599764e-5, (2, 1, 0): -4.3592678561e-5, (3, 1, 0): 3.4532461828e-5, (4, 1, 0): -1.1959409788e-5, (5, 1, 0): 1.3864594581e-6,
    (0, 2, 0): 2.7762106484e-5, (1, 2, 0): -3.7435842344e-5, (2, 2, 0): 3.5907822760e-5, (3, 2, 0): -1.8698584187e-5, (4, 2, 0): 3.8595339244e-6,
    (0, 3, 0): -1.6521159259e-5, (1, 3, 0): 2.4141479483e-5, (2, 3, 0): -1.4353633048e-5, (3, 3, 0): 2.2863324556e-6,
    (0, 4, 0): 6.9111322702e-6, (1, 4, 0): -8.7595873154e-6, (2, 4, 0): 4.3703680598e-6, (0, 5, 0): -8.0539615540e-7, (1, 5, 0): -3.3052758900e-7, (0, 6, 0): 2.0543094268e-7,
    (0, 0, 1): -6.0799143809e-5, (1, 0, 1): 2.4262468747e-5, (2, 0, 1): -3.4792460974e-5, (3, 0, 1): 3.7470777305e-5, (4, 0, 1): -1.7322218612e-5, (5, 0, 1): 3.0927427253e-6,
    (0, 1, 1): 1.8505765429e-5, (1, 1, 1): -9.5677088156e-6, (2, 1, 1): 1.1100834765e-5, (3, 1, 1): -9.8447117844e-6, (4, 1, 1): 2.5909225260e-6,
    (0, 2, 1): -1.1716606853e-5, (1, 2, 1): -2.3678308361e-7, (2, 2, 1): 2.9283346295e-6, (3, 2, 1): -4.8826139200e-7, (0, 3, 1): 7.9279656173e-6, (1, 3, 1): -3.4558773655e-6, (2, 3, 1): 3.1655306078e-7,
    (0, 4, 1): -3.4102187482e-6, (1, 4, 1): 1.2956717783e-6, (0, 5, 1): 5.0736766814e-7,
    (0, 0, 2): 9.9856169219e-6, (1, 0, 2): -5.8484432984e-7, (2, 0, 2): -4.8122251597e-6, (3, 0, 2): 4.9263106998e-6, (4, 0, 2): -1.7811974727e-6,
    (0, 1, 2): -1.1736386731e-6, (1, 1, 2): -5.5699154557e-6, (2, 1, 2): 5.4620748834e-6, (3, 1, 2): -1.3544185627e-6, (0, 2, 2): 2.1305028740e-6, (1, 2, 2): 3.9137387080e-7, (2, 2, 2): -6.5731104067e-7,
    (0, 3, 2): -4.6132540037e-7, (1, 3, 2): 7.7618888092e-9, (0, 4, 2): -6.3352916514e-8,
    (0, 0, 3): -1.1309361437e-6, (1, 0, 3): 3.6310188515e-7, (2, 0, 3): 1.6746303780e-8, (0, 1, 3): -3.6527006553e-7, (1, 1, 3): -2.7295696237e-7, (0, 2, 3): 2.8695905159e-7,
    (0, 0, 4): 1.0531153080e-7, (1, 0, 4): -1.1147125423e-7, (0, 1, 4): 3.1454099902e-7, (0, 0, 5): -1.2647261286e-8, (0, 0, 6): 1.9613503930e-9,
}
#: Enthalpy of conservative temperature by powers of (root of salinity, temperature).
ENTHALPY = {
    (0, 0): 61.01362420681071, (0, 1): 168776.46138048015, (0, 2): -2735.2785605119625, (0, 3): 2574.2164453821433, (0, 4): -1536.6644434977543, (0, 5): 545.7340497931629, (0, 6): -50.91091728474331, (0, 7): -18.30489878927802,
    (2, 0): 268.5520265845071, (2, 1): -12019.028203559312, (2, 2): 3734.858026725145, (2, 3): -2046.7671145057618, (2, 4): 465.28655623826234, (2, 5): -0.6370820302376359, (2, 6): -10.650848542359153,
    (3, 0): 937.2099110620707, (3, 1): 588.1802812170108, (3, 2): 248.39476522971285, (3, 3): -3.871557904936333, (3, 4): -2.6268019854268356,
    (4, 0): -1687.914374187449, (4, 1): 936.3206544460336, (4, 2): -942.7827304544439, (4, 3): 369.4389437509002, (4, 4): -33.83664947895248, (4, 5): -9.987880382780322,
    (5, 0): 246.9598888781377, (6, 0): 123.59576582457964, (7, 0): -48.5891069025409,
}
#: Entropy less its terms of salinity alone, by powers of (root of salinity, temperature, pressure).
ENTROPY = {
    (0, 0, 1): -270.983805184062, (0, 0, 2): 776.153611613101, (0, 0, 3): -196.51255088122, (0, 0, 4): 28.9796526294175, (0, 0, 5): -2.13290083518327,
    (0, 1, 0): -24715.571866078, (0, 1, 1): 2910.0729080936, (0, 1, 2): -1513.116771538718, (0, 1, 3): 546.959324647056, (0, 1, 4): -111.1208127634436, (0, 1, 5): 8.68841343834394,
    (0, 2, 0): 2210.2236124548363, (0, 2, 1): -2017.52334943521, (0, 2, 2): 1498.081172457456, (0, 2, 3): -718.6359919632359, (0, 2, 4): 146.4037555781616, (0, 2, 5): -4.9892131862671505,
    (0, 3, 0): -592.743745734632, (0, 3, 1): 1591.873781627888, (0, 3, 2): -1207.261522487504, (0, 3, 3): 608.785486935364, (0, 3, 4): -105.4993508931208,
    (0, 4, 0): 290.12956292128547, (0, 4, 1): -973.091553087975, (0, 4, 2): 602.603274510125, (0, 4, 3): -276.361526170076, (0, 4, 4): 32.40953340386105,
    (0, 5, 0): -113.90630790850321, (0, 5, 1): 381.06836198507096, (0, 5, 2): -133.7383902842754, (0, 5, 3): 49.023632509086724, (0, 6, 0): 21.35571525415769, (0, 6, 1): -67.41756835751434,
    (2, 0, 1): 729.116529735046, (2, 0, 2): -343.956902961561, (2, 0, 3): 124.687671116248, (2, 0, 4): -31.656964386073, (2, 0, 5): 7.04658803315449,
    (2, 1, 0): 1760.062705994408, (2, 1, 1): -1721.528607567954, (2, 1, 2): 674.819060538734, (2, 1, 3): -356.629112415276, (2, 1, 4): 88.4080716616, (2, 1, 5): -15.84003094423364,
    (2, 2, 0): -675.802947790203, (2, 2, 1): 2082.7344423998043, (2, 2, 2): -614.668925894709, (2, 2, 3): 340.685093521782, (2, 2, 4): -33.3848202979239,
    (2, 3, 0): 365.7041791005036, (2, 3, 1): -1190.914967948748, (2, 3, 2): 298.904564555024, (2, 3, 3): -145.9491676006352, (2, 4, 0): -108.30162043765552, (2, 5, 0): 12.78101825083098,
    (3, 0, 1): -175.292041186547, (3, 0, 2): 83.1923927801819, (3, 0, 3): -29.483064349429,
    (3, 1, 0): -86.1329351956084, (3, 1, 1): 766.116132004952, (3, 1, 2): -108.3834525034224, (3, 1, 3): 51.2796974779828,
    (3, 2, 0): -30.0682112585625, (3, 2, 1): -1380.9597954037708, (3, 3, 0): 3.50240264723578, (3, 3, 1): 938.26075044542,
    (4, 0, 1): -22.6683558512829, (4, 1, 0): -137.1145018408982, (4, 2, 0): 148.10030845687618, (4, 3, 0): -68.5590309679152, (4, 4, 0): 12.4848504784754,
}


def _nested(terms: dict[tuple[int, ...], float], *x):
    """Sum of c * x0^i * x1^j * ... in Horner form, of columns or numbers."""
    if not x:
        return next(iter(terms.values()))
    by: dict[int, dict] = {}
    for powers, c in terms.items():
        by.setdefault(powers[-1], {})[powers[:-1]] = c
    out = None
    for n in range(max(by), -1, -1):
        inner = _nested(by[n], *x[:-1]) if n in by else 0.0
        out = inner if out is None else out * x[-1] + inner
    return out


def absolute_salinity(salinity: Number) -> Column:
    """Absolute salinity (g/kg) without the regional anomaly, whose atlas is not here."""
    return _c(salinity) * (_SSO / 35)


def _on_arrays(fn):
    """fn of arrays as a function of columns, by Arrow batches. Formulas of hundreds of
    terms are slow to plan as columns, and are asked of windows and bins only."""

    def three(a, b, c):
        return pd.Series(fn(*(v.to_numpy(float) for v in (a, b, c))))

    def seven(a, b, c, d, e, f, g):
        return pd.Series(fn(*(v.to_numpy(float) for v in (a, b, c, d, e, f, g))))

    def run(*values: Number) -> Column:
        udf = F.pandas_udf(three if len(values) == 3 else seven, "double")
        return F.nanvl(udf(*(_c(v).cast("double") for v in values)), F.lit(None).cast("double"))

    return run


def _entropy_part(sa, t, p):
    return _nested(ENTROPY, (_SALT * sa) ** 0.5, t * 0.025, p * 1e-4) * -0.025


def _conservative_temperature(sa, t, p):
    pt, entropy = t, _entropy_part(sa, t, p)
    for _ in range(5):
        slope = _CP0 / ((273.15 + pt) * (1 - 0.05 * (1 - sa / _SSO)))
        pt = pt - (_entropy_part(sa, pt, p * 0) - entropy) / slope
    return _nested(ENTHALPY, (_SALT * sa) ** 0.5, pt * 0.025) / _CP0


def _volume_arguments(sa, ct, p):
    return (_SALT * sa + _SALT_SHIFT) ** 0.5, ct * 0.025, p * 1e-4


def conservative_temperature(sa: Number, t: Number, p: Number) -> Column:
    """Conservative temperature of absolute salinity, in-situ temperature and
    pressure. The potential temperature with the same entropy comes by Newton steps
    with the heat capacity's approximate slope; five reach the last digits."""
    return _on_arrays(_conservative_temperature)(sa, t, p)


def density(sa: Number, ct: Number, p: Number) -> Column:
    """In-situ density (kg/m^3) of absolute salinity, conservative temperature and pressure."""
    return _on_arrays(lambda sa, ct, p: 1 / _nested(VOLUME, *_volume_arguments(sa, ct, p)))(sa, ct, p)


def _surface_gravity(latitude: Number) -> Column:
    sine = F.sin(F.radians(_c(latitude)))
    x = sine * sine
    return 9.780327 * (1 + (5.2792e-3 + 2.32e-5 * x) * x)


def depth(pressure: Number, latitude: Number) -> Column:
    """Depth (m, positive down) from pressure (dbar) at the standard ocean."""
    g = _surface_gravity(latitude)
    enthalpy = 1e8 * _series(_c(pressure) * 1e-4, [0.0, 9.726613854843870e-4, -2.252956605630465e-5, 2.376909655387404e-6, -1.664294869986011e-7, -5.988108894465758e-9, -2.1078768810e-9, 2.8019291329e-10])
    return 2 * enthalpy / (g + F.sqrt(g * g + 2 * 2.26e-7 * g * enthalpy))


def gravity(pressure: Number, latitude: Number) -> Column:
    return _surface_gravity(latitude) * (1 + 2.26e-7 * depth(pressure, latitude))


#: Slopes of the volume's terms by their first and second argument.
_BY_ROOT = {(i - 1, j, k): c * i for (i, j, k), c in VOLUME.items() if i}
_BY_HEAT = {(i, j - 1, k): c * j for (i, j, k), c in VOLUME.items() if j}


def _squared_buoyancy(sa, ct, p, d_sa, d_ct, d_p, g):
    own = _volume_arguments(sa, ct, p)
    change = _nested(_BY_ROOT, *own) * (_SALT / 2) / own[0] * d_sa + _nested(_BY_HEAT, *own) * 0.025 * d_ct
    return -g * g * change / (_nested(VOLUME, *own) ** 2 * np.where(d_p == 0, np.nan, d_p) * 1e4)


def squared_buoyancy(sa: Number, ct: Number, p: Number, d_sa: Number, d_ct: Number, d_p: Number, g: Number) -> Column:
    """N^2 (1/s^2) from middle values and steps of a pair of neighbours."""
    return _on_arrays(_squared_buoyancy)(sa, ct, p, d_sa, d_ct, d_p, g)
