"""Counts to physical units, as column expressions.

A channel's coefficients are either a Python dict, known when the plan is built,
or a map column that a join with the setup table brings along, so that one plan
converts files with different setups. ``CONVERTERS`` maps a channel type to
(expression, units); ``convert`` dispatches on a known type, ``convert_by_type``
on a type column. Register further types in ``CONVERTERS``.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Calibrated range of shear probe sensitivities (V s / m).
SHEAR_SENSITIVITY = (0.03, 0.15)
#: Standard gravity that accelerometer calibrations use.
GRAVITY = 9.81


class Coefficients:
    """Numbers by name from a dict or a map<string,string> column."""

    def __init__(self, source: Mapping | Column):
        self.source = source

    def has(self, name: str) -> Column:
        if isinstance(self.source, Column):
            return F.map_contains_key(self.source, name)
        return F.lit(name in self.source)

    def number(self, name: str, default: float | None = None) -> Column:
        """The number, or the default; without default a missing one is an error
        when the source is a dict and null when it is a column."""
        if isinstance(self.source, Column):
            value = F.try_element_at(self.source, F.lit(name)).try_cast("double")
            return value if default is None else F.coalesce(value, F.lit(float(default)))
        if name in self.source:
            return F.lit(float(self.source[name]))
        if default is None:
            raise ValueError(f"parameter {name} is missing")
        return F.lit(float(default))

    def known(self, name: str) -> float | None:
        """The number if it is known now."""
        return float(self.source[name]) if not isinstance(self.source, Column) and name in self.source else None

    def series(self, names: list[str], gap_ends: bool) -> Column:
        """Array of the numbers that are there, in order; up to the first gap, or all."""
        if not isinstance(self.source, Column):
            own = []
            for n in names:
                if n in self.source:
                    own.append(F.lit(float(self.source[n])))
                elif gap_ends:
                    break
            if not own:
                raise ValueError(f"no polynomial coefficient among {names}")
            return F.array(*own)
        every = F.array(*(self.number(n) for n in names))
        if gap_ends:
            gap = F.array_position(F.transform(every, lambda x: x.isNull()), F.lit(True))
            every = F.slice(every, F.lit(1), F.when(gap == 0, F.lit(len(names))).otherwise(gap - 1).cast("int"))
        present = F.filter(every, lambda x: x.isNotNull())
        return F.when(F.size(present) > 0, present)


def polynomial(coefficients: Column, x: Column) -> Column:
    """Horner evaluation of ascending coefficients."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * x + c)


def horner(coefficients: list[Column], x: Column) -> Column:
    """Horner evaluation of ascending coefficients, unrolled into one expression."""
    value = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        value = value * x + c
    return value


def unsigned16(x: Column) -> Column:
    return F.when(x < 0, x + F.lit(65536)).otherwise(x)


def volts(x: Column, p: Coefficients) -> Column:
    return x * p.number("adc_fs") / F.pow(F.lit(2.0), p.number("adc_bits")) + p.number("adc_zero", 0)


def _poly(x, p):
    return polynomial(p.series([f"coef{i}" for i in range(10)], gap_ends=True), x.cast("double"))


def _shear(x, p):
    sens = p.number("sens")
    known = p.known("sens")
    if known == 0:
        warnings.warn("shear probe has sens=0, its values are NaN", stacklevel=3)
    elif known is not None and not SHEAR_SENSITIVITY[0] <= known <= SHEAR_SENSITIVITY[1]:
        warnings.warn(f"shear probe sens={known:g} is outside the calibrated range", stacklevel=3)
    scale = 2 * F.sqrt(F.lit(2.0)) * p.number("diff_gain") * F.nullif(sens, F.lit(0.0))
    return F.when(sens == 0, F.lit(float("nan"))).otherwise(p.number("adc_fs") / F.pow(F.lit(2.0), p.number("adc_bits")) * x / scale)


def _piezo(x, p):
    return x - p.number("a_0", 0)


def thermistor_log_ratio(z: Column) -> Column:
    """ln of the resistance ratio, the bridge reading kept within 0.6."""
    z = F.greatest(F.least(z, F.lit(0.6)), F.lit(-0.6))
    return F.ln((1 - z) / (1 + z))


def _therm(x, p):
    z = (x - p.number("a")) / p.number("b") * (p.number("adc_fs") / F.pow(F.lit(2.0), p.number("adc_bits"))) * 2 / (p.number("g") * p.number("e_b"))
    log_r = thermistor_log_ratio(z)
    if isinstance(p.source, Column):
        beta = F.coalesce(p.number("beta"), p.number("beta_1"))
        second = F.coalesce(log_r * log_r / p.number("beta_2"), F.lit(0.0))
        third = F.when(p.has("beta_2"), F.coalesce(log_r * log_r * log_r / p.number("beta_3"), F.lit(0.0))).otherwise(0.0)
        inverse = 1 / p.number("t_0") + log_r / beta + second + third
    else:
        if not {"beta", "beta_1"} & set(p.source):
            raise ValueError("thermistor has neither beta nor beta_1")
        inverse = 1 / p.number("t_0") + log_r / p.number("beta" if "beta" in p.source else "beta_1")
        if "beta_2" in p.source:
            inverse = inverse + log_r * log_r / p.number("beta_2")
            if "beta_3" in p.source:
                inverse = inverse + log_r * log_r * log_r / p.number("beta_3")
    return 1 / inverse - 273.15


def _ucond(x, p):
    v = p.number("adc_fs", 1) / F.pow(F.lit(2.0), p.number("adc_bits", 0)) * x + p.number("adc_zero", 0)
    return (v - p.number("a")) / p.number("b") / p.number("k") * 10


def _accel(x, p):
    return F.lit(GRAVITY) * (volts(x, p) - p.number("sig_zero", 0) - p.number("coef0")) / p.number("coef1")


def _voltage(x, p):
    return volts(x, p) / p.number("g", 1)


def _magn(x, p):
    return (x - p.number("coef0")) / p.number("coef1")


def _jac_t(x, p):
    return polynomial(p.series(list("abcdef"), gap_ends=False), unsigned16(x).cast("double"))


def _jac_c(x, p):
    word = x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    low = word.bitwiseAND(F.lit(0xFFFF).cast("long"))
    ratio = F.shiftright(word, 16) / F.when(low == 0, F.lit(1)).otherwise(low)
    return horner([p.number("a"), p.number("b"), p.number("c")], ratio)


def _sbt(x, p):
    """A count of 0 has no frequency: null. Coefficients given as text count as numbers."""
    f = F.try_divide(p.number("coef6") * p.number("coef5"), x.cast("double"))
    return F.try_divide(F.lit(1.0), horner([p.number(f"coef{i}") for i in range(4)], F.ln(F.try_divide(p.number("coef4"), f)))) - 273.15


def _sbc(x, p):
    f = F.try_divide(p.number("coef6") * p.number("coef5"), x.cast("double")) / 1000
    return horner([p.number(f"coef{i}") for i in range(5)], f)


def _counts(x, p):
    return x


def adis_flags(x: Column) -> tuple[Column, Column]:
    """(old data, error) flags of an ADIS16209 word read as signed 16 bits."""
    fresh = _adis_fresh(x)
    return x >= 0, fresh >= 16384


def _adis_fresh(x: Column) -> Column:
    return F.when(x < -16384, x + 32768).otherwise(x)


def adis_extract(x: Column, kind: str = "xy") -> Column:
    """Inclination (14-bit signed) or temperature (12-bit unsigned) of a word."""
    v = _adis_fresh(x)
    v = F.when(v >= 16384, v - 16384).otherwise(v)
    if kind == "xy":
        return F.when(v >= 8192, v - 16384).otherwise(v)
    if kind == "t":
        return v.cast("int").bitwiseAND(0x0FFF)
    raise ValueError(f"unknown kind {kind!r}")


def _inclxy(x, p):
    return p.number("coef1", 1) * adis_extract(x, "xy") + p.number("coef0", 0)


def _inclt(x, p):
    return p.number("coef1", -0.47) * adis_extract(x, "t") + p.number("coef0", 624)


def _alec_emc(x, p):
    return p.number("coef1") * x + p.number("coef0")


def _vector(x, p):
    return (volts(x, p) - p.number("offset")) * p.number("sens") - p.number("bias", 0)


def _aem1g_a(x, p):
    if (b := p.known("b")) is not None and b / 100 < 1:
        warnings.warn("a and b may not be right for analog output", stacklevel=3)
    return p.number("a") / 100 + p.number("b") / 100 * volts(x, p) - p.number("bias", 0)


def _aem1g_d(x, p):
    if (b := p.known("b")) is not None and b / 100 > 1:
        warnings.warn("a and b may not be right for digital output", stacklevel=3)
    return p.number("a") / 100 + p.number("b") / 100 * unsigned16(x)


def _jac_emc(x, p):
    warnings.warn("type jac_emc is deprecated, use aem1g_a", DeprecationWarning, stacklevel=3)
    return _aem1g_a(x, p)


Converter = Callable[[Column, Coefficients], Column]
#: Channel types and their units; None takes the channel's own.
CONVERTERS: dict[str, tuple[Converter, str | None]] = {
    "poly": (_poly, None), "shear": (_shear, "m^2 s^-3"), "piezo": (_piezo, "counts"), "therm": (_therm, "C"), "ucond": (_ucond, "mS/cm"),
    "accel": (_accel, "m/s^2"), "voltage": (_voltage, "V"), "magn": (_magn, "µT"), "jac_t": (_jac_t, "C"), "jac_c": (_jac_c, "mS/cm"),
    "sbt": (_sbt, "C"), "sbc": (_sbc, "mS/cm"), "raw": (_counts, "counts"), "gnd": (_counts, "counts"), "inclxy": (_inclxy, "deg"), "inclt": (_inclt, "C"),
    "alec_emc": (_alec_emc, "m/s"), "vector": (_vector, "m/s"), "aem1g_a": (_aem1g_a, "m/s"), "aem1g_d": (_aem1g_d, "m/s"), "jac_emc": (_jac_emc, "m/s"),
}
#: Other names of types.
ALIASES = {"xmp_shear": "shear", "xmp_pres": "poly", "t_ms": "therm", "c_ms": "ucond", "xmp_therm": "therm", "xmp_volt": "poly"}


def units_of(kind: str, params: Mapping | None = None) -> str:
    own = CONVERTERS[ALIASES.get(kind, kind)][1]
    return own if own is not None else str((params or {}).get("units", "")).removeprefix("[").removesuffix("]")


def channel_units(kind: str | None, own: str | None) -> str:
    """Units of a channel's values after ``convert_by_type``, where its type may be
    unknown; own is what its section says."""
    known = ALIASES.get(kind or "", kind or "") in CONVERTERS
    return units_of(kind, {"units": own or ""}) if known else "counts"


def convert(x: Column, kind: str, params: Mapping | Column) -> Column:
    """x in physical units by the converter of a type."""
    if (own := ALIASES.get(kind.lower(), kind.lower())) not in CONVERTERS:
        raise ValueError(f"unknown channel type {kind!r}")
    return CONVERTERS[own][0](x, Coefficients(params)).cast("double")


def convert_by_type(x: Column, kind: Column, params: Column, kinds: Sequence[str] | None = None) -> Column:
    """x in physical units where the type is a column; unknown types and missing
    coefficients leave the counts as they are. ``kinds`` names the types that can
    occur, which keeps the expression small."""
    kind = F.lower(kind)
    out = F.lit(None).cast("double")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for name in [*CONVERTERS, *ALIASES] if kinds is None else [k for k in kinds if k in CONVERTERS or k in ALIASES]:
            out = F.when(kind == name, convert(x, name, params)).otherwise(out)
    return F.coalesce(out, x.cast("double"))
