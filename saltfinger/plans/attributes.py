"""What a column of the products means: standard name, long name and units.

``described`` puts them on a DataFrame as column metadata, which Parquet files keep
and ``describe`` reads back. Columns of raw channels that are not in the table take
the units of their own setup section.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (standard name or None, long name, units) of level-1 variables.
LEVEL1 = {
    "P": ("sea_water_pressure", "Pressure", "dbar"),
    "P_raw": ("sea_water_pressure", "Raw pressure (without pre-emphasis)", "dbar"),
    "sh1": (None, "Velocity time derivative from probe 1", "m2 s-3"),
    "sh2": (None, "Velocity time derivative from probe 2", "m2 s-3"),
    "gradT1": (None, "Temperature time derivative from thermistor 1", "K s-1"),
    "gradT2": (None, "Temperature time derivative from thermistor 2", "K s-1"),
    "U_EM": (None, "EM current meter velocity", "m s-1"),
    "EMC_Cur": (None, "EM current meter driving current", "counts"),
    "EM_Cur": (None, "EM current meter driving current", "counts"),
    "JAC_T": ("sea_water_temperature", "JAC CT temperature", "degree_C"),
    "JAC_C": ("sea_water_electrical_conductivity", "JAC CT conductivity", "mS cm-1"),
    "T1": ("sea_water_temperature", "FP07 thermistor 1 temperature", "degree_C"),
    "T2": ("sea_water_temperature", "FP07 thermistor 2 temperature", "degree_C"),
    "Ax": (None, "Acceleration X", "m s-2"),
    "Ay": (None, "Acceleration Y", "m s-2"),
    "Az": (None, "Acceleration Z", "m s-2"),
    "Incl_X": (None, "Inclinometer X angle", "degree"),
    "Incl_Y": (None, "Inclinometer Y angle", "degree"),
    "t": (None, "Time since the start of the file", "s"),
}
#: Names, units and flags of what the jobs derive.
DERIVED = {
    "time": (None, "Time of the window since the start of the file", "s"),
    "ctd_time": (None, "Time of the fine bin since the start of the file", "s"),
    "pressure": ("sea_water_pressure", "Pressure", "dbar"),
    "W": (None, "Speed through the water", "m s-1"),
    "nu": (None, "Kinematic viscosity", "m2 s-1"),
    "temperature": ("sea_water_temperature", "Temperature", "degree_C"),
    "salinity": ("sea_water_practical_salinity", "Practical salinity", "1"),
    "density": ("sea_water_density", "Density", "kg m-3"),
    "conductivity": ("sea_water_electrical_conductivity", "Conductivity", "mS cm-1"),
    "absolute_salinity": ("sea_water_absolute_salinity", "Absolute salinity", "g kg-1"),
    "conservative_temperature": ("sea_water_conservative_temperature", "Conservative temperature", "degree_C"),
    "potential_density": ("sea_water_potential_density", "Potential density", "kg m-3"),
    "N2": ("square_of_brunt_vaisala_frequency_in_sea_water", "Squared buoyancy frequency", "s-2"),
    "z": ("height_above_mean_sea_level", "Height", "m"),
    "depth": ("depth", "Middle of the depth bin", "m"),
    "ctd_depth": ("depth", "Middle of the fine depth bin", "m"),
    "lat": ("latitude", "Latitude", "degree_north"),
    "lon": ("longitude", "Longitude", "degree_east"),
    "eps": (None, "Dissipation rate, both probes", "W kg-1"),
    "profile_time": ("time", "Start of the profile since 1970-01-01", "s"),
    "psd": (None, "Power spectral density over wavenumber", "s-2 m"),
    "frequency": (None, "Frequency", "Hz"),
    "k": (None, "Wavenumber", "m-1"),
}
#: What a quality flag says.
FLAGS = {1: "good", 2: "questionable", 4: "bad", 9: "missing"}


def of_column(name: str, units: Mapping[str, str] | None = None) -> dict:
    """The attributes of a column; empty if nothing is known of it."""
    if name.endswith("_qc"):
        return {"long_name": f"Quality flag of {name.removesuffix('_qc')}", "flag_values": list(FLAGS), "flag_meanings": " ".join(FLAGS.values())}
    base = name.removesuffix("_hires")
    if known := {**LEVEL1, **DERIVED}.get(base):
        standard, long_name, unit = known
        return ({"standard_name": standard} if standard else {}) | {"long_name": long_name, "units": unit}
    for tail, long_name, unit in (("_despike_frac", "Share of despiked samples of {}", "1"), ("_despike_mask", "Despiked samples of {}", "1"), ("_fm", "Figure of merit of {}", "1"), ("_clean", "Cleaned {}", "")):
        if base.endswith(tail):
            own = of_column(base.removesuffix(tail), units)
            return {"long_name": long_name.format(base.removesuffix(tail)), "units": unit or own.get("units", "")}
    if base.startswith(("eps_", "k_max_")):
        head, _, probe = base.rpartition("_")
        return {"long_name": f"{'Dissipation rate' if head == 'eps' else 'Greatest wavenumber of the fit'} of shear probe {probe}", "units": "W kg-1" if head == "eps" else "m-1"}
    return {"long_name": name, "units": units[name]} if units and name in units else {}


def described(df: DataFrame, units: Mapping[str, str] | None = None) -> DataFrame:
    """df with the attributes of its columns as their metadata. Attributes that a
    column has already stay."""
    out = []
    for field in df.schema:
        own = of_column(field.name, units) | (field.metadata or {})
        c = F.col(f"`{field.name}`")
        out.append(c.alias(field.name, metadata=own) if own else c)
    return df.select(*out)


def describe(df: DataFrame) -> dict[str, dict]:
    """The attributes of each column that has some."""
    return {f.name: dict(f.metadata) for f in df.schema if f.metadata}
