"""Hydrography of windows and fine bins: temperature, salinity, density, N2.

Practical salinity is PSS-78; the rest is TEOS-10, but for the regional anomaly of
absolute salinity, whose atlas is not here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics
from .align import interpolate
from .windows import first_valid, real

#: Vehicles that stay at one position during a cast.
STATIONARY = ("vmp", "rvmp", "xmp")


def is_stationary(vehicle: Column, override: bool | None = None) -> Column:
    if override is not None:
        return F.lit(override)
    return F.coalesce(F.lower(F.trim(vehicle)).isin(*STATIONARY), F.lit(False))


def scalar_position(samples: DataFrame, keys: Sequence[str], lat: str = "aux_latitude", lon: str = "aux_longitude") -> DataFrame:
    """(keys, lat, lon): the first valid position of each profile."""
    return samples.groupBy(*keys).agg(first_valid(lat).alias("lat"), first_valid(lon).alias("lon"))


def hydrography(means: DataFrame, keys: Sequence[str], pressure: str = "P_smooth", temperature: str = "JAC_T", default_temperature: float = 10.0, default_salinity: float = 35.0, default_density: float = 1025.0, latitude: float = 45.0, kinematics: bool = True, speed: str = "W_smooth", thermo: bool = False) -> DataFrame:
    """Window or bin means with pressure, z, temperature, salinity, density,
    conductivity, and W, nu, lat, lon, absolute_salinity,
    conservative_temperature, potential_density where asked for or possible.

    Each of temperature, salinity and density comes from the auxiliary series if
    there is one, else from the CTD, else it is the default. CTD salinity needs a
    median conductivity of the profile over 10 mS/cm.
    """
    has = set(means.columns)
    profile = Window.partitionBy(*keys)
    nothing = F.lit(None).cast("double")
    measured = temperature in has
    from_sensor = "JAC_C" in has and measured and "aux_salinity" not in has
    # in steps, so that each formula is evaluated once and reads plain columns
    out = means.withColumns({
        "__p": real(pressure) if pressure in has else nothing,
        "__t": real(temperature) if measured else F.lit(default_temperature),
        "__c": real("JAC_C") if "JAC_C" in has else nothing,
        "__tv": real("aux_temperature") if "aux_temperature" in has else real(temperature) if measured else F.lit(default_temperature),
    }).withColumn("__p0", F.coalesce("__p", F.lit(0.0)))
    if from_sensor:
        out = out.withColumn("__wet", F.coalesce(F.median("__c").over(profile) > 10, F.lit(False)))
        out = out.withColumn("__sk", F.when(F.col("__wet"), physics.practical_salinity(F.col("__c"), F.col("__t"), F.col("__p0"))))
        out = out.withColumn("__s", F.when(F.col("__wet"), F.col("__sk")).otherwise(F.lit(default_salinity)))
    else:
        out = out.withColumn("__sk", real("aux_salinity") if "aux_salinity" in has else nothing)
        out = out.withColumn("__s", F.col("__sk") if "aux_salinity" in has else F.lit(default_salinity))
    if "aux_density" in has:
        out = out.withColumn("__rk", real("aux_density")).withColumn("__rho", F.col("__rk"))
    elif from_sensor:
        out = out.withColumn("__sa", physics.absolute_salinity(F.col("__sk")))
        out = out.withColumn("__ct", physics.conservative_temperature(F.col("__sa"), F.col("__t"), F.col("__p0")))
        out = out.withColumn("__rk", physics.density(F.col("__sa"), F.col("__ct"), F.col("__p0")))
        out = out.withColumn("__rho", F.when(F.col("__wet"), F.col("__rk")).otherwise(F.lit(default_density)))
    else:
        out = out.withColumn("__rk", nothing).withColumn("__rho", F.lit(default_density))
    lat = F.lit(latitude)
    if "aux_latitude" in has:
        lat = real("aux_latitude")
    new = {"pressure": F.col("__p"), "temperature": F.col("__tv"), "salinity": F.col("__sk"), "density": F.col("__rk"), "z": -physics.depth(F.col("__p"), lat)}
    if "JAC_C" in has:
        new["conductivity"] = F.col("__c")
    if kinematics:
        new["W"] = real(speed) if speed in has else nothing
        new["nu"] = physics.viscosity(F.col("__s"), F.col("__tv"), F.col("__rho"))[0]
    if "aux_latitude" in has:
        new["lat"] = lat
    if "aux_longitude" in has:
        new["lon"] = real("aux_longitude")
    whole_sea = thermo and (measured or "aux_temperature" in has)
    if whole_sea:
        new["absolute_salinity"] = physics.absolute_salinity(F.col("__sk"))
    out = out.withColumns(new)
    if whole_sea:
        out = out.withColumn("conservative_temperature", physics.conservative_temperature(F.col("absolute_salinity"), F.col("temperature"), F.col("pressure")))
        out = out.withColumn("potential_density", physics.density(F.col("absolute_salinity"), F.col("conservative_temperature"), 0.0))
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def buoyancy_frequency(df: DataFrame, keys: Sequence[str], index: str, salinity: str = "absolute_salinity", temperature: str = "conservative_temperature", pressure: str = "pressure", latitude: float = 45.0, out: str = "N2") -> DataFrame:
    """df with N2 from neighbouring valid bins in index order, taken at their
    middle pressures and interpolated to each bin's own pressure; null outside,
    and where a profile has less than two valid bins. Gravity is that of lat
    where df has it."""
    own = {"__sa": real(salinity), "__ct": real(temperature), "__p": real(pressure)}
    valid = df.withColumns(own).where("__sa IS NOT NULL AND __ct IS NOT NULL AND __p IS NOT NULL")
    lat = F.coalesce(real("lat"), F.lit(latitude)) if "lat" in df.columns else F.lit(latitude)
    order = Window.partitionBy(*keys).orderBy(index)
    own = valid.select(*keys, index, "__sa", "__ct", "__p", physics.gravity(F.col("__p"), lat).alias("__g"))
    names = ("__sa", "__ct", "__p", "__g")
    pairs = own.select(*keys, *names, *(F.lead(c).over(order).alias(f"{c}2") for c in names)).where("__p2 IS NOT NULL")
    mids = pairs.select(*keys, *(((F.col(c) + F.col(f"{c}2")) / 2).alias(c) for c in names), *((F.col(f"{c}2") - F.col(c)).alias(f"d{c}") for c in names[:3]))
    n2 = physics.squared_buoyancy(F.col("__sa"), F.col("__ct"), F.col("__p"), F.col("d__sa"), F.col("d__ct"), F.col("d__p"), F.col("__g"))
    found = interpolate(own.select(*keys, index, "__p"), mids.select(*keys, "__p", n2.alias(out)), [out], keys, "__p", extrapolate=False)
    return df.join(found.select(*keys, index, out), [*keys, index], "left")
