"""Jobs from raw files to the gridded product.

Level 0: instrument files. Level 1: a folder with ``slow``, ``fast`` and ``files``
tables, partitioned by file. Level 2: dissipation windows and fine CTD bins by
(file_id, profile_index). Level 3: the depth grid. Jobs write Parquet; a file or
profile that fails becomes a row of the status table, not an exception.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calibration import channel_units, convert_by_type
from ..operators import align, binning, profiles, quality, series, spectra, thermo, windows
from ..sources import matfile, pfile
from .attributes import described
from .config import ProfileConfig

KEYS = ("file_id", "profile_index")
#: Variables of level 1 unless others are asked for.
LEVEL1 = ("P", "sh1", "sh2", "gradT1", "gradT2", "U_EM", "EMC_Cur", "EM_Cur", "JAC_T", "JAC_C", "T1", "T2", "Ax", "Ay", "Az", "Incl_X", "Incl_Y", "Incl_T")
#: Types that are left out, and counts that are always kept.
SKIPPED_TYPES, KEPT_COUNTS = ("gnd", "raw"), ("EMC_Cur", "EM_Cur")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _compression(codec: str | None, level: int | None) -> dict[str, str]:
    own = {"compression": codec} if codec else {}
    return own | {"parquet.compression.codec.zstd.level": str(level)} if level is not None else own


def file_id(path: str = "path"):
    """A file's name without folder and suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def convert(spark: SparkSession, path: str | Sequence[str], output: str, variables: Sequence[str] | None = None, exclude_types: Sequence[str] = SKIPPED_TYPES, overwrite: bool = False, min_file_size: int = 100_000, compression: str | None = None, despike: Mapping | None = None, gradient: str = "high_pass", compression_level: int | None = None) -> DataFrame:
    """Level 0 to 1: decode, calibrate, deconvolve, differentiate, write. Returns
    (file_id, error). Existing output is an error unless overwrite is set. The level
    is that of zstd."""
    if not overwrite and _there(spark, f"{output}/files"):
        raise FileExistsError(output)
    heads = pfile.read_headers(spark, path, min_file_size).withColumn("file_id", file_id())
    sections = pfile.setup_sections(heads.where("error IS NULL").select("file_id", "setup"), "file_id")
    params = pfile.channel_params(sections, "file_id").withColumn("type", F.lower(F.coalesce(F.try_element_at("params", F.lit("type")), F.lit(""))))
    info = sections.where("section = 'instrument_info'").groupBy("file_id").agg(F.min_by("params", "section_idx").alias("info"))
    counts = pfile.read_channels(spark, path, min_file_size, tuple(exclude_types), KEPT_COUNTS).withColumn("file_id", file_id()).drop("path")
    used = params.where(~F.col("type").isin(*exclude_types) | F.col("channel").isin(*KEPT_COUNTS))
    named = counts.join(used, ["file_id", "channel"])
    kinds = sorted(r["type"] for r in used.select("type").distinct().collect())  # channel types: a few dozen at most
    rates = heads.where("error IS NULL").select("file_id", "fs_fast", "fs_slow", F.col("n_rows").alias("__rows"))

    # pre-emphasised channels X_dX: their signal, and the gradient of thermistors
    base = F.regexp_extract("channel", r"^(\w+)_d\1$", 1)
    pre = named.where(F.map_contains_key("params", "diff_gain") & ~F.col("type").isin("shear", "xmp_shear")).withColumn("base", base).where("base <> ''")
    slow_of = named.select("file_id", F.col("channel").alias("base"), "i", F.col("count").alias("low"), F.col("params").alias("base_params"))
    hires = _deconvolved(pre.join(rates, "file_id"), slow_of, used, kinds, gradient)

    kept = named.where(~F.map_contains_key("params", "diff_gain") | F.col("type").isin("shear", "xmp_shear"))
    physical = kept.select("file_id", "channel", "i", F.when(F.col("type").isin(*SKIPPED_TYPES), F.col("count").cast("double")).otherwise(convert_by_type(F.col("count"), F.col("type"), F.col("params"), kinds)).alias("value"))
    replaced = hires.where("channel = 'P'").select("file_id").distinct().withColumn("__new", F.lit(True))
    physical = physical.join(replaced, "file_id", "left").withColumn("channel", F.when((F.col("channel") == "P") & F.col("__new"), "P_raw").otherwise(F.col("channel"))).drop("__new")
    long = physical.unionByName(hires)
    wanted = list(variables or LEVEL1)
    long = long.where(F.col("channel").isin(*wanted))
    size = long.groupBy("file_id", "channel").agg((F.max("i") + 1).alias("n"))
    most = size.groupBy("file_id").agg(F.max("n").alias("most"))
    placed = long.join(size.join(most, "file_id").select("file_id", "channel", (F.col("n") == F.col("most")).alias("is_fast")), ["file_id", "channel"])

    def table(fast: bool) -> DataFrame:
        wide = placed.where("is_fast" if fast else "NOT is_fast").groupBy("file_id", "i").pivot("channel", wanted).agg(F.first("value").cast("float"))
        rate = F.col("fs_fast" if fast else "fs_slow")
        return wide.join(rates.drop("__rows"), "file_id").withColumn("t", F.col("i") / rate)

    fast = table(True)
    if despike is not None:
        fast = series.despike(fast, ["file_id"], [v for v in ("sh1", "sh2", "gradT1", "gradT2") if v in wanted], "fs_fast", **despike)
    get = lambda k: F.try_element_at("info", F.lit(k))
    files = heads.where("error IS NULL").join(info, "file_id", "left").select("file_id", F.col("path").alias("source_file"), "filetime", "fs_fast", "fs_slow", "header_version", "n_rows", "fast_cols", "slow_cols", get("vehicle").alias("instrument_vehicle"), get("model").alias("instrument_model"), get("sn").alias("instrument_sn"), "setup")
    mode = "overwrite" if overwrite else "errorifexists"
    options = _compression(compression, compression_level)
    own = used.groupBy("channel").agg(F.min_by("type", "file_id").alias("type"), F.min_by(F.try_element_at("params", F.lit("units")), "file_id").alias("units"))
    units = {r["channel"]: channel_units(r["type"], r["units"]) for r in own.collect()}  # a row for each channel name
    for name, df in (("fast", fast.drop("fs_fast", "fs_slow")), ("slow", table(False).drop("fs_fast", "fs_slow")), ("files", files)):
        described(df, units).write.mode(mode).options(**options).partitionBy("file_id").parquet(f"{output}/{name}")
    return heads.select("file_id", "error")


def import_mat(spark: SparkSession, path: str | Sequence[str], output: str, overwrite: bool = False, compression: str | None = None, compression_level: int | None = None) -> DataFrame:
    """MATLAB cast files as a level-1 folder. Returns (file_id, error). Such files
    have no start time and no instrument: filetime and the instrument's columns are null."""
    if not overwrite and _there(spark, f"{output}/files"):
        raise FileExistsError(output)
    fast, slow, files = matfile.level1(spark, path)
    empty = {"filetime": F.lit(None).cast("timestamp_ntz")} | {f"instrument_{c}": F.lit(None).cast("string") for c in ("vehicle", "model", "sn")}
    mode, options = "overwrite" if overwrite else "errorifexists", _compression(compression, compression_level)
    known = files.where("error IS NULL").drop("error").withColumns(empty)
    for name, df in (("fast", fast), ("slow", slow), ("files", known)):
        described(df).write.mode(mode).options(**options).partitionBy("file_id").parquet(f"{output}/{name}")
    return files.select("file_id", "error")


def _deconvolved(pre: DataFrame, low: DataFrame, params: DataFrame, kinds: Sequence[str], gradient: str) -> DataFrame:
    """(file_id, channel, i, value) of the high-resolution signals, calibrated as
    their base channels, and of the gradients of thermistors. A pre-emphasised
    pressure takes the place of P."""
    import numpy as np
    import pyarrow as pa

    from ..functions import kernels

    joined = pre.select("file_id", "base", "type", "params", "i", "count", "fs_fast").join(low.select("file_id", "base", "i", "low", "base_params"), ["file_id", "base", "i"], "left")
    schema = "file_id string, base string, type string, i long, counts double, rate double"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        own = dict(table.column("params")[0].as_py() or [])
        slow = series.values_of(table, "low")
        slow = slow[~np.isnan(slow)]
        x, fs = series.values_of(table, "count"), table.column("fs_fast")[0].as_py()
        counts, rate = x, np.full(len(x), np.nan)
        try:
            counts = kernels.deconvolve(x, fs, float(own["diff_gain"]), slow if len(slow) > 1 else None)
            kind = str(own.get("type", "")).lower()
            if kind in ("therm", "t_ms", "xmp_therm"):
                first = next((dict(v.as_py()) for v in table.column("base_params") if v.as_py() is not None), {})
                rate = kernels.temperature_gradient(x, {**first, **own}, fs, gradient, counts)
        except (ValueError, KeyError, np.linalg.LinAlgError):
            pass
        return pa.table({"file_id": table.column("file_id"), "base": table.column("base"), "type": table.column("type"), "i": table.column("i"), "counts": counts, "rate": rate})

    found = joined.groupBy("file_id", "base").applyInArrow(run, schema)
    base = params.select("file_id", F.col("channel").alias("base"), F.col("type").alias("base_type"), F.col("params").alias("base_params"))
    both = found.join(base, ["file_id", "base"], "left")
    value = convert_by_type(F.col("counts"), F.coalesce("base_type", F.col("type")), F.coalesce("base_params", F.create_map().cast("map<string,string>")), kinds)
    name = F.when(F.col("base") == "P", "P").otherwise(F.concat("base", F.lit("_hires")))
    signal = both.select("file_id", name.alias("channel"), "i", value.alias("value"))
    slopes = both.where(~F.isnan("rate")).select("file_id", F.concat(F.lit("grad"), "base").alias("channel"), "i", F.col("rate").alias("value"))
    return signal.unionByName(slopes)


def read_level1(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fast, slow, files) of a level-1 folder."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("fast", "slow", "files"))


def prepared(slow: DataFrame, config: ProfileConfig, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """slow, which has fs_slow, with smoothed pressure and speed. A file for which
    that fails has nulls there, and what went wrong in the column error."""
    pitch = config.pitch if config.use_pitch_correction and config.pitch in slow.columns else None
    return series.smooth_slow(slow, keys, "fs_slow", config.pressure, config.speed, config.pressure_smoothing_period, config.filter_order, pitch, config.angle_of_attack, config.dbar_to_m, config.gap_threshold, config.gap_factor, error="error")


def index_profiles(slow: DataFrame, config: ProfileConfig, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """The profile table of prepared slow samples."""
    return profiles.profile_index(slow, keys, config.pressure_smooth, direction=config.profile_direction, min_pressure=config.min_profile_pressure, peaks=config.peaks_kwargs, gap=config.gap_threshold, factor=config.gap_factor)


def attach_auxiliary(slow: DataFrame, files: DataFrame, aux: DataFrame, config: ProfileConfig) -> DataFrame:
    """slow with aux_* columns, interpolated onto absolute sample times. aux has
    the time in aux_time, as a timestamp, and serves all files."""
    stamp = dict(aux.dtypes).get(config.aux_time, "")
    if not stamp.startswith("timestamp"):
        raise ValueError(f"auxiliary table needs a timestamp column {config.aux_time!r}")
    named = [(config.aux_latitude, "aux_latitude"), (config.aux_longitude, "aux_longitude"), (config.aux_temperature, "aux_temperature"), (config.aux_salinity, "aux_salinity"), (config.aux_density, "aux_density")]
    named = [(a, b) for a, b in named if a and a in aux.columns]
    epoch = F.unix_micros(F.col("filetime").cast("timestamp")) / 1e6
    timed = slow.join(files.select("file_id", epoch.alias("__epoch")), "file_id").withColumn("__at", F.col("__epoch") + F.col("t"))
    points = aux.select((F.unix_micros(F.col(config.aux_time).cast("timestamp")) / 1e6).alias("__at"), *(F.col(a).alias(b) for a, b in named))
    spans = timed.groupBy("file_id").agg(F.min("__at").alias("first"), F.max("__at").alias("last"))
    variables = [b for _, b in named]
    own = align.near(points, spans, variables, ["file_id"], "__at")
    return align.interpolate(timed, own, variables, ["file_id"], "__at").drop("__at", "__epoch")


def _of_profiles(samples: DataFrame, table: DataFrame) -> DataFrame:
    """The samples of the profiles, their index from 0 in each profile."""
    own = windows.samples_of(samples, table, ["file_id"])
    first = own.groupBy(*KEYS).agg(F.min("i").alias("__i0"))
    return own.join(first, list(KEYS)).withColumn("i", F.col("i") - F.col("__i0")).drop("__i0")


def spectra_of_profiles(fast: DataFrame, table: DataFrame, config: ProfileConfig) -> DataFrame:
    """``spectra.profile_spectra`` of the profiles of a profile table; fast has the
    rates and window sizes of its file."""
    refs = [*(config.accel_channels if config.accel_clean else ()), *(config.emc_channels if config.emc_clean else ())]
    options = {"max_passes": config.despike_max_passes, "thresh": config.despike_thresh, "smooth": config.despike_smooth, "replace_sec": config.despike_replace_sec}
    return spectra.profile_spectra(windows.samples_of(fast, table, ["file_id"]), KEYS, config.all_probes, config.shear_probes, refs, config.shear_cutoff, config.chop_start, config.force_despike, options)


def hydrography_of_profiles(slow: DataFrame, fast: DataFrame, table: DataFrame, config: ProfileConfig) -> tuple[DataFrame, DataFrame | None]:
    """(scalars of the dissipation windows, fine CTD bins) of the profiles of a
    profile table, from prepared slow samples. Both sample tables have the rates
    and window sizes of their file; of fast only the times are read."""
    own = _of_profiles(slow, table)
    whole = F.floor(windows.kept_samples(F.col("__fast"), F.col("n_diss"), F.col("n_fft"), F.col("ratio")) / F.col("ratio"))
    quick = windows.samples_of(fast.select("file_id", "t", "n_fft", "n_diss", "ratio"), table, ["file_id"])
    sized = quick.groupBy(*KEYS, "n_fft", "n_diss", "ratio").agg(F.count("*").alias("__fast")).select(*KEYS, whole.alias("__slow"))
    if config.match_conductivity and {"JAC_C", config.temperature} <= set(own.columns):
        own = series.match_conductivity(own, KEYS, "fs_slow", speed=config.speed_smooth, lag=config.jac_lag, cutoff=config.jac_f_tc, reference=config.jac_reference_speed)
    own = windows.trim_windows(own.join(sized, list(KEYS)), KEYS, "n_diss_slow", "n_fft_slow", config.chop_start, keep=F.col("__slow")).drop("__slow")
    own = own.withColumns({"__still": F.col("stationary").cast("double"), "__ctd": F.greatest(F.lit(1), F.bround(config.ctd_bin_sec * F.col("fs_slow"), 0).cast("int"))})

    scalars = [v for v in ("t", config.pressure_smooth, config.speed_smooth, config.temperature, "JAC_C", "aux_latitude", "aux_longitude", "aux_temperature", "aux_salinity", "aux_density") if v in own.columns]
    options = {"pressure": config.pressure_smooth, "temperature": config.temperature, "speed": config.speed_smooth, "default_temperature": config.default_temperature, "default_salinity": config.default_salinity, "default_density": config.default_density, "latitude": config.default_latitude, "thermo": config.compute_thermo}
    # a platform that stays has one position, that of its first sample with one
    here = [v for v in ("aux_latitude", "aux_longitude") if v in own.columns]
    if len(here) == 2:
        spots = thermo.scalar_position(own.where("stationary"), KEYS)
        own = own.join(spots, list(KEYS), "left").withColumns({a: F.when(F.col("stationary"), F.col(b)).otherwise(F.col(a)) for a, b in zip(here, ("lat", "lon"), strict=True)}).drop("lat", "lon")
    means = windows.window_mean(own, KEYS, [*scalars, "__still"], "n_fft_slow", "n_diss_slow").withColumn("stationary", F.col("__still") > 0.5).drop("__still")
    scalar = thermo.hydrography(means, KEYS, **options).withColumnRenamed("t", "time")
    deep = {"latitude": config.default_latitude}
    if config.compute_thermo and "potential_density" in scalar.columns:
        scalar = thermo.buoyancy_frequency(scalar, KEYS, "win", **deep)
    if config.ctd_bin_sec <= 0 or not {config.temperature, "JAC_C"} & set(own.columns):
        return scalar, None
    blocks = windows.block_mean(own, KEYS, scalars, "__ctd")
    fine = thermo.hydrography(blocks, KEYS, kinematics=False, **options)
    if config.compute_thermo and "potential_density" in fine.columns:
        fine = thermo.buoyancy_frequency(fine, KEYS, "b", **deep)
    keep = [c for c in ("pressure", "z", "temperature", "salinity", "density", "conductivity", "lat", "lon", "absolute_salinity", "conservative_temperature", "potential_density", "N2") if c in fine.columns]
    return scalar, fine.select(*KEYS, "b", F.col("t").alias("ctd_time"), *(F.col(c).cast("float").alias(f"{c}_hires") for c in keep))


def dissipation(scalar: DataFrame, power: DataFrame, files: DataFrame, config: ProfileConfig) -> tuple[DataFrame, DataFrame]:
    """(windows, spectra over wavenumber) from the windows' scalars and their spectra
    over frequency."""
    speed = scalar.select(*KEYS, "win", F.col("W").cast("float").cast("double").alias("W"), F.col("nu").cast("float").cast("double").alias("nu"))
    power = power.join(speed, [*KEYS, "win"]).withColumn("psd", spectra.to_wavenumber(F.col("psd"), F.col("W"), F.col("probe"))).withColumn("k", F.transform("frequency", lambda f: F.try_divide(f, F.col("W"))))
    dof = files.select("file_id", F.sqrt(quality.degrees_of_freedom(F.col("n_fft"), F.col("n_diss"))).alias("__dof"))
    fits = power.join(dof, "file_id").withColumn("fit", F.when(F.col("probe").startswith("sh"), spectra.epsilon(F.col("frequency"), F.col("psd"), F.col("W"), F.col("nu"))))
    mine = lambda p, c: F.max(F.when(F.col("probe") == p, c))
    parts = [mine(p, F.col("spikes")).alias(f"{p}_despike_frac") for p in config.all_probes]
    for p in config.shear_probes:
        parts += [mine(p, windows.real("fit.eps")).alias(f"eps_{p[-1]}"), mine(p, windows.real("fit.k_max")).alias(f"k_max_{p[-1]}"), mine(p, windows.real("fit.mad") * F.col("__dof")).alias(f"eps_{p[-1]}_fm")]
    out = scalar.join(fits.groupBy(*KEYS, "win").agg(*parts), [*KEYS, "win"], "left")
    for p in config.shear_probes:
        n = p[-1]
        flag = quality.compose_flag(F.col(f"eps_{n}"), F.col(f"eps_{n}_fm"), F.col("W") < config.min_speed, F.col(f"{p}_despike_frac"), (config.fm_good, config.fm_bad), (config.despike_frac_questionable, config.despike_frac_bad))
        out = out.withColumn(f"eps_{n}_qc", flag)
    return out.drop("stationary", "aux_latitude", "aux_longitude", "aux_temperature", "aux_salinity", "aux_density"), power.drop("nu")


def _stamped(df: DataFrame, config: ProfileConfig) -> DataFrame:
    from .. import __version__

    return df.withColumns({"processed": F.lit(dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")), "version": F.lit(__version__), "config": F.lit(config.to_yaml())})


def without_existing(spark: SparkSession, files: DataFrame, output: str) -> DataFrame:
    """files less those with output: some output file_id begins with their own."""
    if not _there(spark, f"{output}/windows"):
        return files
    return align.without_prefixed(files, "file_id", spark.read.parquet(f"{output}/windows"), "file_id")


def _indexed(spark: SparkSession, ready: DataFrame, config: ProfileConfig, path: str, mode: str) -> DataFrame:
    """The profile table of prepared samples, written and read again: the samples of
    both rates are cut by it, and peaks are looked for once."""
    return _written(spark, _stamped(index_profiles(ready.where("error IS NULL"), config), config), path, mode)


def _written(spark: SparkSession, df: DataFrame, path: str, mode: str) -> DataFrame:
    """df, written by file and read again; without rows there may be no file."""
    df.write.mode(mode).partitionBy("file_id").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def compute_epsilon(spark: SparkSession, level1: str, output: str, config: ProfileConfig | None = None, aux: DataFrame | None = None, overwrite: bool = False, skip_existing: bool = False) -> DataFrame:
    """Level 1 to 2. Returns the status table (file_id, profile_index, windows,
    error): a row for each profile, and one without profile for a file that fails
    before it has any."""
    config = config or ProfileConfig()
    fast, slow, files = read_level1(spark, level1)
    if skip_existing:
        files = without_existing(spark, files, output)
    mode = "overwrite" if overwrite else "append" if skip_existing else "errorifexists"
    still = thermo.is_stationary(F.col("instrument_vehicle"), config.stationary_platform)
    files = windows.with_window_sizes(files, config.fft_len_sec, config.diss_len_sec).withColumn("stationary", still)
    rates = files.select("file_id", "fs_fast", "fs_slow", "n_fft", "n_diss", "n_fft_slow", "n_diss_slow", "ratio", "stationary")
    fast, slow = fast.join(rates, "file_id"), slow.join(rates, "file_id")
    ready = prepared(slow, config)
    broken = ready.groupBy("file_id").agg(F.max("error").alias("error")).where("error IS NOT NULL")
    if aux is not None:
        ready = attach_auxiliary(ready, files, aux, config)
    table = _indexed(spark, ready, config, f"{output}/profiles", mode).join(files.select("file_id"), "file_id", "left_semi")

    raw = _written(spark, spectra_of_profiles(fast, table, config), f"{output}/frequency_spectra", mode).join(files.select("file_id"), "file_id", "left_semi")
    scalar, fine = hydrography_of_profiles(ready, fast, table, config)
    out, power = dissipation(scalar, raw.where("error IS NULL").drop("error"), files, config)
    info = files.select("file_id", "source_file", "instrument_vehicle", "instrument_sn", "filetime")
    described(_stamped(out.join(info, "file_id"), config)).write.mode(mode).partitionBy("file_id").parquet(f"{output}/windows")
    described(power.drop("spikes")).write.mode(mode).partitionBy("file_id").parquet(f"{output}/spectra")
    if fine is not None:
        described(fine).write.mode(mode).partitionBy("file_id").parquet(f"{output}/ctd")

    status = raw.groupBy(*KEYS).agg(F.count_distinct("win").alias("windows"), F.max("error").alias("error"))
    status = table.select(*KEYS).join(status, list(KEYS), "left").withColumn("windows", F.coalesce("windows", F.lit(0)))
    none = files.select("file_id").join(table, "file_id", "left_anti").join(broken, "file_id", "left")
    none = none.select("file_id", F.lit(None).cast("long").alias("profile_index"), F.lit(0).cast("long").alias("windows"), F.coalesce("error", F.lit("file has no samples")).alias("error"))
    return status.unionByName(none)


def index_job(spark: SparkSession, level1: str, output: str, config: ProfileConfig | None = None, overwrite: bool = False, materialize: bool = False, compression: str | None = None, compression_level: int | None = None) -> DataFrame:
    """The profile table of level 1, and the samples of each profile if asked for. A
    file that fails has a row without profile_index that says what went wrong."""
    config = config or ProfileConfig()
    fast, slow, files = read_level1(spark, level1)
    mode = "overwrite" if overwrite else "errorifexists"
    ready = prepared(slow.join(files.select("file_id", "fs_slow"), "file_id"), config).drop("fs_slow")
    table = _indexed(spark, ready, config, f"{output}/profiles", mode)
    if materialize:
        options = _compression(compression, compression_level)
        for name, df in (("slow", ready.drop("error")), ("fast", fast)):
            described(windows.samples_of(df, table, ["file_id"])).write.mode(mode).options(**options).partitionBy(*KEYS).parquet(f"{output}/hires_{name}")
    broken = ready.groupBy("file_id").agg(F.max("error").alias("error")).where("error IS NOT NULL")
    return table.withColumn("error", F.lit(None).cast("string")).unionByName(broken, allowMissingColumns=True)


def bin_job(spark: SparkSession, level2: str, output: str | None = None, overwrite: bool = False, low: float = 0.0, high: float = 1000.0, width: float = 2.0, variables: Sequence[str] | None = None, latitude: float = 45.0, questionable: float = 1e-7, bad: float = 1e-9, ctd_width: float | None = None) -> DataFrame:
    """Level 2 to 3: the depth grid of all profiles."""
    out = spark.read.parquet(f"{level2}/windows")
    absolute = F.unix_micros(F.col("filetime").cast("timestamp")) / 1e6 + F.col("time")
    ctd = spark.read.parquet(f"{level2}/ctd") if _there(spark, f"{level2}/ctd") else None
    made = binning.bin_product(out.withColumn("time", absolute), KEYS, low, high, width, variables, latitude, questionable, bad, ctd, ctd_width)
    grid, fine = made if isinstance(made, tuple) else (made, None)
    info = out.select("file_id", "instrument_sn", "instrument_vehicle").distinct()
    grid = described(grid.join(F.broadcast(info) if info.count() < 100_000 else info, "file_id", "left"))
    if output:
        mode = "overwrite" if overwrite else "errorifexists"
        grid.write.mode(mode).parquet(f"{output}/binned")
        if fine is not None:
            described(fine).write.mode(mode).parquet(f"{output}/binned_ctd")
    return grid


def merge_job(spark: SparkSession, level1: Sequence[str], output: str, overwrite: bool = False, dry_run: bool = False) -> DataFrame:
    """Level-1 folders as one file with absolute times, in the order of names.
    With dry_run nothing is written, and the sizes are returned."""
    tables = [read_level1(spark, p) for p in sorted(level1)]
    sizes = None
    for n, name in enumerate(("fast", "slow")):
        both = None
        for fast_slow_files in tables:
            files = fast_slow_files[2].select("file_id", (F.unix_micros(F.col("filetime").cast("timestamp")) / 1e6).alias("__epoch"))
            df = fast_slow_files[n].join(files, "file_id")
            both = df if both is None else both.unionByName(df, allowMissingColumns=True)
        size = both.groupBy("file_id").agg(F.count("*").alias("samples")).withColumn("table", F.lit(name))
        sizes = size if sizes is None else sizes.unionByName(size)
        if not dry_run:
            one = align.concatenate(both, ["file_id"], "__epoch").drop("__epoch").withColumnRenamed("file_id", "source_file").withColumn("file_id", F.lit("merged"))
            one.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("file_id").parquet(f"{output}/{name}")
    if not dry_run:
        first = tables[0][2].orderBy("file_id").limit(1).withColumn("source_file", F.lit("merged")).withColumn("filetime", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).withColumn("file_id", F.lit("merged"))
        first.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("file_id").parquet(f"{output}/files")
    return sizes


def parse_list(text: str, flag: str, fields: Mapping[str, type]) -> dict:
    """'a,b,c' as typed values by field; ValueError for a wrong count or value."""
    parts = [p.strip() for p in re.split(",", text)]
    if len(parts) != len(fields):
        raise ValueError(f"{flag} needs {len(fields)} values: {', '.join(fields)}")
    try:
        return {name: kind(p) for (name, kind), p in zip(fields.items(), parts, strict=True)}
    except ValueError as e:
        raise ValueError(f"{flag}: {e}") from e
