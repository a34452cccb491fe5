"""Command line: p2l1, mat, cut, eps, profiles, bin, merge. Errors end with status 1."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from . import __version__
from .plans import jobs
from .plans.config import ProfileConfig
from .sources import pfile


def session(name: str):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _profile_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--direction", choices=("down", "up", "both"), default="down")
    p.add_argument("--min-profile-pressure", type=float, default=0.0)
    p.add_argument("--peaks", help="height,distance,width,prominence")
    p.add_argument("--pressure-smoothing", type=float, default=0.5)
    p.add_argument("--speed", default="W")
    p.add_argument("--aoa", type=float, default=3.0)
    p.add_argument("--pitch-correction", action="store_true")


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="saltfinger", description="Ocean microstructure on Spark")
    main.add_argument("-v", "--version", action="version", version=__version__)
    main.add_argument("-l", "--log-level", default="info")
    commands = main.add_subparsers(dest="command", required=True)

    p = commands.add_parser("p2l1", help="instrument files to level 1")
    p.add_argument("files", nargs="+")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--compress", metavar="CODEC", nargs="?", const="zstd")
    p.add_argument("--compression-level", type=int, help="of zstd")
    p.add_argument("--min-file-size", type=int, default=100_000)
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--despike", help="passes,thresh,smooth,replace_sec")

    p = commands.add_parser("mat", help="MATLAB cast files to level 1")
    p.add_argument("files", nargs="+")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--compress", metavar="CODEC", nargs="?", const="zstd")
    p.add_argument("--compression-level", type=int, help="of zstd")
    p.add_argument("--overwrite", action="store_true")

    p = commands.add_parser("cut", help="copy a range of records")
    p.add_argument("input")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--start", type=int, default=0)
    p.add_argument("--n-records", type=int, default=60)

    p = commands.add_parser("eps", help="level 1 to dissipation rates")
    p.add_argument("level1")
    p.add_argument("-o", "--output", required=True)
    _profile_options(p)
    p.add_argument("--diss-len", type=float, default=4.0)
    p.add_argument("--fft-len", type=float, default=1.0)
    p.add_argument("--min-speed", type=float, default=0.2)
    p.add_argument("--temperature", default="JAC_T")
    p.add_argument("--aux", help="Parquet table with a timestamp column")
    for name, default in (("time", "time"), ("lat", "lat"), ("lon", "lon"), ("temp", None), ("sal", None), ("dens", None)):
        p.add_argument(f"--aux-{name}", default=default)
    p.add_argument("--despike", help="passes,thresh,smooth,replace_sec; despikes again")
    p.add_argument("--accel-clean", action=argparse.BooleanOptionalAction, default=False)
    p.add_argument("--emc-clean", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--thermo", action="store_true")
    p.add_argument("--match-conductivity", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--ctd-bin-sec", type=float, default=0.25)
    where = p.add_mutually_exclusive_group()
    where.add_argument("--stationary", dest="stationary", action="store_true", default=None)
    where.add_argument("--moving", dest="stationary", action="store_false")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--skip-existing", action="store_true")

    p = commands.add_parser("profiles", help="profile table of level 1")
    p.add_argument("level1")
    p.add_argument("-o", "--output", required=True)
    _profile_options(p)
    p.add_argument("--materialize", action="store_true")
    p.add_argument("--compress", metavar="CODEC", nargs="?", const="zstd")
    p.add_argument("--compression-level", type=int, help="of zstd")
    p.add_argument("--overwrite", action="store_true")

    p = commands.add_parser("bin", help="dissipation rates to the depth grid")
    p.add_argument("level2")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--dmin", type=float, default=0.0)
    p.add_argument("--dmax", type=float, default=1000.0)
    p.add_argument("--bin-width", type=float, default=2.0)
    p.add_argument("--ctd-bin-width", type=float)
    p.add_argument("--lat", type=float, default=45.0)
    p.add_argument("--vars", help="comma-separated names")
    p.add_argument("--qc-thresh", default="1e-7,1e-9", help="questionable,bad")
    p.add_argument("--overwrite", action="store_true")

    p = commands.add_parser("merge", help="level-1 folders to one")
    p.add_argument("level1", nargs="+")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    return main


DESPIKE = {"max_passes": int, "thresh": float, "smooth": float, "replace_sec": float}
PEAKS = {"height": float, "distance": float, "width": float, "prominence": float}


def config_of(a: argparse.Namespace) -> ProfileConfig:
    """The settings that the options of eps or profiles ask for."""
    own: dict = {"profile_direction": a.direction, "min_profile_pressure": a.min_profile_pressure, "pressure_smoothing_period": a.pressure_smoothing, "speed": a.speed, "angle_of_attack": a.aoa, "use_pitch_correction": a.pitch_correction}
    if a.peaks:
        own["peaks_kwargs"] = jobs.parse_list(a.peaks, "--peaks", PEAKS)
    if a.command == "eps":
        own |= {"diss_len_sec": a.diss_len, "fft_len_sec": a.fft_len, "min_speed": a.min_speed, "temperature": a.temperature, "aux_time": a.aux_time, "aux_latitude": a.aux_lat, "aux_longitude": a.aux_lon, "aux_temperature": a.aux_temp, "aux_salinity": a.aux_sal, "aux_density": a.aux_dens, "accel_clean": a.accel_clean, "emc_clean": a.emc_clean, "compute_thermo": a.thermo, "match_conductivity": a.match_conductivity, "ctd_bin_sec": a.ctd_bin_sec, "stationary_platform": a.stationary}
        if a.despike:
            own |= {f"despike_{k}": v for k, v in jobs.parse_list(a.despike, "--despike", DESPIKE).items()} | {"force_despike": True}
    return ProfileConfig(**own)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=a.log_level.upper())
    try:
        if a.command == "cut":
            Path(a.output).write_bytes(pfile.cut(Path(a.input).read_bytes(), a.start, a.n_records))
            return 0
        spark = session(a.command)
        if a.command == "p2l1":
            despike = jobs.parse_list(a.despike, "--despike", DESPIKE) if a.despike else None
            done = jobs.convert(spark, a.files, a.output, overwrite=a.overwrite, min_file_size=a.min_file_size, compression=a.compress, despike=despike, compression_level=a.compression_level)
        elif a.command == "mat":
            done = jobs.import_mat(spark, a.files, a.output, a.overwrite, a.compress, a.compression_level)
        elif a.command == "eps":
            aux = spark.read.parquet(a.aux) if a.aux else None
            done = jobs.compute_epsilon(spark, a.level1, a.output, config_of(a), aux, a.overwrite, a.skip_existing)
        elif a.command == "profiles":
            done = jobs.index_job(spark, a.level1, a.output, config_of(a), a.overwrite, a.materialize, a.compress, a.compression_level)
        elif a.command == "bin":
            limits = jobs.parse_list(a.qc_thresh, "--qc-thresh", {"questionable": float, "bad": float})
            names = [v.strip() for v in a.vars.split(",")] if a.vars else None
            done = jobs.bin_job(spark, a.level2, a.output, a.overwrite, a.dmin, a.dmax, a.bin_width, names, a.lat, ctd_width=a.ctd_bin_width, **limits)
        else:
            done = jobs.merge_job(spark, a.level1, a.output, a.overwrite, a.dry_run)
        done.show(50, truncate=False)
    except Exception as e:
        logging.getLogger(__name__).error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
