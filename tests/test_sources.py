"""MATLAB cast files, and the attributes of columns."""

from __future__ import annotations

import datetime as dt
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltfinger.cli import parser
from saltfinger.functions.calibration import channel_units
from saltfinger.plans import jobs
from saltfinger.plans.attributes import describe, described, of_column
from saltfinger.sources import matfile, pfile

STORED = {"<i2": 3, ">i2": 3, "<f8": 9, ">f8": 9, "<f4": 7, "|u1": 2, "<i4": 5, ">i4": 5}


def element(kind, raw, order, small=False):
    if small and len(raw) <= 4:
        return struct.pack(f"{order}I", len(raw) << 16 | kind) + raw.ljust(4, b"\0")
    return struct.pack(f"{order}II", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)


def matrix(name, values, order, stored, small, flags=6):
    values = np.atleast_1d(values)
    raw = values.astype(stored)
    body = element(6, struct.pack(f"{order}II", flags, 0), order) + element(5, struct.pack(f"{order}ii", len(values), 1), order)
    return element(14, body + element(1, name.encode(), order, small) + element(STORED[raw.dtype.str], raw.tobytes(), order, small), order)


def mat_file(own, order="<", packed=False, small=True, stored=None):
    head = b"MATLAB 5.0 MAT-file".ljust(124) + (b"\0\1IM" if order == "<" else b"\1\0MI")
    parts = [matrix(k, v, order, (stored or {}).get(k, f"{order}f8"), small) for k, v in own.items()]
    if packed:
        parts = [struct.pack(f"{order}II", 15, len(z := zlib.compress(p))) + z for p in parts]
    return head + b"".join(parts)


def cast(n=70_000):
    fast, slow = np.arange(n), np.arange(n // 8)
    return {"sh1": np.sin(fast), "sh2": fast % 7, "gradT1": -fast.astype(float), "gradT2": fast * 0.5, "U_EM": slow * 0.01, "P_slow": 10 + slow * 0.1, "t_fast": fast / 512, "t_slow": slow / 64, "fs_fast": 512.0, "fs_slow": 64.0, "other": np.arange(3)}


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [False, True])
def test_variables_of_a_file(order, packed):
    own = cast(200)
    got = dict(matfile.variables(mat_file(own, order, packed, stored={"sh2": f"{order}i2", "other": "u1"})))
    assert set(got) == set(own)
    for name, x in own.items():
        assert np.array_equal(got[name], np.atleast_1d(x)), name
    assert set(dict(matfile.variables(mat_file(own, order, packed), ["sh1", "none"]))) == {"sh1"}


def test_what_is_not_numeric_is_left_out():
    head = mat_file({})
    text, cell, complex_ = (matrix("x", [1, 2], "<", "<f8", True, flags) for flags in (4, 1, 6 | 0x0800))
    assert list(matfile.variables(head + text + cell + complex_)) == []
    assert [n for n, _ in matfile.variables(head + text + matrix("y", [], "<", "<f8", False) + matrix("z", [3], "<", "<f4", True))] == ["y", "z"]


def test_broken_files():
    good = mat_file(cast(50))
    for content in (b"", b"short", good[:126] + b"xx" + good[128:], good[:-40], b"\x89HDF\r\n\x1a\n" + b"\0" * 600):
        with pytest.raises((ValueError, StopIteration)):
            list(matfile.variables(content))


def test_level_1_of_mat_files(spark, tmp_path):
    own = cast()
    (tmp_path / "one.mat").write_bytes(mat_file(own, packed=True))
    (tmp_path / "two.mat").write_bytes(mat_file({k: v for k, v in cast(80).items() if k != "U_EM"}, ">"))
    (tmp_path / "bad.mat").write_bytes(b"\0" * 300)
    (tmp_path / "half.mat").write_bytes(mat_file(cast(100))[:-200])
    out = str(tmp_path / "l1")
    status = {r.file_id: r.error for r in jobs.import_mat(spark, f"{tmp_path}/*.mat", out).collect()}
    assert status["one"] is None and status["two"] is None and "level-5" in status["bad"] and "ends inside" in status["half"]
    with pytest.raises(FileExistsError):
        jobs.import_mat(spark, f"{tmp_path}/*.mat", out)
    fast, slow, files = jobs.read_level1(spark, out)
    rows = fast.where("file_id = 'one'").orderBy("i").collect()
    assert [r.i for r in rows] == list(range(70_000)) and np.array_equal([r.sh1 for r in rows], own["sh1"]) and np.array_equal([r.t for r in rows], own["t_fast"])
    deep = slow.where("file_id = 'one'").orderBy("i").collect()
    assert np.array_equal([r.P for r in deep], own["P_slow"]) and np.array_equal([r.U_EM for r in deep], own["U_EM"])
    assert slow.where("file_id = 'two' AND U_EM IS NULL AND P IS NOT NULL").count() == 10
    assert {r.file_id for r in fast.select("file_id").distinct().collect()} == {"one", "two"}
    assert {(r.file_id, r.fs_fast, r.fs_slow) for r in files.collect()} == {("one", 512.0, 64.0), ("two", 512.0, 64.0)}
    assert describe(slow)["P"]["units"] == "dbar" and parser().parse_args(["mat", "x", "-o", "y"]).command == "mat"


def test_attributes_of_columns(spark, tmp_path):
    assert of_column("JAC_T")["standard_name"] == "sea_water_temperature" and of_column("salinity_hires")["units"] == "1"
    assert of_column("eps_1")["units"] == "W kg-1" and of_column("k_max_2")["units"] == "m-1" and of_column("sh1_clean")["units"] == "m2 s-3"
    assert of_column("eps_1_qc")["flag_meanings"] == "good questionable bad missing" and "merit" in of_column("eps_1_fm")["long_name"]
    assert of_column("nobody") == {} and of_column("V_Bat", {"V_Bat": "V"}) == {"long_name": "V_Bat", "units": "V"}
    assert (channel_units("poly", "[dbar]"), channel_units("t_ms", None), channel_units("new", "V"), channel_units(None, None)) == ("dbar", "C", "counts", "counts")
    df = spark.range(1).select(F.col("id").alias("P"), F.lit(1).alias("x.y"), F.lit(2).alias("sh1", metadata={"units": "own"}))
    described(df).write.parquet(str(tmp_path / "t"))
    got = describe(spark.read.parquet(str(tmp_path / "t")))
    assert got["P"]["units"] == "dbar" and got["sh1"] == {"long_name": "Velocity time derivative from probe 1", "units": "own"} and "x.y" not in got


def test_jobs_write_attributes(spark, tmp_path):
    setup = "[matrix]\nrow01 = 1 2\nrow02 = 1 3\n[channel]\nid=1\nname=sh1\ntype=shear\nadc_fs=4.096\nadc_bits=16\ndiff_gain=1\nsens=0.07\n[channel]\nid=2\nname=P\ntype=poly\ncoef0=0\ncoef1=0.01\nunits=[dbar]\n[channel]\nid=3\nname=V_Bat\ntype=voltage\nadc_fs=4.096\nadc_bits=16\ng=0.1\n"
    data = {1: np.arange(2000), 2: np.arange(1000), 3: np.arange(1000)}
    (tmp_path / "a.p").write_bytes(pfile.encode(setup, [[1, 2], [1, 3]], data, 1, 1, 100.0, dt.datetime(2026, 1, 1), 10))
    jobs.convert(spark, f"{tmp_path}/a.p", str(tmp_path / "l1"), variables=["sh1", "P", "V_Bat"], min_file_size=1)
    fast, slow, _ = jobs.read_level1(spark, str(tmp_path / "l1"))
    assert describe(fast)["sh1"]["units"] == "m2 s-3" and describe(slow)["P"]["long_name"] == "Pressure" and describe(slow)["V_Bat"] == {"long_name": "V_Bat", "units": "V"}


def test_named_channels_equal_the_joined_ones(spark, tmp_path):
    setup = "[matrix]\nrow01 = 1 2 4 4\nrow02 = 1 3 5 5\n[channel]\nid=1\nname=sh1\ntype=shear\n[channel]\nid=2,3\nname=P\ntype=poly\n[channel]\nid=3\nname=p\ntype=poly\n[channel]\nid=4, 1\nname=U\ntype=poly\n[channel]\nid=9\nname=none\n[channel]\nid=2,9\nname=half\n[channel]\nid=x\nname=bad\n[channel]\nname=noid\n[channel]\nid=5,x\nname=five\n[channel]\nid=3\nname=ground\ntype=gnd\n[channel]\nid=3\nname=EM_Cur\ntype=gnd\n"
    rng = np.random.default_rng(4)
    for at, order in (("a", "<"), ("b", ">")):
        data = {c: rng.integers(-(2**15), 2**15, 4000) for c in (1, 2, 3, 4, 5)}
        (tmp_path / f"{at}.p").write_bytes(pfile.encode(setup, [[1, 2, 4, 4], [1, 3, 5, 5]], data, 3, 1, 100.0, dt.datetime(2026, 1, 1), 10, order))
    (tmp_path / "c.p").write_bytes(b"\0" * 400)
    path = f"{tmp_path}/*.p"
    params = pfile.channel_params(pfile.setup_sections(pfile.read_headers(spark, path).where("error IS NULL")))
    want = pfile.channels(pfile.read_counts(spark, path), params)
    got = pfile.read_channels(spark, path)
    key = lambda df: sorted(map(tuple, df.select("path", "channel", "i", "count").collect()))
    assert key(got) == key(want) and got.where("channel = 'P'").agg(F.max("count")).first()[0] > 2**16
    assert {r.channel for r in got.select("channel").distinct().collect()} == {"sh1", "P", "U", "five", "ground", "EM_Cur"}
    fewer = pfile.read_channels(spark, path, exclude_types=("gnd",), always=("EM_Cur",))
    assert key(fewer) == key(got.where("channel <> 'ground'"))
