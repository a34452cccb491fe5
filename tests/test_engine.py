import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltfinger.cli import config_of, parser
from saltfinger.cli import main as cli
from saltfinger.functions import calibration, physics
from saltfinger.operators import align, binning, profiles, quality, series, thermo, windows
from saltfinger.plans import jobs
from saltfinger.plans.config import ProfileConfig
from saltfinger.plans.queries import ORACLES, QUERIES
from saltfinger.sources import pfile


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# calibration and physics


def test_shear_sensitivity(spark):
    own = {"adc_fs": "4.096", "adc_bits": "16", "diff_gain": "0.696", "name": "sh1"}
    with pytest.warns(UserWarning, match="sens=0"):
        assert math.isnan(value(spark, calibration.convert(F.lit(100), "shear", own | {"sens": "0"})))
    with pytest.warns(UserWarning, match="outside"):
        calibration.convert(F.lit(100), "shear", own | {"sens": "0.5"})
    assert value(spark, calibration.convert(F.lit(32000), "xmp_shear", own | {"sens": "0.07"})) == pytest.approx(4.096 / 65536 * 32000 / (2 * math.sqrt(2) * 0.696 * 0.07))


def test_dispatch_errors_and_units():
    with pytest.raises(ValueError, match="unknown channel type"):
        calibration.convert(F.lit(1), "none", {})
    with pytest.raises(ValueError, match="missing"):
        calibration.convert(F.lit(1), "magn", {})
    with pytest.raises(ValueError, match="beta"):
        calibration.convert(F.lit(1), "therm", {"a": 0, "b": 1, "adc_fs": 4, "adc_bits": 16, "g": 6, "e_b": 1, "t_0": 289})
    assert calibration.units_of("poly", {"units": "[dbar]"}) == "dbar" and calibration.units_of("t_ms") == "C"


def test_inclinometer_words(spark):
    words = [0x8000 - 65536 + 5, 0xBFFF - 65536, 5, 0xC000 - 65536 + 3]
    rows = spark.createDataFrame([(w,) for w in words], "x long").select(calibration.adis_extract(F.col("x")).alias("v"), *(c.alias(n) for c, n in zip(calibration.adis_flags(F.col("x")), ("old", "bad"), strict=True))).collect()
    assert [r.v for r in rows][:3] == [5, -1, 5] and [r.old for r in rows][:3] == [False, False, True]


def test_published_check_values(spark):
    ratio = lambda r, t, p: physics.practical_salinity(r * 42.914, t / 1.00024, p)
    assert value(spark, ratio(1.0, 15.0, 0.0)) == pytest.approx(35, abs=1e-6)
    assert value(spark, ratio(1.2, 20.0, 2000.0)) == pytest.approx(37.245628, abs=1e-5)
    assert value(spark, ratio(0.65, 5.0, 1500.0)) == pytest.approx(27.995347, abs=1e-5)
    assert value(spark, physics.viscosity(40.0, 25.0, 1027.1)[1]) == pytest.approx(9.6541e-4, rel=1e-3)


def test_published_values_of_teos_10(spark):
    """The check values that the TEOS-10 documentation gives."""
    rows = zip([34.7118, 34.8915, 35.0256, 34.8472, 34.7366, 34.7324], [28.7856, 28.4329, 22.8103, 10.2600, 6.8863, 4.4036], [28.8099, 28.4392, 22.7862, 10.2262, 6.8272, 4.3236], [10.0, 50.0, 125.0, 250.0, 600.0, 1000.0], strict=True)
    df = spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows)], "f string, i long, sa double, t double, ct double, p double")
    out = df.withColumns({"got": physics.conservative_temperature(F.col("sa"), F.col("t"), F.col("p")), "rho": physics.density(F.col("sa"), F.col("ct"), F.col("p")), "z": physics.depth(F.col("p"), 4.0)}).orderBy("i").collect()
    assert [r.got for r in out] == pytest.approx([28.809919826700281, 28.439227816091140, 22.786176893078498, 10.226189266620782, 6.827213633479988, 4.323575748610455], abs=1e-11)
    assert [r.rho for r in out] == pytest.approx([1021.839935738108, 1022.262457966867, 1024.427195413316, 1027.790152759127, 1029.837779000189, 1032.002453224572], abs=1e-9)
    assert [r.z for r in out] == pytest.approx([9.9445834469453, 49.7180897012550, 124.2726219409978, 248.4700576548589, 595.8253480356214, 992.0919060719987], abs=1e-9)
    n2 = physics.squared_buoyancy(*(F.lit(float(x)) for x in (34.80165, 28.62455, 30.0, 0.1797, -0.3707, 40.0)), physics.gravity(30.0, 4.0))
    assert value(spark, n2) == pytest.approx(0.060843209693499e-3, rel=1e-7)


# windows and alignment


@pytest.fixture(scope="module")
def line(spark):
    return spark.range(100).select(F.lit("a").alias("f"), F.col("id").alias("i"), (F.col("id") / 10.0).alias("t"), (F.col("id") * 1.0).alias("x"))


def test_window_means(line):
    got = {r.win: r.x for r in windows.window_mean(line, ["f"], ["x"], 8, 32).collect()}
    assert got == {w: np.arange(w * 28, w * 28 + 32).mean() for w in range(3)}
    assert {r.b: r.x for r in windows.block_mean(line, ["f"], ["x"], 30).collect()} == {0: 14.5, 1: 44.5, 2: 74.5}
    kept = sorted(r.x for r in windows.trim_windows(line, ["f"], 32, 8).collect())
    assert kept == list(range(12, 100))
    assert windows.trim_windows(line, ["f"], 300, 8).count() == 0
    sizes = windows.with_window_sizes(line.select(F.lit(512.03).alias("fs_fast"), F.lit(64.0).alias("fs_slow")), 1.0, 4.0).first()
    assert (sizes.n_fft, sizes.n_diss, sizes.ratio, sizes.n_fft_slow, sizes.n_diss_slow) == (512, 2048, 8, 64, 256)
    by_column = windows.window_mean(line.withColumns({"n": F.lit(8), "m": F.lit(32)}), ["f"], ["x"], "n", "m")
    assert {r.win: r.x for r in by_column.collect()} == got
    assert [windows.kept_samples(n, 2048, 512, 8) for n in (2047, 2048, 3839, 3840, 6000)] == [None, 2048, 2048, 3840, 5632]


def test_missing_values_do_not_count(spark):
    df = spark.createDataFrame([("a", 0, float("nan")), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 4.0)], "f string, i long, x double")
    assert windows.block_mean(df, ["f"], ["x"], 4).first().x == 3.0
    assert df.groupBy("f").agg(windows.first_valid("x").alias("x")).first().x == 2.0


def test_segments_and_samples(spark):
    t = [0, 1, 2, 3, 100, 101, 102]
    p = [0, 5, 10, 15, 60, 30, 2]
    df = spark.createDataFrame([("a", i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, p, strict=True))], "f string, i long, t double, p double")
    shape = windows.segment_shape(windows.gap_segments(df, ["f"]), ["f"], "p")
    rows = windows.number_profiles(windows.monotonic_profiles(shape, "both"), ["f"])
    assert [(r.start_idx, r.end_idx, r.direction, r.profile_index) for r in rows.orderBy("start_idx").collect()] == [(0, 3, "down", 0), (4, 6, "up", 1)]
    assert windows.monotonic_profiles(shape, "up").count() == 1
    assert [r.i for r in windows.extract_profile(df, rows, ["f"], 1).orderBy("i").collect()] == [4, 5, 6]
    with pytest.raises(ValueError, match="no profile"):
        windows.extract_profile(df, rows, ["f"], 9)


def test_interpolation(spark):
    aux = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 20.0), ("a", 20.0, None), ("a", 30.0, 30.0), ("a", None, 5.0)], "f string, t double, v double")
    at = spark.createDataFrame([("a", x) for x in (-5.0, 0.0, 5.0, 20.0, 30.0, 34.0)], "f string, t double")
    got = [r.v for r in align.interpolate(at, aux, ["v"], ["f"]).orderBy("t").collect()]
    assert got == pytest.approx([-10, 0, 10, 25, 30, 32])
    inside = [r.v for r in align.interpolate(at, aux, ["v"], ["f"], extrapolate=False).orderBy("t").collect()]
    assert inside[0] is None and inside[-1] is None and inside[4] == 30
    filled = [r.v for r in align.fill_gaps(aux, ["v"], ["f"]).orderBy("t").collect()]
    assert filled == pytest.approx([0, 20, 25, 30])
    assert value(spark, align.epoch_of(F.lit("seconds since 1970-01-02T00:00:00.5"))) == 86400.5
    assert value(spark, align.epoch_of(F.lit("days since 1970-01-02"))) is None


@pytest.mark.parametrize("bucket", [3.0, 3600.0])
def test_points_near_a_span_are_enough(spark, bucket):
    rng = np.random.default_rng(7)
    at = np.sort(rng.uniform(0, 200, 60))
    aux = spark.createDataFrame([(float(t), float(rng.normal()) if rng.random() < 0.7 else None, float(rng.normal())) for t in at] + [(None, 1.0, 1.0)], "t double, v double, w double")
    spans = [("a", -50.0, -40.0), ("b", 20.0, 21.0), ("c", 190.0, 260.0), ("d", 80.0, 80.0), ("e", 500.0, 510.0)]
    samples = spark.createDataFrame([(f, x) for f, a, z in spans for x in np.linspace(a, z, 9).tolist()], "f string, t double")
    own = align.near(aux, spark.createDataFrame(spans, "f string, first double, last double"), ["v", "w"], ["f"], bucket=bucket)
    everything = aux.crossJoin(spark.createDataFrame([(f,) for f, *_ in spans], "f string"))
    got, want = ({(r.f, r.t): (r.v, r.w) for r in align.interpolate(samples, series_, ["v", "w"], ["f"]).collect()} for series_ in (own, everything))
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)
    assert bucket > 100 or own.count() < 5 * 2 * 30


def test_concatenation(spark):
    df = spark.createDataFrame([("b", 0, 0.0, 100.0), ("b", 1, 1.0, 100.0), ("a", 0, 0.0, 50.0)], "file_id string, i long, t double, e double")
    assert [(r.i, r.t) for r in align.concatenate(df, ["file_id"], "e").orderBy("i").collect()] == [(0, 50.0), (1, 100.0), (2, 101.0)]


# quality and binning


def test_flags(spark):
    nan, null = F.lit(float("nan")), F.lit(None).cast("double")
    flag = lambda *a: value(spark, quality.compose_flag(*a))
    one, no, yes = F.lit(1e-9), F.lit(False), F.lit(True)
    assert [flag(one, F.lit(1.0), no, F.lit(0.0)), flag(one, F.lit(2.0), no, F.lit(0.0)), flag(one, F.lit(3.0), no, None), flag(one, nan, no, nan), flag(one, None, yes, None), flag(nan, F.lit(1.0), no, None), flag(null, None, no, None), flag(one, F.lit(1.0), yes, F.lit(0.25))] == [1, 2, 4, 1, 2, 9, 9, 4]


def test_pairs(spark):
    rows = [(1.0, 3.0, 1, 2), (1.0, 30.0, 1, 4), (None, 2.0, 9, 2), (float("nan"), None, 9, 9), (2.0, float("nan"), 4, 9), (1.0, 10.0, 1, 1)]
    df = spark.createDataFrame(rows, "a double, b double, p int, q int")
    eps, flag = quality.combine_pair(*(F.col(c) for c in "abpq"))
    assert [tuple(r) for r in df.select(eps.alias("e"), flag.alias("f")).collect()] == [(2.0, 2), (1.0, 4), (2.0, 2), (None, 9), (2.0, 4), (5.5, 1)]


def test_bins_are_right_closed(spark):
    assert binning.bin_edges(0, 5, 2) == [0, 2, 4, 6]
    df = spark.createDataFrame([(float(x),) for x in (0, 0.5, 2, 2.1, 4, 5.9, 6, 6.1)], "x double")
    assert [r.b for r in df.select(binning.bin_number(F.col("x"), 0.0, 2.0, 3).alias("b")).collect()] == [None, 0, 0, 1, 1, 2, 2, None]
    own = spark.createDataFrame([(round(0.1 * k, 10),) for k in range(1, 200)], "x double").select("x", binning.bin_number(F.col("x"), 0.0, 0.1, 200).alias("b"))
    assert all(r.b * 0.1 < r.x <= (r.b + 1) * 0.1 for r in own.collect())


def test_bin_product(spark):
    rows = [("f", 0, 0.0, 1.0, 1e-9, 3e-9, 1, 1, 10.0), ("f", 0, 1.0, 2.0, 5e-7, 3e-9, 2, 1, 12.0), ("f", 1, -9.0, 3.0, None, 1e-8, 9, 4, 14.0)]
    df = spark.createDataFrame(rows, "file_id string, profile_index long, time double, pressure double, eps_1 double, eps_2 double, eps_1_qc int, eps_2_qc int, temperature double")
    out = binning.bin_product(df, jobs.KEYS, 0.0, 8.0, 4.0)
    got = {(r.profile_index, r.depth): r for r in out.collect()}
    assert len(got) == 4 and {r.profile for r in got.values() if r.profile_index == 1} == {0}
    first = got[(0, 2.0)]
    assert first.eps_1 == 1e-9 and first.eps == pytest.approx(2e-9) and first.temperature == 11.0 and first.time == 0.5
    assert got[(1, 2.0)].eps is None and got[(1, 2.0)].eps_qc == 9 and got[(0, 6.0)].eps_1 is None


# hydrography


def test_hydrography(spark):
    df = spark.createDataFrame([("f", 0, w, float(w), 10.0 + w, 0.5, 12 - 0.05 * w, 40.0, -45.0) for w in range(20)], "file_id string, profile_index long, win long, t double, P_smooth double, W_smooth double, JAC_T double, JAC_C double, aux_latitude double")
    out = thermo.buoyancy_frequency(thermo.hydrography(df, jobs.KEYS, thermo=True), jobs.KEYS, "win").orderBy("win").collect()
    assert all(r.z < 0 and r.absolute_salinity > r.salinity and abs(r.conservative_temperature - r.temperature) < 1 and r.nu > 0 for r in out)
    assert out[0].N2 is None and out[-1].N2 is None and all(r.N2 > 0 for r in out[1:-1])
    low = thermo.hydrography(df.withColumn("JAC_C", F.lit(1.0)), jobs.KEYS).first()
    assert low.salinity is None and low.density is None
    assert [value(spark, thermo.is_stationary(F.lit(v))) for v in (" VMP ", "glider", None)] == [True, False, False]
    assert value(spark, thermo.is_stationary(F.lit("glider"), True))


def test_series_by_key(spark):
    rng = np.random.default_rng(0)
    rows = [(f, i, i / 64, float(10 + i / 640), float(rng.normal())) for f in "ab" for i in range(600)]
    df = spark.createDataFrame(rows, "file_id string, i long, t double, P double, sh1 double").repartition(5)
    out = series.smooth_slow(df, ["file_id"], 64.0)
    assert out.where("i BETWEEN 100 AND 500 AND abs(W_smooth - 0.1005) > 1e-3").count() == 0 and out.where("i BETWEEN 100 AND 500 AND abs(P - P_smooth) > 1e-3").count() == 0
    clean = series.despike(out, ["file_id"], ["sh1", "none"], 64.0)
    assert {"sh1_clean", "sh1_despike_mask"} <= set(clean.columns) and series.despike(clean, ["file_id"], ["sh1"], 64.0) is clean
    with pytest.raises(ValueError, match="pressure"):
        series.smooth_slow(df, ["file_id"], 64.0, pressure="none")


def cast(*legs):
    return np.concatenate([np.linspace(a, b, int(s * 64)) for a, b, s in legs])


def test_profile_scenarios(spark):
    up, down = cast((0, 100, 20), (100.01, 0, 500)), cast((0, 100, 500), (100.01, 0, 20))
    apart = [cast((100, 0, 500)) for _ in range(5)]
    shallow = [cast((a, 0, 500)) for a in (100, 10, 100)]
    s = np.arange(0, 10000, 1 / 8)
    waves = 380 * (1 - np.cos(2 * np.pi * s / 2000))
    three = s[: 6000 * 8]
    gaps = lambda legs: np.concatenate([np.arange(len(x)) / 64 + i * 2500 for i, x in enumerate(legs)])
    series_ = {"up": (up, np.arange(len(up)) / 64), "down": (down, np.arange(len(down)) / 64), "gaps": (np.concatenate(apart), gaps(apart)), "shallow": (np.concatenate(shallow), gaps(shallow)), "waves": (waves, s)}
    series_["two files"] = (np.tile(waves[: len(three)], 2), np.concatenate((three, three + 12000)))
    series_["none"] = (np.full(500, 3.0), np.arange(500) / 64)
    series_["missing"] = (np.where(np.arange(len(up)) == 50, np.nan, up), np.arange(len(up)) / 64)
    import pandas as pd

    df = spark.createDataFrame(pd.concat([pd.DataFrame({"f": f, "i": np.arange(len(p)), "t": t, "P_smooth": p}) for f, (p, t) in series_.items()]))
    counts = {}
    for way in ("up", "down", "both"):
        table = profiles.profile_index(df, ["f"], whole_file=False, direction=way).cache()
        counts |= {(r.f, way): r["count"] for r in table.groupBy("f").count().collect()}
        assert {r.direction for r in table.where("f = 'gaps'").collect()} <= {"up"}
    want = {("up", "up"): 1, ("up", "down"): 1, ("down", "up"): 1, ("down", "down"): 1, ("gaps", "up"): 5, ("shallow", "up"): 2, ("waves", "down"): 5, ("waves", "up"): 5, ("waves", "both"): 10}
    want |= {("up", "both"): 2, ("down", "both"): 2, ("gaps", "both"): 5, ("shallow", "both"): 2, ("two files", "down"): 6, ("two files", "up"): 6, ("two files", "both"): 12}
    assert counts == want
    first = profiles.profile_index(df, ["f"]).where("f = 'down'").first()
    assert down[first.end_idx] > 99.9 and down[first.start_idx] == 0 and first.direction == "down"
    whole = {r.f: (r.start_idx, r.end_idx) for r in profiles.profile_index(df, ["f"]).where("f IN ('none', 'missing')").collect()}
    assert whole == {"none": (0, 499), "missing": (0, len(up) - 1)}


# raw files and jobs

SETUP = """; comment
rate = 512 ; inline
[matrix]
row01 = 0 1 4 6
row02 = 2 1 4 6
row03 = 8 1 4 6
row04 = 9 1 4 6
[instrument_info]
vehicle = vmp
sn = 142
[empty]
[channel]
id = 8
name = P
type = poly
coef0 = 0
coef1 = 0.01
[channel]
id = 1
name = sh1
type = shear
adc_fs = 4.096
adc_bits = 16
diff_gain = 1.0
sens = 0.07
[channel]
id = 4
name = Ax
type = piezo
[channel]
id = 2
name = JAC_T
type = poly
coef0 = 0
coef1 = 0.001
[channel]
id = 0
name = Gnd
type = gnd
[channel]
id = 9,0
name = Big
type = poly
coef0 = 0
coef1 = 1
"""


def raw_file(endian="<", records=60, speed=0.6):
    """60 s of a down cast at 512 and 128 Hz with a shear-like signal."""
    rng = np.random.default_rng(1)
    fast, slow = 512 * records, 128 * records
    data = {1: rng.normal(0, 200, fast), 4: rng.normal(0, 50, fast), 6: np.zeros(fast), 0: np.full(slow, -2), 2: np.full(slow, 12000), 8: (20 + speed * np.arange(slow) / 128) * 100, 9: np.full(slow, 3)}
    matrix = [[0, 1, 4, 6], [2, 1, 4, 6], [8, 1, 4, 6], [9, 1, 4, 6]]
    return pfile.encode(SETUP, matrix, {k: np.round(v).astype(int) for k, v in data.items()}, 3, 1, 512.0, dt.datetime(2026, 3, 15, 12, 0, 1, 500000), records, endian)


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    path = tmp_path_factory.mktemp("raw")
    (path / "one.p").write_bytes(raw_file())
    (path / "two.p").write_bytes(raw_file(">"))
    (path / "bad.p").write_bytes(b"\0" * 400)
    return path


def test_headers_and_counts(spark, raw):
    heads = {r.path.rsplit("/", 1)[1]: r for r in pfile.read_headers(spark, f"{raw}/*.p").collect()}
    one = heads["one.p"]
    assert (one.fs_fast, one.fs_slow, one.header_version, one.records, one.n_rows) == (512.0, 128.0, 6.001, 60, 4)
    assert str(one.filetime) == "2026-03-15 12:00:01.500000" and heads["bad.p"].error and heads["two.p"].error is None
    assert pfile.read_headers(spark, f"{raw}/one").first().records == 60
    counts = pfile.read_counts(spark, f"{raw}/*.p")
    size = {(r.path.rsplit("/", 1)[1], r.channel_id): r["count"] for r in counts.groupBy("path", "channel_id").count().collect()}
    assert size[("one.p", 1)] == 512 * 60 and size[("two.p", 8)] == 128 * 60
    by = lambda name: [r["count"] for r in counts.where(F.col("path").endswith(name) & (F.col("channel_id") == 8)).orderBy("i").limit(500).collect()]
    assert by("one.p") == by("two.p")


def test_setup_in_sql_is_the_parser(spark, raw):
    heads = pfile.read_headers(spark, f"{raw}/one.p")
    rows = pfile.setup_sections(heads).orderBy("section_idx").collect()
    assert [(r.section, r.params) for r in rows] == pfile.parse_setup(SETUP)
    sections = pfile.setup_sections(heads)
    assert pfile.setup_value(sections, "CHANNEL", "name", index=1).first().value == "sh1"
    assert pfile.setup_value(sections, "channel", "none", "d").first().value == "d"
    assert pfile.sections_like(sections, "INSTR").count() == 1
    assert {r.channel for r in pfile.channel_params(sections).collect()} == {"P", "sh1", "Ax", "JAC_T", "Gnd", "Big"}
    wide = pfile.channels(pfile.read_counts(spark, f"{raw}/one.p"), pfile.channel_params(sections))
    assert wide.where("channel = 'Big'").first()["count"] == -2 * 65536 + 65536 * 65536 + 3 - 2**32


def test_setup_texts_are_parsed_in_their_rows(spark):
    """No shuffle and no sort, whatever the number of texts; the values are those of
    the section table."""
    rng = np.random.default_rng(5)
    bits = ["[a]", "[A] x", " [b ]", "[]", "[c", "k=1", "K = 2 ; say", "j==3", "=4", "; k=5", "", "[root]", "k", "[d];k=6"]
    texts = ["\n".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(0, 14))) for _ in range(150)]
    setups = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "path long, setup string")
    got = {}
    for r in pfile.setup_sections(setups).orderBy("path", "section_idx").collect():
        got.setdefault(r.path, []).append((r.section, r.params))
    for i, text in enumerate(texts):
        want = pfile.parse_setup(text)
        own = got.get(i, [])
        # texts that begin with a head have no rows before it
        assert own == (want if own[:1] == want[:1] and len(own) == len(want) else want[1:]), text
    assert len(texts) not in got
    wanted = {"x": ("A", "K", 0), "y": ("a", "k", 1), "z": ("root", "j", 0)}
    rows = pfile.setup_values(setups, wanted, "none")
    values = {r.path: (r.x, r.y, r.z) for r in rows.collect()}
    for at, (section, parameter, index) in enumerate(wanted.values()):
        assert {r.path: r.value for r in pfile.setup_value(pfile.setup_sections(setups), section, parameter, "none", index).collect()} == {k: v[at] for k, v in values.items()}
    for df in (rows, pfile.setup_sections(setups)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan


def test_cut():
    content = raw_file(records=10)
    own = pfile.Layout(pfile.cut(content, 2, 5))
    assert own.records == 5 and own.setup == pfile.Layout(content).setup
    with pytest.warns(UserWarning, match="fewer"):
        assert pfile.Layout(pfile.cut(content, 7, 60)).records == 3
    for start, n in ((10, 1), (-1, 2), (0, 0)):
        with pytest.raises(ValueError, match="records"):
            pfile.cut(content, start, n)


def test_byte_order():
    head = bytearray(128)
    assert pfile.endian_of(bytes(head))[0] == "<"
    for word, want in ((b"\0\2", ">"), (b"\1\0", "<"), (b"\2\0", "<"), (b"\0\1", ">")):
        head[126:] = word
        assert pfile.endian_of(bytes(head))[0] == want
    head[126:] = b"\7\7"
    with pytest.raises(ValueError, match="byte order"):
        pfile.endian_of(bytes(head))


def test_jobs_end_to_end(spark, raw, tmp_path):
    l1, l2, l3 = (str(tmp_path / x) for x in ("l1", "l2", "l3"))
    status = {r.file_id: r.error for r in jobs.convert(spark, f"{raw}/*.p", l1, min_file_size=1, compression="zstd", compression_level=9).collect()}
    assert status["one"] is None and status["bad"]
    with pytest.raises(FileExistsError):
        jobs.convert(spark, f"{raw}/*.p", l1, min_file_size=1)
    fast, slow, files = jobs.read_level1(spark, l1)
    assert fast.where("file_id = 'one'").count() == 512 * 60 and slow.where("file_id = 'two'").count() == 128 * 60
    row = slow.where("file_id = 'one' AND i = 128").first()
    assert row.P == pytest.approx(20.6, abs=0.02) and row.JAC_T == pytest.approx(12.0) and row.t == 1.0
    assert files.where("file_id = 'one'").first().instrument_vehicle == "vmp"

    aux = spark.createDataFrame([(dt.datetime(2026, 3, 15, 11), -45.0, 170.0), (dt.datetime(2026, 3, 15, 13), -44.0, 172.0)], "time timestamp, lat double, lon double")
    config = ProfileConfig(peaks_kwargs={"height": 25, "distance": 200, "width": 200, "prominence": 5})
    done = {(r.file_id, r.profile_index): (r.windows, r.error) for r in jobs.compute_epsilon(spark, l1, l2, config, aux).collect()}
    assert done == {(f, 0): ((512 * 60 - 3 - 2048) // 1792 + 1, None) for f in ("one", "two")}
    out = spark.read.parquet(f"{l2}/windows").where("file_id = 'one'").orderBy("win").collect()
    assert all(r.eps_1 > 0 and r.eps_1_qc in (1, 2, 4) and r.W == pytest.approx(0.603, abs=0.02) and r.lat == pytest.approx(-44.5, abs=0.01) for r in out)
    assert all(b.pressure > a.pressure for a, b in zip(out[:-1], out[1:], strict=True)) and out[0].nu == pytest.approx(1.28e-6, rel=0.1)
    assert spark.read.parquet(f"{l2}/ctd").where("file_id = 'one'").count() > 4 * len(out)
    assert jobs.compute_epsilon(spark, l1, l2, config, aux, skip_existing=True).count() == 0
    assert len({r.lat for r in out}) == 1 and len({r.N2 for r in out} if "N2" in out[0] else {None}) == 1

    grid = jobs.bin_job(spark, l2, l3, high=60.0, width=2.0, ctd_width=1.0)
    assert grid.count() == 2 * 30 and grid.where("eps_1 IS NOT NULL").count() >= 10
    assert spark.read.parquet(f"{l3}/binned_ctd").count() == 2 * 60

    table = jobs.index_job(spark, l1, str(tmp_path / "index"), config, materialize=True)
    assert table.count() == 2
    hires = spark.read.parquet(str(tmp_path / "index" / "hires_fast"))
    assert hires.count() == hires.select("file_id", "profile_index", "i").distinct().count() > 2 * 500 * 59
    sizes = jobs.merge_job(spark, [l1], str(tmp_path / "merged"), dry_run=True)
    assert {(r.file_id, r.table): r.samples for r in sizes.collect()}[("one", "slow")] == 128 * 60
    jobs.merge_job(spark, [l1], str(tmp_path / "merged"))
    assert spark.read.parquet(str(tmp_path / "merged" / "fast")).agg(F.max("i")).first()[0] == 2 * 512 * 60 - 1


def level1(spark, path, files):
    """A level-1 folder: name -> (fs_fast, fs_slow, vehicle, fast shear, slow pressure, start)."""
    import pandas as pd

    fast, slow, heads = [], [], []
    for name, (f, s, vehicle, sh, p, start) in files.items():
        fast.append(pd.DataFrame({"file_id": name, "i": np.arange(len(sh)), "t": np.arange(len(sh)) / f, "sh1": sh}))
        slow.append(pd.DataFrame({"file_id": name, "i": np.arange(len(p)), "t": np.arange(len(p)) / s, "P": p, "JAC_T": np.linspace(15, 12, len(p)), "JAC_C": np.linspace(42, 40, len(p))}))
        heads.append((name, f"{name}.p", start, f, s, vehicle, "1"))
    table = "file_id string, source_file string, filetime timestamp_ntz, fs_fast double, fs_slow double, instrument_vehicle string, instrument_sn string"
    for name, df in (("fast", spark.createDataFrame(pd.concat(fast))), ("slow", spark.createDataFrame(pd.concat(slow))), ("files", spark.createDataFrame(heads, table))):
        df.write.partitionBy("file_id").parquet(f"{path}/{name}")
    return str(path)


def test_jobs_with_two_rates_a_glider_and_a_broken_file(spark, tmp_path):
    rng = np.random.default_rng(2)
    begin = dt.datetime(2026, 3, 15, 12)

    def noise(n):
        return rng.normal(0, 0.1, n)

    def dive(n, s):
        return 20 + 0.6 * np.arange(n) / s

    files = {
        "vmp1": (512.0, 64.0, " VMP", noise(512 * 40), dive(64 * 40, 64), begin), "glide1": (256.0, 64.0, "glider", noise(256 * 40), dive(64 * 40, 64), begin),
        "short": (512.0, 64.0, "vmp", noise(700), dive(88, 64), begin), "nofast": (512.0, 64.0, "vmp", noise(0), dive(64 * 20, 64), begin),
    }
    path = level1(spark, tmp_path / "l1", files)
    aux = spark.createDataFrame([(begin + dt.timedelta(seconds=10 * i), -45.0 + 0.01 * i, 170.0 + 0.02 * i) for i in range(-5, 10)], "time timestamp, lat double, lon double")
    config = ProfileConfig(compute_thermo=True)
    status = {(r.file_id, r.profile_index): r for r in jobs.compute_epsilon(spark, path, str(tmp_path / "l2"), config, aux).collect()}
    assert {k[0] for k in status} == set(files)
    assert status[("vmp1", 0)].windows == (512 * 40 - 2048) // 1792 + 1 and status[("glide1", 0)].windows == (256 * 40 - 1024) // 896 + 1
    assert "shorter than a window" in status[("short", 0)].error and status[("short", 0)].windows == 0 and status[("nofast", 0)].windows == 0
    out = spark.read.parquet(str(tmp_path / "l2" / "windows"))
    lat = {f: [r.lat for r in out.where(F.col("file_id") == f).orderBy("win").collect()] for f in ("vmp1", "glide1")}
    assert len(set(lat["vmp1"])) == 1 and lat["vmp1"][0] == pytest.approx(-45, abs=0.005)
    assert all(b > a for a, b in zip(lat["glide1"][:-1], lat["glide1"][1:], strict=True))
    one = out.where("file_id = 'vmp1'").orderBy("win").collect()
    assert all(r.eps_1 > 0 and r.absolute_salinity > r.salinity and 1020 < r.density < 1035 and r.sh1_despike_frac >= 0 for r in one) and sum(r.N2 is not None for r in one) >= len(one) - 2
    moving = jobs.compute_epsilon(spark, path, str(tmp_path / "l2m"), ProfileConfig(stationary_platform=False), aux)
    assert moving.count() == len(status) and spark.read.parquet(str(tmp_path / "l2m" / "windows")).where("file_id = 'vmp1'").select("lat").distinct().count() > 1

    table = jobs.index_job(spark, path, str(tmp_path / "index"), config, materialize=True)
    assert table.count() == 4 and table.where("error IS NOT NULL").count() == 0
    hires = spark.read.parquet(str(tmp_path / "index" / "hires_fast"))
    assert {r.file_id: r["count"] for r in hires.groupBy("file_id").count().collect()}["vmp1"] <= 512 * 40
    assert hires.count() == hires.select("file_id", "profile_index", "i").distinct().count()


def test_a_file_that_fails_is_a_row_of_the_index(spark, tmp_path):
    files = {"one": (512.0, 64.0, "vmp", np.zeros(512), 20 + np.arange(640) / 100, dt.datetime(2026, 3, 15))}
    path = level1(spark, tmp_path / "l1", files)
    wrong = jobs.index_job(spark, path, str(tmp_path / "wrong"), ProfileConfig(filter_order=3))
    assert [(r.file_id, r.profile_index, r.error) for r in wrong.collect()] == [("one", None, "ValueError: order must be 1 or even")]


def test_skipping_is_an_equi_join(spark):
    stems = spark.createDataFrame([("a",), ("ab",), ("c",)], "file_id string")
    left = align.without_prefixed(stems, "file_id", spark.createDataFrame([("abx",), (None,)], "o string"), "o")
    assert [r.file_id for r in left.collect()] == ["c"]
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_command_line(tmp_path, raw):
    a = parser().parse_args(["eps", "x", "-o", "y", "--direction", "up", "--peaks", "20,100,100,20", "--despike", "1,8,0.5,0.04", "--moving", "--no-emc-clean"])
    c = config_of(a)
    assert c.profile_direction == "up" and c.peaks_kwargs["height"] == 20 and c.force_despike and c.despike_max_passes == 1 and c.stationary_platform is False and not c.emc_clean
    assert "profile_direction: up" in c.to_yaml() and c.shear_cutoff == 0.5 and ProfileConfig(hp_cutoff_hz=-1).shear_cutoff is None
    with pytest.raises(ValueError, match="values"):
        jobs.parse_list("1,2", "--peaks", {"a": float})
    with pytest.raises(ValueError, match="--peaks"):
        jobs.parse_list("x", "--peaks", {"a": float})
    with pytest.raises(ValueError, match="direction"):
        ProfileConfig(profile_direction="left")
    out = tmp_path / "cut.p"
    assert cli(["cut", str(raw / "one.p"), "-o", str(out), "--n-records", "5"]) == 0 and pfile.Layout(out.read_bytes()).records == 5
    assert cli(["cut", str(raw / "none.p"), "-o", str(out)]) == 1


def test_streams(spark, tmp_path):
    from saltfinger.streaming import windows as stream

    rows = [("a", dt.datetime(2026, 1, 1) + dt.timedelta(seconds=i / 2), float(i)) for i in range(40)] + [("a", dt.datetime(2026, 1, 2), 0.0)]
    spark.createDataFrame(rows, "u string, ts timestamp, x double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("u string, ts timestamp, x double").parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    blocks = run(stream.block_means(source(), ["u"], ["x"], 4), "blocks")
    assert sorted(r.x for r in blocks) == [3.5, 11.5, 19.5, 27.5, 35.5]
    assert len(run(stream.sliding_means(source(), ["u"], ["x"], 4, 2), "slides")) == 11
    assert [(r.n, r.deepest) for r in run(stream.stretches(source(), ["u"], "x"), "stretches")] == [(40, 39.0)]
    from saltfinger.functions import kernels

    got = [r.filtered for r in sorted(run(stream.low_pass(source(), "u", "x", 2.0, 0.2), "filtered"), key=lambda r: r.ts)]
    assert got == pytest.approx(kernels.sosfilt(kernels.butter1("low", 0.2, 2.0), np.array([r[2] for r in rows]))[0])


# queries


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 60


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, small, name):
    import duckdb

    got = QUERIES[name](spark, small).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    plain = lambda df: df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).map(lambda x: float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x))
    a, b = (plain(x).sort_values(sorted(x.columns), kind="stable").reset_index(drop=True) for x in (got, want))
    assert (a == b).all().all(), a[(a != b).any(axis=1)].head().to_string() + b[(a != b).any(axis=1)].head().to_string()


def test_entry_without_the_other_packages(spark):
    import __spark_entry__

    assert "bin_profiles" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_detected_profiles_of_flat_tops_are_those_of_the_sql(spark, tmp_path):
    """Two and three equal samples at a top are no peak in the SQL."""
    import duckdb

    values = [0, 300, 300, 0, 250, 10, 400, 20, 280, 280, 280, 5, 320, 0, 0, 0, 310, 1.0]
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(seconds=i), 1, "view", float(v), None) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in QUERIES["detect_profiles"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == sorted(con.execute(ORACLES["detect_profiles"]).fetchall()) and len(got) == 8
    assert profiles.find_peaks(np.array(values)).tolist() == [1, 4, 6, 9, 12, 16]
    assert profiles.find_peaks(np.array(values), plateau=(2, 2)).tolist() == [1]
