"""Kernels against independent definitions and signals with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikelake.functions import signal, stats
from spikelake.operators import kernels, maps


def test_bandpass_and_butterworth_pass_their_band():
    fs, t = 1000.0, np.arange(4000) / 1000
    for f in (lambda x: signal.convolved(x, signal.bandpass_taps(100, 250, fs)), lambda x: signal.butterworth(x, 100, 250, fs)):
        gain = {hz: np.std(f(np.sin(2 * np.pi * hz * t))[1000:3000]) * math.sqrt(2) for hz in (20, 170, 400)}
        assert gain[170] == pytest.approx(1, abs=0.02) and gain[20] < 0.01 and gain[400] < 0.02
    with pytest.raises(ValueError):
        signal.bandpass_taps(100, 600, fs)


def test_notch_detrend_resample():
    fs, t = 500.0, np.arange(5000) / 500
    x = np.sin(2 * np.pi * 50 * t) + np.sin(2 * np.pi * 7 * t)
    y = signal.notch(x, 50, fs)[1000:4000]
    assert np.abs(y - np.sin(2 * np.pi * 7 * t)[1000:4000]).max() < 0.05
    assert np.abs(signal.detrended(3 * t + 2)).max() < 1e-9
    z = signal.resampled(np.sin(2 * np.pi * 2 * t), 10)
    assert len(z) == 500 and np.abs(z - np.sin(2 * np.pi * 2 * t)[::10])[50:450].max() < 0.01


@pytest.mark.parametrize("periodic", [True, False])
def test_density_of_a_sine_and_of_noise(periodic):
    fs = 500.0
    x = np.sin(2 * np.pi * 5 * np.arange(1000) / fs)
    freqs, p = signal.density(x[None], fs, periodic, not periodic)
    assert freqs[p[0].argmax()] == 5 and p[0].sum() * freqs[1] == pytest.approx(0.5, rel=0.02)
    noise = np.random.default_rng(1).standard_normal((200, 1000))
    freqs, p = signal.density(noise, fs, periodic)
    assert p.mean(0).sum() * freqs[1] == pytest.approx(1, rel=0.03)


def test_smoothing():
    x = np.arange(30.0) ** 3
    assert np.allclose(signal.savitzky_golay(x), x)
    y = np.array([0.0] * 10 + [np.nan] + [0.0] * 10)
    assert np.isnan(signal.gaussian_smoothed(y, 2.0)).sum() == 1
    rng = np.random.default_rng(2)
    v = rng.random(60)
    plain = v.copy()
    for i in range(7, 53):
        plain[i] = plain[i - 7 : i + 8].mean()
    assert np.allclose(signal.smoothed_in_place(v), plain)
    assert signal.peaks(np.array([0, 1, 0, 3, 3, 0, 2, 0.0])).tolist() == [1, 3, 6] and signal.peaks(np.array([0, 1, 0, 3, 3, 0, 2, 0.0]), 3, 1.5).tolist() == [3, 6]
    f = signal.instantaneous_frequency(np.sin(2 * np.pi * 8 * np.arange(1000) / 250), 250)
    assert f[100:900].mean() == pytest.approx(8, abs=0.01)


def test_distributions():
    for df in (2, 8):
        x = np.array([0.5, 4.0, 12.0])
        grid = np.linspace(0, 400, 400_001)
        pdf = grid ** (df / 2 - 1) * np.exp(-grid / 2) / (2 ** (df / 2) * math.gamma(df / 2))
        assert np.allclose(stats.chi2_tail(x, df), [pdf[grid >= v].sum() * 0.001 for v in x], atol=2e-3)
    # Student's t with 2 degrees of freedom: P(|t| > 4.303) = 0.05; with 10: 2.228.
    for n, t in ((4, 4.30265), (12, 2.22814)):
        r = t / math.sqrt(n - 2 + t * t)
        assert stats.correlation_p(r, n) == pytest.approx(0.05, abs=1e-5)
    rng = np.random.default_rng(3)
    p = [stats.shapiro_wilk(rng.standard_normal(40))[1] for _ in range(300)]
    assert 0.02 < np.mean(np.array(p) < 0.05) < 0.09 and stats.shapiro_wilk(rng.exponential(1, 60))[1] < 0.001
    assert stats.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-5)


def test_rate_map_kernel_is_the_dataframe_one(spark):
    rng = np.random.default_rng(5)
    bins, occ, fired = rng.integers(0, 48, 600), rng.random(600), rng.integers(0, 600, 90)
    rate, seconds = kernels.rate_map(bins, occ, fired, (8, 6))
    frames = spark.createDataFrame([(int(b) // 6, int(b) % 6, float(o)) for b, o in zip(bins, occ)], "bx long, by_ long, o double")
    hits = spark.createDataFrame([(int(bins[i]) // 6, int(bins[i]) % 6) for i in fired], "bx long, by_ long")
    m = maps.smoothed(maps.rates(frames.groupBy("bx", "by_").agg(F.sum("o").alias("occ")), hits, [], 1.0), [])
    for r in m.collect():
        assert rate[r.bx, r.by_] == pytest.approx(r.smooth) and (seconds[r.bx, r.by_] > 0) == r.valid
    assert maps.information(m, []).first().sir == pytest.approx(kernels.information(rate, seconds))


def test_information_of_known_maps(spark):
    """Spikes in one of four bins: 2 bits, sparsity 1/4; the same rate everywhere: 0 and 1."""
    one = spark.createDataFrame([(i, 0, 10.0, True, 4.0 * (i == 0)) for i in range(4)], "bx int, by_ int, occ double, valid boolean, smooth double")
    r = maps.information(one, []).first()
    assert (r.sir, r.sparsity) == (2.0, 0.25)
    r = maps.information(one.withColumn("smooth", F.lit(3.0)), []).first()
    assert (r.sir, r.sparsity) == (0.0, 1.0)


def test_shuffles_tell_place_cells(spark):
    rng = np.random.default_rng(6)
    path = np.abs((np.arange(3000) // 15) % 62 - 31)
    rows = []
    for unit, fires in ((1, np.flatnonzero((path == 12) & (rng.random(3000) < 0.6))), (2, rng.choice(3000, 120, replace=False)), (3, np.array([], int))):
        rows.append((unit, path.tolist(), [0.1] * 3000, fires.tolist()))
    units = spark.createDataFrame(rows, "unit int, bins array<long>, occ array<double>, spikes array<long>")
    out = kernels.shuffled_information(units, ["unit"], 32, 1, 10.0, draws=100)
    got = {r.unit: r for r in out.collect()}
    assert got[1].significant and not got[2].significant and got[3].sir == 0 and got[3].null_mean is None
    assert {r.unit: r for r in out.collect()} == got


def test_fields_and_clusters(spark):
    rate = np.zeros((10, 10))
    rate[1:4, 1:4], rate[6:9, 6:9], rate[4, 4] = 5, 3, 2
    valid = np.ones((10, 10), bool)
    found = kernels.fields(rate, valid)
    assert [int(m.sum()) for m in found] == [10, 9] and [int(m.sum()) for m in kernels.fields(rate, valid, diagonal=False)] == [9, 9]
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.standard_normal((40, 8)) + 6, rng.standard_normal((300, 8))])
    files = spark.createDataFrame([(1, [1] * 40 + [0] * 300, points.tolist())], "file int, labels array<long>, points array<array<double>>")
    r = next(r for r in kernels.cluster_null(files, "file", 8, 100).collect() if r.cluster == 1)
    assert r.l_ratio < 0.01 and r.iso > 50 and r.p_l < 0.02 and r.p_iso < 0.02


def test_speed_line(spark):
    rng = np.random.default_rng(8)
    speed = 5 * np.round(5 + 4.5 * np.sin(np.arange(6000) / 300)) + 2.5
    units = spark.createDataFrame([(1, speed.tolist(), ((2 * speed + 1) / 30).tolist()), (2, speed.tolist(), rng.poisson(0.5, 6000).astype(float).tolist()), (3, [1.5, 1.5], [0.0, 0.0])], "unit int, speed array<double>, n array<double>")
    got = {r.unit: r for r in kernels.speed_modulation(units, ["unit"], 30.0, draws=60).collect()}
    assert got[1].slope == pytest.approx(2, rel=0.1) and got[1].r > 0.99 and got[1].modulated and not got[2].modulated and got[3].slope is None


def test_parameterised_spectrum(spark):
    f = np.arange(1, 101, 0.5)
    y = 2 - 1.5 * np.log10(f) + 0.8 * np.exp(-((f - 8) ** 2) / (2 * 1.2**2))
    rows = spark.createDataFrame([(1, f.tolist(), (10**y).tolist()), (2, f.tolist()[:3], [1.0] * 3)], "file int, freqs array<double>, power array<double>")
    got = {r.file: r for r in kernels.parameterised(rows, ["file"], knee=False).collect()}
    assert got[1].exponent == pytest.approx(1.5, abs=0.05) and got[1].r_squared > 0.99 and got[2].exponent is None
    assert [round(p[0]) for p in got[1].peaks] == [8] and got[1].peaks[0][1] == pytest.approx(0.8, abs=0.1)


def test_wave_features_and_intrinsic_firing(spark):
    rng = np.random.default_rng(9)
    shape = np.sin(np.arange(32) / 5)
    waves = [(shape * a + rng.standard_normal(32) * 0.1).tolist() for a in rng.random(60) + 0.5]
    r = kernels.wave_features(spark.createDataFrame([(1, waves)], "file int, waves array<array<double>>"), "file").first()
    assert r.energy == pytest.approx([float(np.sqrt(np.mean(np.square(w)))) for w in waves]) and abs(np.mean(r.pc1)) < 1e-9
    t = (np.arange(200) - 99.5) * 0.005
    rows = spark.createDataFrame([(1, (10 + 5 * np.cos(2 * np.pi * 8 * t)).tolist()), (2, [1.0] * 200)], "unit int, counts array<double>")
    got = {r.unit: r for r in kernels.intrinsic_firing(rows, "unit", 0.005).collect()}
    assert got[1].theta_freq == 8 and got[1].theta_z > 5 and got[1].mean_freq == pytest.approx(8, abs=0.8) and got[1].mode_freq == 8 and got[2].theta_freq is None


def test_iterative_fields_find_both_fields(spark):
    rng = np.random.default_rng(10)
    path = np.abs((np.arange(6000) // 15) % 62 - 31)
    fires = np.flatnonzero(((np.abs(path - 8) < 2) & (rng.random(6000) < 0.8)) | ((np.abs(path - 24) < 2) & (rng.random(6000) < 0.5)))
    units = spark.createDataFrame([(1, path.tolist(), [0.1] * 6000, fires.tolist()), (2, path.tolist(), [0.1] * 6000, rng.choice(6000, 300, replace=False).tolist())], "unit int, bins array<long>, occ array<double>, spikes array<long>")
    got = {r.unit: r for r in kernels.iterative_fields(units, ["unit"], 32, 1, 10.0, draws=40).collect()}
    assert got[1].n_fields == 2 and got[1].left[-1] < 0.5 and got[2].n_fields == 0


def test_shuffles_of_a_suppressed_map():
    """The null with bins clamped is that of the plain map with the same bins clamped."""
    rng = np.random.default_rng(11)
    bins, occ, spikes, taken = rng.integers(0, 48, 900), np.full(900, 0.1), rng.integers(0, 900, 200), rng.random((8, 6)) < 0.2
    seconds, shifts = np.bincount(bins, occ, 48).reshape(8, 6), np.arange(20, 880, 40)
    for mask in (taken, np.zeros_like(taken)):
        want = []
        for k in shifts:
            rate, s = kernels.rate_map(bins, occ, (spikes + k) % 900, (8, 6), 1.0)
            want.append(kernels.information(np.where(mask, 0.7, rate), s))
        assert kernels.shifted_information(bins, seconds, spikes, shifts, 1.0, mask, 0.7) == pytest.approx(want)


def test_iterative_fields_have_no_cap_and_need_a_place_cell(spark):
    """Twelve narrow fields are all found; a unit of few spikes or too high a rate has none."""
    path = np.abs((np.arange(48_000) // 20) % 238 - 119)
    on = np.isin(path, np.arange(4, 120, 10)) & (np.arange(48_000) % 20 < 16)
    few = np.flatnonzero(on)[::100][:50]
    units = spark.createDataFrame([(i, path.tolist(), [0.1] * 48_000, np.flatnonzero(on).tolist() if i < 2 else few.tolist()) for i in (1, 2)], "unit int, bins array<long>, occ array<double>, spikes array<long>")
    run = lambda **o: {r.unit: r.n_fields for r in kernels.iterative_fields(units, ["unit"], 120, 1, 10.0, draws=60, smallest=0.01, limit=0.0, **o).collect()}
    assert run() == {1: 12, 2: 0} and run(peaks=(1.0, 3.0)) == {1: 0, 2: 0}


def test_largest_field(spark):
    rate = np.full((16, 12), 0.1)
    rate[1:13, 1] = 5  # the largest group, without a full block
    rate[1:5, 4:7] = 4
    rate[7:10, 4:7] = 10
    rate[5, 7] = 4  # by a corner only
    valid = np.ones_like(rate, bool)
    found = kernels.largest_field(rate, valid)
    want = np.zeros_like(valid)
    want[7:10, 4:7] = True
    assert len(found) == 1 and found[0].sum() == 9 and (found[0] == want).all()  # 4 isn't above 10 / 2.5
    rate[1:5, 4:7] = rate[5, 7] = 4.1
    assert [int(m.sum()) for m in kernels.largest_field(rate, valid)] == [12]
    rate[1:10, 4:7] = 0.1
    assert kernels.largest_field(rate, valid) == [] and kernels.largest_field(rate * 0, valid) == []


@pytest.mark.parametrize("method,width,whole", [("in_place", 15, lambda x: signal.smoothed_in_place(x, 15)), ("in_place", 5, lambda x: signal.smoothed_in_place(x, 5)), ("gaussian", 2.0, lambda x: signal.gaussian_smoothed(x, 2.0)), ("polynomial", 11, lambda x: np.maximum(signal.savitzky_golay(x, 11), 0))])
def test_smoothing_in_blocks_is_that_of_whole_traces(spark, method, width, whole):
    rng = np.random.default_rng(13)
    xs = {k: rng.standard_normal(n).cumsum() + 3 for k, n in enumerate((1, 9, 14, 15, 16, 40, 203, 1207))}
    if method == "gaussian":
        xs[6][[0, 50, 51, 202]] = np.nan
    long = spark.createDataFrame([(k, i, float(v)) for k, x in xs.items() for i, v in enumerate(x)], "c int, i long, v double").repartition(4)
    for length in (16, 100, 1 << 16):
        got = {(r.c, r.i): r.v for r in kernels.smoothed(long, "c", "i", "v", method, width, length).collect()}
        assert len(got) == sum(map(len, xs.values()))
        for k, x in xs.items():
            assert np.allclose([got[k, i] for i in range(len(x))], whole(x), rtol=1e-12, atol=1e-12, equal_nan=True), (k, length)


def test_blocks_give_the_values_of_the_whole_trace(spark):
    rng = np.random.default_rng(12)
    xs = {1: rng.standard_normal(20_011).cumsum() / 50 + rng.standard_normal(20_011), 2: rng.standard_normal(7)}
    long = spark.createDataFrame([(k, i, float(v)) for k, x in xs.items() for i, v in enumerate(x)], "c int, i long, v double").repartition(4)
    taps = signal.bandpass_taps(100, 250, 1000)
    got = {(r.c, r.i): r.v for r in kernels.bandpassed(long, "c", "i", "v", 100, 250, 1000, 1500).collect()}
    assert len(got) == sum(map(len, xs.values()))
    for k, x in xs.items():
        assert np.allclose([got[k, i] for i in range(len(x))], signal.convolved(x, taps), atol=1e-10)
    x = signal.notch(signal.butterworth(signal.resampled(xs[1], 2), 2, 40, 100), 30, 100)
    freqs, power = signal.density(x[: len(x) // 100 * 100].reshape(-1, 100), 100)
    for epochs in (7, 1000):
        found = {r.epoch: r for r in kernels.spectra(long, "c", "i", "v", 200.0, 1.0, notches=(30.0,), down=2, band=(2.0, 40.0), epochs=epochs).collect()}
        assert sorted(found) == list(range(100)) and found[3].c == 1 and found[0].freqs == pytest.approx(freqs.tolist())
        got = np.array([found[e].power for e in range(100)])
        assert np.allclose(got[10:90], power[10:90], rtol=1e-6, atol=1e-12) and np.allclose(got, power, rtol=0, atol=1e-4)
    cut = {(r.c, r.block): (r.start, len(r.samples)) for r in kernels.blocks(long, "c", "i", "v", 10_000, 20).collect()}
    assert cut == {(1, 0): (0, 10_020), (1, 1): (9980, 10_031), (1, 2): (19_980, 31), (2, 0): (0, 7)}


def test_spectra_without_peaks(spark):
    """All peaks of a task may be empty lists, and all its fits null."""
    freqs = [float(k) for k in range(1, 101)]
    rows = spark.createDataFrame([(1, freqs, [1000.0 / k for k in freqs]), (2, freqs[:3], [1.0, 2.0, 3.0])], "file long, freqs array<double>, power array<double>")
    a, b = kernels.parameterised(rows, ["file"], knee=False).orderBy("file").collect()
    assert a.peaks == [] and a.exponent == pytest.approx(1, abs=1e-3) and a.offset == pytest.approx(3, abs=1e-3)
    assert b.offset is None and b.peaks is None
    assert kernels.parameterised(rows.filter("file = 2"), ["file"], knee=False).first().error is None


def test_fits_stay_where_slopes_are_not_finite():
    with np.errstate(all="ignore"):
        assert kernels.least_squares(lambda q: np.sqrt(1 - q) + 1, np.array([1.0])) == [1.0]  # an error of the solver before
        assert kernels.least_squares(lambda q: q - 5, np.array([1.0]), slopes=lambda q, step: np.full((1, 1), np.inf)) == [1.0]
