"""Speed scores, cluster nulls and waveforms against plain versions."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikelake.functions import signal, stats
from spikelake.operators import clusters, kernels, spikes


def plain_line(x, y, w):
    a, b = sum(w * x) / sum(w), sum(w * y) / sum(w)
    xx, xy, yy = sum(w * (x - a) ** 2), sum(w * (x - a) * (y - b)), sum(w * (y - b) ** 2)
    return xy / xx, b - xy / xx * a, xy / math.sqrt(xx * yy) if yy > 0 else math.nan


def plain_means(speed, rate, low, high, width, rare):
    edges = np.arange(low, high + width, width)
    on = (speed > low) & (speed < high)
    at = np.clip(np.digitize(speed[on], edges) - 1, 0, len(edges) - 2)
    out = []
    for b in range(len(edges) - 1):
        sel = at == b
        if sel.sum() and sel.sum() / on.sum() >= rare:
            out.append(((edges[b] + edges[b + 1]) / 2, rate[on][sel].mean(), float(sel.sum())))
    return tuple(map(np.array, zip(*out)))


@pytest.mark.parametrize("counts", [False, True])
def test_speed_modulation_is_the_plain_one(spark, counts):
    rng, fps, n = np.random.default_rng(1), 30.0, 3000
    speed = np.abs(25 + 60 * np.convolve(rng.standard_normal(n + 99), np.full(100, 0.1), "valid") / 10 + 2 * rng.standard_normal(n))
    units = {1: rng.poisson((2 + 0.3 * speed) / fps).astype(float), 2: rng.poisson(0.2, n).astype(float), 3: np.zeros(n)}
    df = spark.createDataFrame([(k, speed.tolist(), c.tolist()) for k, c in units.items()], "unit int, speed array<double>, n array<double>")
    got = {r.unit: r for r in kernels.speed_modulation(df, ["unit"], fps, draws=120, margin=10.0, width=4.0, low=2.0, high=60.0, counts=counts).collect()}
    smooth = lambda x: signal.gaussian_smoothed(x, 0.3 * fps)
    v = speed if counts else smooth(speed)
    one = lambda rate: plain_line(*(m := plain_means(v, rate, 2.0, 60.0, 4.0, 0.002))[:2], np.ones(len(m[0])) if counts else m[2])
    for k in (1, 2):
        rate = smooth(units[k] * fps)
        slope, intercept, r = one(rate)
        shifts = np.random.default_rng(zlib.crc32(repr((k,)).encode())).integers(300, n - 300 + 1, 120)
        null = np.array([one(smooth(np.roll(units[k], s) * fps) if counts else np.roll(rate, s))[2] for s in shifts])
        p = ((np.abs(null) >= abs(r)).sum() + 1) / 121
        low, high = np.percentile(null, [2.5, 97.5])
        assert (got[k].slope, got[k].intercept, got[k].r, got[k].shuffle_p, got[k].shuffle_mean) == pytest.approx((slope, intercept, r, p, null.mean()))
        assert got[k].n_null == 120 and got[k].modulated == (bool(r < low or r > high) if counts else p < 0.05)
        assert (got[k].shuffle_low, got[k].shuffle_high) == (pytest.approx((low, high)) if counts else (None, pytest.approx(np.percentile(np.abs(null), 95))))
        x = plain_means(v, rate, 2.0, 60.0, 4.0, 0.002)[0]
        assert got[k].p == pytest.approx(stats.correlation_p(r, len(x)))
    assert got[1].modulated and got[3].r is None and got[3].modulated is None


def test_speed_null_needs_draws_and_time(spark):
    rng = np.random.default_rng(2)
    speed, n = np.abs(rng.standard_normal(400).cumsum()) % 50, rng.poisson(1, 400).astype(float)
    df = spark.createDataFrame([(1, speed.tolist(), n.tolist())], "unit int, speed array<double>, n array<double>")
    few = kernels.speed_modulation(df, ["unit"], 30.0, draws=99, margin=2.0, counts=True).first()
    assert few.n_null == 99 and few.modulated is None and few.shuffle_p is None and few.r is not None
    short = [kernels.speed_modulation(df, ["unit"], 30.0, draws=100, margin=20.0, counts=c).first() for c in (False, True)]
    assert short[0].n_null == 100 and short[0].modulated is not None and short[1].n_null is None and short[1].modulated is None


def test_cluster_null_is_the_plain_one(spark):
    rng, df = np.random.default_rng(3), 4
    points = np.concatenate([rng.standard_normal((30, df)) + 4, rng.standard_normal((90, df)), rng.standard_normal((20, df)) * 0.5 + 1])
    labels = np.repeat([1, 2, 3], [30, 90, 20])
    files = spark.createDataFrame([("f", labels.tolist(), points.tolist())], "file string, labels array<long>, points array<array<double>>")
    got = {r.cluster: r for r in kernels.cluster_null(files, "file", df, 50).collect()}

    def measures(own):
        inverse = np.linalg.pinv(np.cov(points[own].T) + 1e-10 * np.eye(df))
        d2 = np.array([(p - points[own].mean(0)) @ inverse @ (p - points[own].mean(0)) for p in points])
        noise = np.sort(d2[~own])
        tail = [math.exp(-x / 2) * (1 + x / 2) for x in noise]
        return sum(tail) / own.sum(), noise[own.sum() - 1] if own.sum() <= len(own) / 2 else math.nan, d2

    for c in (1, 3):
        own = labels == c
        lr, iso, d2 = measures(own)
        n, others = own.sum(), np.flatnonzero(~own)
        near = others[np.argsort(d2[others], kind="stable")][: 3 * n]
        draw, null = np.random.default_rng(zlib.crc32(repr(("f", c)).encode())), []
        for _ in range(50):
            fake = np.zeros(len(own), bool)
            fake[draw.choice(near, n, replace=False)] = True
            null.append(measures(fake)[:2])
        null = np.array(null)
        r = got[c]
        assert (r.n, r.pool, r.n_valid) == (n, len(near), 50) and (r.l_ratio, r.iso) == pytest.approx((lr, iso))
        assert (r.null_l, r.null_iso, r.sd_l, r.sd_iso) == pytest.approx((*null.mean(0), *null.std(0, ddof=1)))
        assert (r.z_l, r.z_iso) == pytest.approx(((null[:, 0].mean() - lr) / r.sd_l, (iso - null[:, 1].mean()) / r.sd_iso))
        assert (r.p_l, r.p_iso) == pytest.approx((((null[:, 0] <= lr).sum() + 1) / 51, ((null[:, 1] >= iso).sum() + 1) / 51))
    assert got[2].pool == 0 and got[2].n_valid == 0 and got[2].iso is None and got[2].p_l is None and got[2].l_ratio is not None


def test_isolation_by_ranges_is_the_nth_distance(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c, (nc, n) in enumerate([(3, 40), (20, 40), (21, 40), (1, 2), (5, 12)]):
        d2 = rng.choice([0.0, 1.0, 1.001, 2.5, 1e-9, 7e8], n) if c else rng.random(n) * 50
        rows += [("f", c, k, k < nc, nc, n, float(d)) for k, d in enumerate(d2)]
    got = {r.cluster: r.iso for r in clusters.isolation(spark.createDataFrame(rows, "file string, cluster int, key int, own boolean, nc long, n long, d2 double").repartition(3), "key").collect()}
    for c in range(5):
        own = [r for r in rows if r[1] == c]
        noise = sorted(r[6] for r in own if not r[3])
        assert got[c] == (noise[own[0][4] - 1] if 2 * own[0][4] <= own[0][5] else None)


def plain_gridded(x, y, t, ts, fps, low=4.0, high=100.0, width=2.0, rare=0.01, window=0.08):
    speed = [math.hypot(x[k + 1] - x[k], y[k + 1] - y[k]) * fps for k in range(len(x) - 1)]
    speed.append(speed[-1])
    grid = []
    while t[0] + len(grid) * 1000 / fps <= t[-1] + 1e-9:
        grid.append(t[0] + len(grid) * 1000 / fps)
    counts = [0.0] * len(grid)
    for s in ts:
        for k, g in enumerate(grid):
            if (k + 1 < len(grid) and g <= s < grid[k + 1]) or (k + 1 == len(grid) and s == g):
                counts[k] += fps
    taps = int(round(window * fps))
    pad = 3 * (taps - 1)
    z = [2 * counts[0] - counts[k] for k in range(pad, 0, -1)] + counts + [2 * counts[-1] - counts[-1 - k] for k in range(1, pad + 1)]
    for _ in range(2):
        z = [sum(z[max(0, k - j)] for j in range(taps)) / taps for k in range(len(z))][::-1]
    rate = z[pad : pad + len(counts)][: len(ts)]
    n = min(len(rate), len(speed))
    pairs = [(speed[k], rate[k]) for k in range(n) if low < speed[k] < high]
    bins = {}
    for v, r in pairs:
        bins.setdefault(int((v - low) // width), []).append(r)
    kept = {b: r for b, r in bins.items() if len(r) >= rare * len(pairs)}
    a, b = np.array([low + (k + 0.5) * width for k in sorted(kept)]), np.array([np.mean(kept[k]) for k in sorted(kept)])
    return np.corrcoef(*np.array(pairs).T)[0, 1], len(kept), *plain_line(a, b, np.ones(len(a)))


@pytest.mark.parametrize("fps,window", [(25.0, 0.08), (50.0, 0.12), (10.0, 0.08)])
def test_gridded_speed(spark, fps, window):
    rng, n = np.random.default_rng(5), 900
    heading, v = rng.standard_normal(n).cumsum() * 0.2, np.abs(rng.standard_normal(n).cumsum()) % 60 / fps
    x, y, t = np.cumsum(v * np.cos(heading)), np.cumsum(v * np.sin(heading)), np.arange(n) * 1000 / fps + 7
    ts = np.sort(np.concatenate([rng.choice(t, 300), rng.random(1200) * t[-1] * 1.1, [t[-1]]]))
    rows = [(1, x.tolist(), y.tolist(), t.tolist(), ts.tolist()), (2, [1.0], [1.0], [0.0], []), (3, [1.0] * 9, [1.0] * 9, t[:9].tolist(), [50.0])]
    df = spark.createDataFrame(rows, "unit int, x array<double>, y array<double>, t array<double>, spikes array<double>")
    got = {r.unit: r for r in kernels.gridded_speed(df, ["unit"], fps, window).collect()}
    want = plain_gridded(x, y, t, ts, fps, window=window)
    assert (got[1].raw_r, got[1].n_bins, got[1].slope, got[1].intercept, got[1].r) == pytest.approx(want) and got[1].n_bins > 5
    assert got[1].p == pytest.approx(stats.correlation_p(want[4], want[1])) and got[2].raw_r is None and got[3].raw_r is None


def plain_array_peaks(x, least):
    out = []
    for i in range(1, len(x) - 1):
        j = i
        while j < len(x) - 1 and x[j] == x[i]:
            j += 1
        if not (x[i - 1] < x[i] and x[j] < x[i]):
            continue
        low, cross = [], []
        for step in (-1, 1):
            k, least_of = i, x[i]
            while 0 <= k < len(x) and x[k] <= x[i]:
                least_of = min(least_of, x[k])
                k += step
            low.append(least_of)
        prominence = x[i] - max(low)
        level = x[i] - prominence / 2
        for step in (-1, 1):
            k = i
            while x[k] > level:
                k += step
            cross.append(abs(k - i) - (level - x[k]) / (x[k - step] - x[k]))
        if prominence >= least:
            out.append((x[i], -i, prominence, sum(cross)))
    return out


def test_array_peaks(spark):
    rng = np.random.default_rng(6)
    xs = [rng.integers(0, int(rng.integers(2, 20)), int(rng.integers(0, 30))).astype(float).tolist() for _ in range(120)]
    xs += [rng.standard_normal(32).cumsum().tolist() for _ in range(20)] + [[], [1.0], [1.0, 2.0], [0.0, 1.0, 0.0], [0.0, 2.0, 2.0, 1.0, 3.0]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x array<double>")
    for least in (0.0, 2.0):
        got = {r.k: [tuple(p) for p in r.p] for r in df.select("k", spikes.array_peaks(F.col("x"), least).alias("p")).collect()}
        for k, x in enumerate(xs):
            want = plain_array_peaks(x, least)
            assert len(got[k]) == len(want) and all(g == pytest.approx(w) for g, w in zip(got[k], want)), x


def test_wave_properties_of_known_waves(spark):
    """A triangle of height 40 over a base of 0, a dip of 20; a wave whose tail is flat; one that ends soon after its dip."""
    one = [0, 0, 10, 20, 30, 40, 20, 0, -10, -20, -10, 0, 0, 0, 0, 0, 0, 0, 0, 4, 0]
    flat = [0, 0, 10, 20, 30, 40, 20] + [0] * 14
    soon = [0] * 11 + [20, 40, 20, 0, -10, -20, -10, 0, 0, 0]
    rows = [(u, c, [float(x) * s * (1 if c == 2 else 0.5) for x in w]) for u, w in enumerate([one, flat, soon]) for c in (1, 2, 3) for s in (0.9, 1.1)]
    df = spark.createDataFrame(rows, "unit int, c int, wave array<double>")
    got = {r.unit: r for r in spikes.wave_properties(df, ["unit"], "c", "wave", 0.1, 60.0).collect()}
    r = got[0]
    assert (r.c, r.peak, r.trough, r.ratio) == (2, 40, -20, -2) and r.peak_to_trough == pytest.approx(0.5)
    assert r.width == pytest.approx(0.1 * plain_array_peaks(one, 15)[0][3])
    assert r.ahp_width == pytest.approx(0.1 * 2.4) and r.end_slope == pytest.approx((4 + 20) / (0.1 / 9))
    assert r.amplitude_rsd == pytest.approx(np.std([36, 44], ddof=1) / 40) and r.rate == pytest.approx(2 / 60)
    assert got[1].ahp_width is None and got[1].end_slope is None and got[1].width == pytest.approx(0.1 * plain_array_peaks(flat, 15)[0][3])
    assert got[2].ahp_width == pytest.approx(0.2) and got[2].end_slope is None


def test_theta_modulation(spark):
    rng = np.random.default_rng(7)
    theta = np.concatenate([np.arange(60) * 200_000 + rng.integers(-9000, 9000, 60), rng.integers(0, 12_000_000, 20)])
    rows = [(1, int(t)) for t in theta] + [(2, int(t)) for t in rng.integers(0, 12_000_000, 300)] + [(3, int(t)) for t in theta[:9]] + [(4, k * 10**9) for k in range(12)]
    found = spikes.theta_modulation(spark.createDataFrame(rows, "unit int, ts long"), "unit", "ts", 500_000.0, 5_000.0, 0.005)
    got = {r.unit: r for r in found.collect()}
    counts = np.zeros(200)
    for a in theta:
        for b in theta:
            if a != b and abs(b - a) <= 500_000:
                counts[min(199, int((b - a + 500_000) / 5_000))] += 1
    power = np.abs(np.fft.fft(counts)[:100]) ** 2
    assert got[1].best == pytest.approx(power[3:8].max()) and got[1].peak_freq == 5.0 and got[1].modulated == bool(power[3:8].max() > 2 * power.mean())
    assert got[1].n == 80 and not got[3].modulated and got[3].peak_freq is None and not got[4].modulated and got[4].best == 0 and not got[2].modulated


def test_rates_that_differ_by_rounding_have_no_correlation(spark):
    """A spike in every frame: smoothed rates differ in their last bits alone."""
    rows = spark.createDataFrame([(1, [float(10 + 7 * i % 60) for i in range(57)], [1.0] * 57), (2, [float(10 + 7 * i % 60) for i in range(57)], [0.0] * 57)], "u int, speed array<double>, n array<double>")
    for counts in (False, True):
        for fps in (4.0, 3.7, 1.3):
            for r in kernels.speed_modulation(rows, ["u"], fps, draws=10, margin=0.5, width=10.0, counts=counts).collect():
                assert r.r is None and r.p is None and r.rho is None and r.n_null is None, (counts, fps, r)
                assert r.slope == pytest.approx(0, abs=1e-9) and r.intercept == pytest.approx(fps * (r.u == 1))


def test_long_work_on_small_rows_is_spread(spark):
    rows = spark.createDataFrame([(k, [0, 1], [[0.0], [1.0]]) for k in range(50)], "file int, labels array<long>, points array<array<double>>").coalesce(1)
    assert kernels.cluster_null(rows, "file", 1, draws=0).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
