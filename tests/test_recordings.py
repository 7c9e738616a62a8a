"""Alignment, bad channels, bands and scans against known signals and whole traces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikelake.functions import signal
from spikelake.operators import recordings

FS = 1000.0


def long(spark, xs):
    return spark.createDataFrame([(int(c), i, float(v)) for c, x in xs.items() for i, v in enumerate(x)], "c int, i long, v double").repartition(4)


def values(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.c, r.i)):
        out.setdefault(r.c, []).append(r.v)
    return {c: np.array(v) for c, v in out.items()}


def test_a_known_delay_is_undone(spark):
    wave = lambda t: np.sin(2 * np.pi * 37 * t / FS) + 0.5 * np.cos(2 * np.pi * 211 * t / FS + 1) + 3
    n, shifts = np.arange(6000), {0: 0.0, 1: 1 / 3, 2: 0.9}
    rows = long(spark, {c: wave(n + s) for c, s in shifts.items()})
    table = spark.createDataFrame(list(shifts.items()), "c int, shift double")
    inner = slice(signal.REACH, -signal.REACH)  # a trace's own ends have no samples beyond them
    for length in (1500, 1 << 15):
        got = values(recordings.aligned(rows, table, "c", "i", "v", length=length))
        assert all(np.abs(got[c] - wave(n))[inner].max() < 1e-6 for c in shifts)
    assert max(np.abs(values(rows)[c] - wave(n))[inner].max() for c in (1, 2)) > 0.1


def probe(rng, n):
    """Twenty channels that share a slow signal; 6 is dead, 13 hisses, 17 is flat."""
    common = np.cumsum(rng.standard_normal(n)) * 0.05 + np.sin(2 * np.pi * 8 * np.arange(n) / FS)
    xs = {c: common * (1 + 0.02 * c) + 0.05 * rng.standard_normal(n) for c in range(20)}
    xs[6], xs[13], xs[17] = 0.05 * rng.standard_normal(n), xs[13] + rng.standard_normal(n) * 0.5, np.zeros(n)
    return xs


def test_bad_channels_are_found(spark):
    rows = long(spark, probe(np.random.default_rng(1), 4000))
    channels = spark.createDataFrame([(c, 20.0 * c, 0.0) for c in range(21)], "c int, depth double, shift double")  # 20 has no samples
    quality = recordings.channel_quality(rows, channels, "c", "i", "v", FS, length=1000)
    verdicts = {r.c: r.verdict for r in recordings.judged_channels(quality, "c").collect()}
    assert {c for c, v in verdicts.items() if v == "dead"} == {6, 17, 20} and {c for c, v in verdicts.items() if v == "noisy"} == {13} and len(verdicts) == 21


def test_band_reference_and_rate_are_those_of_whole_traces(spark):
    rng = np.random.default_rng(2)
    xs = {c: rng.standard_normal(9000).cumsum() * 0.1 for c in range(3)}
    got = values(recordings.banded(long(spark, xs), "c", "i", "v", 20, 200, FS, length=1500))
    assert all(np.allclose(got[c][1500:7500], signal.butterworth(x, 20, 200, FS, 5)[1500:7500], atol=1e-8) for c, x in xs.items())
    middle = np.median(np.stack(list(xs.values())), 0)
    got = values(recordings.referenced(long(spark, xs), "c", "i", "v"))
    assert all(np.allclose(got[c], x - middle) for c, x in xs.items())
    got = values(recordings.resampled(long(spark, xs), "c", "i", "v", 5, length=300))
    assert all(np.allclose(got[c], signal.resampled(x, 5)) for c, x in xs.items())


def test_preprocessed_leaves_what_channels_don_t_share(spark):
    rng = np.random.default_rng(3)
    xs = probe(rng, 4000)
    own = np.sin(2 * np.pi * 60 * np.arange(4000) / FS)
    xs[3] = xs[3] + own
    channels = spark.createDataFrame([(c, 20.0 * c, 0.0) for c in range(20)], "c int, depth double, shift double")
    got = values(recordings.preprocessed(long(spark, xs), channels, "c", "i", "v", FS, 20.0, 200.0, down=2, length=1 << 10))
    assert set(got) == set(range(20)) - {6, 13, 17} and all(len(v) == 2000 for v in got.values())
    power = {c: v[200:-200].std() for c, v in got.items()}
    assert max(power, key=power.get) == 3 and power[3] == pytest.approx(own.std(), rel=0.1)


@pytest.mark.parametrize("bins", [1, 4, 100])
def test_scan(spark, bins):
    rng = np.random.default_rng(4)
    xs = {c: rng.standard_normal(2350) * (1 + c) for c in range(5)} | {5: np.ones(150)}
    for x in list(xs.values())[:5]:
        x[700:800] *= 40
    scan = recordings.scanned(long(spark, xs), "c", "i", "v", 100.0, 1.0, (3.0, 7.0), bins)
    got = {(r.c, r.bin): (r.sd, r.power) for r in scan.collect()}
    want = {}
    for c, x in xs.items():
        for b in range(len(x) // 100):
            freqs, p = signal.density(x[None, b * 100 : b * 100 + 100], 100.0)
            on = (freqs >= 3) & (freqs <= 7)
            want[c, b] = (x[b * 100 : b * 100 + 100].std(), np.trapezoid(p[0][on], freqs[on]))
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    noise = recordings.bin_noise(scan)
    assert [r.bin for r in noise.filter("noisy").collect()] == [7]
    db = {r.c: r.db for r in recordings.depth_power(scan, noise, "c").collect()}
    clean = {c: np.mean([want[k][1] for k in want if k[0] == c and k[1] != 7]) for c in xs}
    assert all(db[c] == pytest.approx(10 * np.log10(clean[c] + 1e-12)) for c in xs)
    assert recordings.scanned(long(spark, {0: np.ones(50)}), "c", "i", "v", 100.0).count() == 0
    assert scan.filter(F.col("bin") < 0).count() == 0
