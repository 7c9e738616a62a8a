"""Peaks and phase profiles against plain loops."""

import cmath
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikelake.functions import signal
from spikelake.operators import extrema


def plain_peaks(x, distance=1):
    """(place, prominence) of each maximum that is far enough from higher ones."""
    n, top, i = len(x), [], 1
    while i < n - 1:
        j = i
        while j < n - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < n - 1 and x[j + 1] < x[i]:
            top.append((i + j) // 2)
        i = j + 1
    kept = []
    for i in sorted(top, key=lambda i: (x[i], i), reverse=True):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    out = []
    for i in sorted(kept):
        low = []
        for step in (-1, 1):
            k, least = i, x[i]
            while 0 <= k < n and x[k] <= x[i]:
                least = min(least, x[k])
                k += step
            low.append(least)
        out.append((i, x[i] - max(low)))
    return out


def random_trace(rng, n):
    x = rng.integers(0, rng.integers(2, 30), n).astype(float)
    kind = rng.integers(4)
    return [x, (x - x.mean()).cumsum().round(), np.repeat(x, rng.integers(1, 9))[:n], np.sort(x)][kind]


def test_peaks_of_an_array():
    rng = np.random.default_rng(1)
    for _ in range(1500):
        x, d, p = random_trace(rng, int(rng.integers(1, 80))), int(rng.integers(1, 12)), float(rng.integers(0, 4))
        assert signal.peaks(x, d, p).tolist() == [i for i, q in plain_peaks(x, d) if q >= p]
    began = time.process_time()
    assert len(signal.peaks(rng.standard_normal(1_000_000).cumsum(), 50, 1.0)) > 1000 and time.process_time() - began < 10


@pytest.mark.parametrize("length,distance,halo", [(7, 1, 2), (5, 4, 2), (16, 9, 2), (16, 3, None), (1000, 5, None)])
def test_peaks_in_blocks(spark, length, distance, halo):
    """Blocks smaller than plateaus, than the distance and than the way to something higher."""
    rng = np.random.default_rng(length)
    xs = {k: random_trace(rng, int(rng.integers(1, 130))) for k in range(40)}
    long = spark.createDataFrame([(k, i, float(v)) for k, x in xs.items() for i, v in enumerate(x)], "c int, i long, v double").repartition(4)
    got = {(r.c, r.i): (r.v, r.prominence) for r in extrema.peaks(long, "c", "i", "v", distance, length=length, halo=halo).collect()}
    assert got == {(k, i): (x[i], p) for k, x in xs.items() for i, p in plain_peaks(x, distance)}
    some = extrema.peaks(long, "c", "i", "v", distance, 3.0, length=length, halo=halo).count()
    assert some == sum(p >= 3 for x in xs.values() for _, p in plain_peaks(x, distance))
    assert extrema.peaks(long.limit(0), "c", "i", "v").count() == 0


def plain_profile(snips, fs, reference, distance, guard, share, signed):
    total, count, periods = {}, {}, []
    for snip in snips:
        def times(x):
            limit = max(share * np.std(x), 1e-9)
            return [i / fs for i, p in plain_peaks(x, max(1, int(distance * fs))) if p >= limit]

        ref = [t for t in times(snip[reference]) if t >= guard] if reference in snip else []
        if len(ref) < 2:
            continue
        period = float(np.median(np.diff(ref)))
        periods.append(period)
        for c, x in snip.items():
            after = [t for t in times(x) if t >= ref[0]]
            if after:
                total[c] = total.get(c, 0) + cmath.exp(2j * math.pi * ((after[0] - ref[0]) % period) / period)
                count[c] = count.get(c, 0) + 1
    out = {}
    for c in total:
        phase = cmath.phase(total[c])
        phase = phase if signed else phase % (2 * math.pi)
        out[c] = (phase, abs(total[c]) / count[c], count[c], phase / (2 * math.pi) * np.mean(periods))
    return out


@pytest.mark.parametrize("signed", [True, False])
def test_phase_profile(spark, signed):
    rng, fs = np.random.default_rng(2), 100.0
    t = np.arange(300) / fs
    snips = [{c: np.sin(2 * np.pi * (5 * t - 0.04 * c + rng.random() * 0.02) + s) + 0.1 * rng.standard_normal(300) for c in range(4) if (s, c) not in ((1, 0), (2, 3))} for s in range(4)]
    snips.append({c: np.zeros(300) for c in range(4)})
    rows = [(s, c, i, float(v)) for s, snip in enumerate(snips) for c, x in snip.items() for i, v in enumerate(x)]
    long = spark.createDataFrame(rows, "snippet int, channel int, i long, v double").repartition(3)
    want = plain_profile(snips, fs, 0, 0.1, 0.2, 0.5, signed)
    for length in (64, 1 << 16):
        got = {r.channel: (r.phase, r.r, r.n, r.lag) for r in extrema.phase_profile(long, "snippet", "channel", "i", "v", fs, 0, signed=signed, length=length).collect()}
        assert set(got) == set(want) and all(got[c] == pytest.approx(want[c]) for c in want)
    assert got[0][0] == pytest.approx(0) and 0 < got[2][0] < got[3][0]
    assert extrema.phase_profile(long.filter("channel > 0"), "snippet", "channel", "i", "v", fs, 0).count() == 0


def test_prominence_by_a_column_of_the_key(spark):
    rows = [(k, i, float(v * (1 + k))) for k in range(2) for i, v in enumerate([0, 1, 0, 3, 0, 2, 1, 4, 0])]
    long = spark.createDataFrame(rows, "c int, i long, v double")
    got = extrema.peaks(long, "c", "i", "v", prominence=F.when(F.col("c") == 0, 2.0).otherwise(5.0)).collect()
    assert sorted((r.c, r.i) for r in got) == [(0, 3), (0, 7), (1, 3), (1, 7)]
