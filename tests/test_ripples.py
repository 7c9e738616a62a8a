"""Ripples against a plain version over whole traces."""

import numpy as np
import pytest

from spikelake.functions import signal
from spikelake.operators.ripples import ripples


def plain_power(x, fs, low, high):
    v = signal.convolved(x, signal.bandpass_taps(low, high, fs))
    square = np.pad(v**2, 5, mode="edge")
    return v, np.array([square[k : k + 11].mean() for k in range(len(x))])


def plain_ripples(x, fs, low=100, high=250, onset=2, peak=5, gap=0.03, shortest=0.02, longest=0.1, sd=None, restrict=None, noise=None):
    v, power = plain_power(x, fs, low, high)
    t = np.arange(len(x)) / fs
    own = power if restrict is None else power[np.any([(t >= a) & (t <= b) for a, b in restrict], 0)]
    if not len(own):
        return []
    sd = own.std() if sd is None else sd
    sd = sd if sd > 0 else 1.0
    nss = (power - own.mean()) / sd
    spans, k = [], 0
    while k < len(x):
        e = k
        while e + 1 < len(x) and (nss[e + 1] > onset) == (nss[k] > onset):
            e += 1
        if nss[k] > onset and k > 0 and e + 1 < len(x):
            spans.append([k - 1, e])
        k = e + 1
    merged = spans[:1]
    for s, e in spans[1:]:
        if s - merged[-1][1] < round(gap * fs):
            merged[-1][1] = e
        else:
            merged.append([s, e])
    out = []
    if noise is not None:
        other = plain_power(noise, fs, low, high)[1]
        other = (other - other.mean()) / sd
    for s, e in merged:
        if nss[s : e + 1].max() > peak and shortest <= (e - s) / fs <= longest and not (noise is not None and (other[s : e + 1] > peak).any()):
            out.append((s / fs, e / fs, (s + int(v[s : e + 1].argmin())) / fs, nss[s : e + 1].max(), (e - s) / fs * 1000))
    return out


def made_up(rng, n, fs, events):
    x = rng.standard_normal(n) * 0.05
    for at in events:
        k = np.arange(max(0, at - 60), min(n, at + 61))
        x[k] += np.exp(-((k - at) ** 2) / 300) * np.sin(2 * np.pi * 160 * (k - at) / fs) * rng.uniform(1, 3)
    return x


OPTIONS = [{}, {"gap": 0.2, "longest": 0.5}, {"onset": 0.1, "peak": 0.5, "shortest": 0.0, "longest": 9.0}, {"sd": 0.02}, {"restrict": [(0.2, 0.7), (2.0, 2.5)]}]


@pytest.mark.parametrize("options", OPTIONS)
def test_ripples_are_those_of_whole_traces(spark, options):
    fs, rng = 1000.0, np.random.default_rng(4)
    xs = {1: made_up(rng, 4000, fs, [1000, 1090, 2500, 2560, 3990]), 2: np.ones(700), 3: made_up(rng, 1503, fs, [3, 299, 301, 600, 899]), 4: rng.standard_normal(900), 5: np.array([1.0])}
    long = spark.createDataFrame([(k, i, float(v)) for k, x in xs.items() for i, v in enumerate(x)], "c int, i long, v double").repartition(3)
    want = sorted((k, *r) for k, x in xs.items() for r in plain_ripples(x, fs, **options))
    assert want
    for length in (None, 300, 37):
        got = sorted(tuple(r) for r in ripples(long, "c", "i", "v", fs, length=length, **options).collect())
        assert len(got) == len(want) and np.allclose(np.array(got), np.array(want))
    assert ripples(long.limit(0), "c", "i", "v", fs).count() == 0


def test_noise_channel(spark):
    fs, rng = 1000.0, np.random.default_rng(5)
    x, noise = made_up(rng, 4000, fs, [1000, 2000, 3000]), made_up(rng, 4000, fs, [2010])
    rows = lambda x: spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "c int, i long, v double")
    want = plain_ripples(x, fs, noise=noise)
    got = sorted(tuple(r)[1:] for r in ripples(rows(x), "c", "i", "v", fs, noise=rows(noise), length=300).collect())
    assert [round(r[2]) for r in want] == [1, 3] and np.allclose(np.array(got), np.array(want))


def test_the_filter_runs_once(spark):
    """What is read after it is what it has written; no window takes samples."""
    rows = spark.createDataFrame([(1, i, float(i % 7)) for i in range(400)], "c int, i long, v double")
    plan = ripples(rows, "c", "i", "v", 1000.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert "ExistingRDD" in plan
