"""Recordings of many channels: alignment, bad channels, band, reference, and the scan by bins.

samples: a row for each channel (`key`) and sample, numbered by `order` from 0 without gaps; channels: a row for each.
Everything runs on blocks of time, so nothing grows with a recording's length; what is ordered as a whole are channels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal
from .kernels import blocks
from .storage import kept

#: The integer types of places, and the lists of values, that the kernels give back.
LONG, DOUBLES = pa.int64(), pa.list_(pa.float64())


def _filtered(rows: DataFrame, key: str, f, length: int, down: int = 1) -> DataFrame:
    """key, i and v: the values f(x, own, ...) that each block gives for its own part, which begins at own and has `length`
    samples, or every `down`-th; rows: key, block, start, samples, and what else f wants."""
    more = [c for c in rows.columns if c not in (key, "block", "start", "samples")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, x in enumerate(batch.column("samples")):
                x = x.values.to_numpy(zero_copy_only=False).astype(float)
                own = batch.column("block")[k].as_py() * length - batch.column("start")[k].as_py()
                out.append(f(x, own, *(batch.column(c)[k].as_py() for c in more)))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("block"), pa.array(out, DOUBLES)], names=[key, "block", "values"])

    found = rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, block long, values array<double>")
    return found.select(key, "block", F.posexplode("values").alias("i", "v")).select(key, (F.col("block") * (length // down) + F.col("i")).alias("i"), "v")


def aligned(samples: DataFrame, shifts: DataFrame, key: str, order: str, value: str, length: int = 1 << 15) -> DataFrame:
    """key, i and v: each channel as if sampled at the common times, where shifts (key, shift) tells by what part of a
    sample it was late (null: 0).

    The phases are turned by a finite filter, multiplied in the spectrum of blocks with its reach as halo: so blocks give the
    values of the whole trace, and a trace's ends are felt within that reach only.
    """

    def f(x: np.ndarray, own: int, shift: float) -> np.ndarray:
        return signal.convolved(x, signal.shift_taps(shift or 0.0))[own : own + length]

    rows = blocks(samples, key, order, value, length, signal.REACH).join(shifts.select(key, F.col("shift").cast("double").alias("shift")), key, "left")
    return _filtered(rows, key, f, length)


def banded(samples: DataFrame, key: str, order: str, value: str, low: float, high: float, fs: float, degree: int = 5, length: int | None = None) -> DataFrame:
    """key, i and v under a zero-phase Butterworth band-pass. The halo is the time in which its slowest response falls by 28
    powers of e; what stands near a trace's own ends can depend on the blocks in the fourth digit."""
    halo = int(np.ceil(28 * fs / (np.sin(np.pi / (2 * degree)) * np.pi * min(low, high - low))))
    length = length or 4 * halo
    return _filtered(blocks(samples, key, order, value, length, halo), key, lambda x, own: signal.butterworth(x, low, high, fs, degree)[own : own + length], length)


def resampled(samples: DataFrame, key: str, order: str, value: str, down: int, length: int = 1 << 14) -> DataFrame:
    """key, i and v: every `down`-th sample after a low-pass, numbered anew; a block gives `length` of them."""
    rows = blocks(samples, key, order, value, length * down, 20 * down)
    return _filtered(rows, key, lambda x, own: signal.resampled(x, down)[own // down : own // down + length], length * down, down)


def referenced(samples: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, order and value less the median of all channels at that sample; the channels are shuffled once."""
    rows = samples.groupBy(order).agg(F.percentile(value, F.lit(0.5)).alias("__m"), F.collect_list(F.struct(key, value)).alias("__all"))
    return rows.select(order, "__m", F.explode("__all").alias("__x")).select(F.col(f"__x.{key}").alias(key), order, (F.col(f"__x.{value}") - F.col("__m")).alias(value))


def channel_quality(samples: DataFrame, channels: DataFrame, key: str, order: str, value: str, fs: float, around: int = 5, above: float = 0.8, length: int = 4096) -> DataFrame:
    """key, depth, similarity and loudness of each channel: medians over blocks of its correlation with the median of the
    `around` channels above and below it, and of its mean power density above a share of half the rate.

    channels: key and depth, whose ties go by key. A block holds `length` samples of all channels. A flat channel, or
    one alone, has similarity 0.
    """
    kind = dict(samples.dtypes)[key]
    rows = blocks(samples, key, order, value, length, 0).join(channels.select(key, F.col("depth").cast("double").alias("depth")), key)
    rows = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("depth", key, "samples"))).alias("all"))
    names = [key, "similarity", "loudness"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("all"):
                inner = cell.values
                traces = [s.values.to_numpy(zero_copy_only=False) for s in inner.field("samples")]
                n = min(map(len, traces))
                x = np.stack([t[:n] for t in traces]).astype(float)
                x -= x.mean(1, keepdims=True)
                similar = np.zeros(len(x))
                for c in range(len(x)):
                    near = [k for k in range(max(0, c - around), min(len(x), c + around + 1)) if k != c]
                    if near:
                        m = np.median(x[near], 0)
                        m -= m.mean()
                        size = np.sqrt((m @ m) * (x[c] @ x[c]))
                        similar[c] = (m @ x[c]) / size if size > 0 else 0.0
                freqs, power = signal.density(x, fs)
                loud = power[:, freqs > above * fs / 2].mean(1) if (freqs > above * fs / 2).any() else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([inner.field(key), pa.array(similar), pa.array(loud)], names=names)

    found = rows.select("all").mapInArrow(run, f"{key} {kind}, similarity double, loudness double")
    found = found.groupBy(key).agg(F.percentile("similarity", F.lit(0.5)).alias("similarity"), F.percentile("loudness", F.lit(0.5)).alias("loudness"))
    return channels.select(key, "depth").join(found, key, "left")


def judged_channels(quality: DataFrame, key: str, dead: float = 0.5, times: float = 10.0, around: int = 5) -> DataFrame:
    """quality with verdict: dead if the similarity lies `dead` or more below the median of the channels around (a channel
    without samples is dead), noisy if the loudness is above `times` the median of all, else good."""
    near = Window.orderBy("depth", key).rowsBetween(-around, around)  # a row for each channel
    rows = quality.withColumns({"__near": F.percentile("similarity", F.lit(0.5)).over(near), "__loud": F.percentile("loudness", F.lit(0.5)).over(Window.partitionBy())})
    verdict = F.when(F.col("similarity").isNull() | (F.col("__near") - F.col("similarity") >= dead), "dead").when(F.col("loudness") > times * F.col("__loud"), "noisy").otherwise("good")
    return rows.withColumn("verdict", verdict).drop("__near", "__loud")


def preprocessed(samples: DataFrame, channels: DataFrame, key: str, order: str, value: str, fs: float, low: float = 1.0, high: float = 500.0, down: int = 1, length: int = 1 << 15, **options) -> DataFrame:
    """key, i and v of the good channels: aligned, in the band, less the median channel, then every `down`-th sample.

    channels: key, depth and shift. options: of `judged_channels`.
    """
    rows = kept(aligned(samples, channels, key, order, value, length))
    verdicts = judged_channels(channel_quality(rows, channels, key, "i", "v", fs), key, **options)
    rows = rows.join(verdicts.filter("verdict = 'good'").select(key), key, "left_semi")
    rows = referenced(banded(rows, key, "i", "v", low, high, fs), key, "i", "v")
    return resampled(rows, key, "i", "v", down) if down > 1 else rows


def scanned(samples: DataFrame, key: str, order: str, value: str, fs: float, seconds: float = 1.0, band: tuple[float, float] = (3.0, 7.0), bins: int = 60) -> DataFrame:
    """key, bin, sd and power: the deviation of each whole bin, and its power in the band, which is the area under its
    density (one Hann window, less the mean). One pass, over blocks of `bins` bins."""
    n = int(round(seconds * fs))
    rows = blocks(samples, key, order, value, bins * n, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sds, powers = [], []
            for x in batch.column("samples"):
                x = x.values.to_numpy(zero_copy_only=False).astype(float)
                x = x[: len(x) // n * n].reshape(-1, n)
                freqs, density = signal.density(x, fs) if len(x) else (np.empty(0), np.empty((0, 0)))
                on = (freqs >= band[0]) & (freqs <= band[1])
                sds.append(x.std(1))
                powers.append(np.trapezoid(density[:, on], freqs[on], axis=1) if len(x) else np.empty(0))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("block"), pa.array(sds, DOUBLES), pa.array(powers, DOUBLES)], names=[key, "block", "sds", "powers"])

    found = rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, block long, sds array<double>, powers array<double>")
    found = found.select(key, "block", F.posexplode(F.arrays_zip("sds", "powers")).alias("k", "x"))
    return found.select(key, (F.col("block") * bins + F.col("k")).alias("bin"), F.col("x.sds").alias("sd"), F.col("x.powers").alias("power"))


def bin_noise(scan: DataFrame, times: float = 5.0) -> DataFrame:
    """bin, metric (the median deviation of its channels), channels and noisy: a metric of 0, or above median + times * 1.4826
    * MAD of all bins."""
    from . import fields

    return fields.noisy(scan.groupBy("bin").agg(F.percentile("sd", F.lit(0.5)).alias("metric"), F.count(F.lit(1)).alias("channels")), [], "metric", times)


def depth_power(scan: DataFrame, noise: DataFrame, key: str) -> DataFrame:
    """key and db: ten times the log10 of each channel's mean band power over the bins that aren't noisy."""
    clean = scan.join(noise.filter("NOT noisy").select("bin"), "bin", "left_semi")
    return clean.groupBy(key).agg((10 * F.log10(F.avg("power") + 1e-12)).alias("db"))
