"""Ripples: the band and its power in blocks, then runs above a threshold, joined over the edges of blocks.

Nothing holds a whole trace: a block gives its filtered samples and their moments, which are written once; a trace's
mean and deviation are sums of moments; each block then gives its runs, and only runs are ordered within a trace.
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

#: Samples on either side of the one whose power is their mean square.
HALF = 5


def _powers(samples: DataFrame, key: str, order: str, value: str, fs: float, low: float, high: float, length: int | None, restrict: list[tuple[float, float]] | None) -> DataFrame:
    """key, block, first, v (filtered) and power of each block, and n, mean and rest (squares about the mean) of its power
    within the spans (seconds) of `restrict`, if any."""
    taps = signal.bandpass_taps(low, high, fs)
    length = length or 64 * len(taps)
    rows = blocks(samples, key, order, value, length, len(taps) // 2 + HALF)
    doubles = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, start, x in zip(batch.column("block").to_pylist(), batch.column("start").to_pylist(), batch.column("samples")):
                y = signal.convolved(x.values.to_numpy(zero_copy_only=False).astype(float), taps)
                a = block * length - start
                b = min(a + length, len(y))
                near = y[max(0, a - HALF) : b + HALF] ** 2
                near = np.pad(near, (max(0, HALF - a), max(0, b + HALF - len(y))), mode="edge")  # only at a trace's ends
                power = np.convolve(near, np.full(2 * HALF + 1, 1 / (2 * HALF + 1)), "valid")
                own = power
                if restrict is not None:
                    t = (block * length + np.arange(len(power))) / fs
                    own = power[np.any([(t >= s) & (t <= e) for s, e in restrict], 0)] if restrict else power[:0]
                mean = own.mean() if len(own) else 0.0
                out.append((block * length, y[a:b], power, len(own), mean, ((own - mean) ** 2).sum()))
            columns = zip(*out) if out else [[]] * 6
            types = (pa.int64(), doubles, doubles, pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("block"), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=[key, "block", "first", "v", "power", "n", "mean", "rest"])

    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, block long, first long, v array<double>, power array<double>, n long, mean double, rest double")


def _scale(powers: DataFrame, key: str, sd: float | None) -> DataFrame:
    """key, mean and sd of each trace's power; a deviation of 0 counts as 1."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    rest = F.sum("rest") + F.sum(F.col("n") * F.col("mean") ** 2) - n * mean**2
    out = powers.filter("n > 0").groupBy(key).agg(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), rest) / n).alias("sd"))
    own = F.lit(float(sd)) if sd is not None else F.col("sd")
    return out.select(key, "mean", F.when(own == 0, 1.0).otherwise(own).alias("sd"))


def _runs(powers: DataFrame, scale: DataFrame, key: str, onset: float) -> DataFrame:
    """key, first, last, up (whether the normalised power is above the onset), power (its largest), low (the smallest filtered
    sample and its place) and tail (the last one) of each run of samples, whole across blocks."""
    places = powers.select(key, "block").join(scale.select(key, F.col("mean").alias("mu"), "sd"), key)
    rows = powers.select(key, "block", "first", "v", "power").join(places, [key, "block"])  # by block: a trace isn't a task
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("up", pa.bool_()), ("power", pa.float64()), ("v", pa.float64()), ("i", pa.int64()), ("tail", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, v, power, mean, sd in zip(batch.column("first").to_pylist(), batch.column("v"), batch.column("power"), batch.column("mu").to_pylist(), batch.column("sd").to_pylist()):
                v, nss = v.values.to_numpy(zero_copy_only=False), (power.values.to_numpy(zero_copy_only=False) - mean) / sd
                begin, end = signal.runs(nss > onset)
                low = [a + int(v[a : b + 1].argmin()) for a, b in zip(begin.tolist(), end.tolist())]
                top = np.maximum.reduceat(nss, begin)
                out.append([{"first": first + a, "last": first + b, "up": bool(nss[a] > onset), "power": float(p), "v": float(v[k]), "i": first + k, "tail": float(v[b])} for a, b, k, p in zip(begin.tolist(), end.tolist(), low, top)])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, span)], names=[key, "runs"])

    kind = "array<struct<first:bigint,last:bigint,up:boolean,power:double,v:double,i:bigint,tail:double>>"
    rows = rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, runs {kind}").select(key, F.inline("runs"))
    order = Window.partitionBy(key).orderBy("first")
    new = F.coalesce(F.lag("up").over(order) != F.col("up"), F.lit(True)).cast("int")
    rows = rows.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.first("up").alias("up"), F.max("power").alias("power"),
        F.min(F.struct("v", "i")).alias("low"), F.max_by("tail", "last").alias("tail"),
    )


def ripples(
    samples: DataFrame, key: str, order: str, value: str, fs: float, low: float = 100, high: float = 250, onset: float = 2, peak: float = 5, gap: float = 0.03, shortest: float = 0.02, longest: float = 0.1,
    length: int | None = None, sd: float | None = None, restrict: list[tuple[float, float]] | None = None, noise: DataFrame | None = None,
) -> DataFrame:
    """key, start_time, end_time, peak_time (of the trough), peak_normed_power and duration_ms of the ripples of each trace.

    samples: as for `blocks`. Power, the mean square of 11 filtered samples, is normalised by its mean and deviation over the
    trace, or over the spans (seconds) of `restrict`; `sd` replaces the deviation. A ripple begins before the first sample
    above the onset; runs that touch an end of the trace don't count. noise: samples of another trace for each key, in the
    same columns; ripples in which its power, over the deviation of the first trace, is above the peak are left out.
    """
    powers = kept(_powers(samples, key, order, value, fs, low, high, length, restrict))
    scale = _scale(powers, key, sd)
    runs = Window.partitionBy(key).orderBy("first")
    before = {"__low": F.lag("low").over(runs), "__tail": F.lag("tail").over(runs), "__next": F.lead("first").over(runs)}
    spans = _runs(powers, scale, key, onset).withColumns(before).filter("up AND __tail IS NOT NULL AND __next IS NOT NULL")
    spans = spans.select(key, (F.col("first") - 1).alias("start"), F.col("last").alias("stop"), "power", F.least("low", F.struct(F.col("__tail").alias("v"), (F.col("first") - 1).alias("i"))).alias("low"), "__low")
    order_ = Window.partitionBy(key).orderBy("start")
    near = F.coalesce(F.col("start") - F.lag("stop").over(order_) < round(gap * fs), F.lit(False))
    spans = spans.withColumn("__near", near).withColumn("__group", F.sum((~F.col("__near")).cast("int")).over(order_.rowsBetween(Window.unboundedPreceding, 0)))
    lowest = F.when(F.col("__near"), F.least("low", "__low")).otherwise(F.col("low"))  # what lies between is part of the ripple
    found = spans.groupBy(key, "__group").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("power").alias("power"), F.min(lowest).alias("low"))
    width = (F.col("stop") - F.col("start")) / fs
    found = found.filter((F.col("power") > peak) & (width >= shortest) & (width <= longest))
    if noise is not None:
        other = kept(_powers(noise, key, order, value, fs, low, high, length, None))
        limits = _scale(other, key, None).select(key, "mean").join(scale.select(key, "sd"), key)
        bucket = max(1, int(longest * fs))
        each = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))).alias("__bucket")
        loud = _runs(other, limits, key, peak).filter("up").select(key, F.col("first").alias("__a"), F.col("last").alias("__b"), each("first", "last"))
        hit = found.select(key, "start", "stop", each("start", "stop")).join(loud, [key, "__bucket"]).filter("__a <= stop AND __b >= start")
        found = found.join(hit.select(key, "start").distinct(), [key, "start"], "left_anti")
    return found.select(key, (F.col("start") / fs).alias("start_time"), (F.col("stop") / fs).alias("end_time"), (F.col("low.i") / fs).alias("peak_time"), F.col("power").alias("peak_normed_power"), (width * 1000).alias("duration_ms"))


def ripples_of(x: np.ndarray, fs: float, low: float = 100, high: float = 250, onset: float = 2, peak: float = 5, gap: float = 0.03, shortest: float = 0.02, longest: float = 0.1) -> list[tuple[float, float, float, float, float]]:
    """The ripples of one trace that fits in memory: what `ripples` gives for it."""
    v = signal.convolved(x.astype(float), signal.bandpass_taps(low, high, fs))
    power = np.convolve(np.pad(v**2, HALF, mode="edge"), np.full(2 * HALF + 1, 1 / (2 * HALF + 1)), "valid")
    nss = (power - power.mean()) / (power.std() or 1.0)
    first, last = signal.runs(nss > onset)
    up = (nss[first] > onset) & (first > 0) & (last < len(x) - 1)
    start, stop = first[up] - 1, last[up]
    if not len(start):
        return []
    new = np.flatnonzero(np.concatenate([[True], start[1:] - stop[:-1] >= round(gap * fs)]))
    out = []
    for a, b in zip(start[new].tolist(), stop[np.concatenate([new[1:] - 1, [len(stop) - 1]])].tolist()):
        top = float(nss[a : b + 1].max())
        if top > peak and shortest <= (b - a) / fs <= longest:
            out.append((a / fs, b / fs, (a + int(v[a : b + 1].argmin())) / fs, top, (b - a) / fs * 1000))
    return out
