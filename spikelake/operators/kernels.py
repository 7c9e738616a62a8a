"""Operators whose mathematics isn't relational: one group, one task, numpy inside.

Each takes a row per unit, channel or file with its samples in array columns; groups are bounded by a
session. Random draws are seeded by the group's key, so a repeated task gives the same values.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal, stats


ARROW = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}


def per_row(rows: DataFrame, f: Callable[..., dict], keys: list[str], inputs: list[str], schema: str) -> DataFrame:
    """keys and the values of f(seed, *arrays) for each row; schema names them, arrays reach f as numpy arrays."""
    kinds = dict(rows.dtypes)
    full = ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema])
    types = {name: ARROW[kind] for name, kind in (part.split() for part in schema.split(","))}
    names = list(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            columns = [[v.values.to_numpy(zero_copy_only=False) if isinstance(v, pa.ListScalar) and v.is_valid else v.as_py() for v in batch.column(c)] for c in inputs]
            for row, key in enumerate(zip(*(batch.column(k).to_pylist() for k in keys))):
                found = f(zlib.crc32(repr(key).encode()), *(c[row] for c in columns))
                for n in names:
                    value = found.get(n)
                    out[n].append(None if isinstance(value, float) and not np.isfinite(value) else value)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(out[n], types[n]) for n in names)], names=[*keys, *names]) if batch.num_rows else batch.select([])

    return rows.select(*dict.fromkeys([*keys, *inputs])).mapInArrow(run, full)


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are small but long at work, over four tasks for each core: by their size they would meet in a few."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def blocks(samples: DataFrame, key: str, order: str, value: str, length: int, halo: int, only: DataFrame | None = None) -> DataFrame:
    """key, block, start and samples: each trace cut into blocks of `length` samples, with up to `halo` of those around.

    `order` numbers a key's samples from 0 without gaps; start is the number of the first sample given. A group holds
    length + 2 * halo samples, however long the trace. only: the blocks (key, block) that are wanted, if not all.
    """
    of = lambda i: F.floor(i / length).cast("long")
    wide = F.sequence(F.greatest(F.lit(0).cast("long"), of(F.col(order) - halo)), of(F.col(order) + halo))
    rows = samples.select(key, order, value, F.explode(wide).alias("block"))
    rows = rows.join(only, [key, "block"], "left_semi") if only is not None else rows
    rows = rows.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("pairs"), F.max(order).alias("last"))
    rows = rows.filter(F.col("last") >= F.col("block") * length)  # else there's nothing but halo
    return rows.select(key, "block", F.col("pairs")[0][order].cast("long").alias("start"), F.transform("pairs", lambda p: p[value]).alias("samples"))


def bandpassed(samples: DataFrame, key: str, order: str, value: str, low: float, high: float, fs: float, length: int | None = None) -> DataFrame:
    """key, i and v: the samples under a finite band-pass, filtered in blocks (64 times the filter's length, or `length`);
    the halo is half the filter, so the values are those of the whole trace."""
    taps = signal.bandpass_taps(low, high, fs)
    length = length or 64 * len(taps)

    def f(seed: int, block: int, start: int, x: np.ndarray) -> dict:
        own = block * length - start
        return {"filtered": signal.convolved(x.astype(float), taps)[own : own + length].tolist()}

    rows = per_row(blocks(samples, key, order, value, length, len(taps) // 2), f, [key, "block"], ["block", "start", "samples"], "filtered array<double>")
    return rows.select(key, "block", F.posexplode("filtered").alias("i", "v")).select(key, (F.col("block") * length + F.col("i")).alias("i"), "v")


def spectra(samples: DataFrame, key: str, order: str, value: str, fs: float, seconds: float, hand_rolled: bool = False, notches: tuple[float, ...] = (), down: int = 1, band: tuple[float, float] | None = None, epochs: int = 64) -> DataFrame:
    """key, epoch, freqs and power: the density of each whole epoch, after resampling, a Butterworth band and notches.

    samples: as for `blocks`; a block has `epochs` epochs. hand_rolled: a symmetric window and linear detrending instead
    of a periodic one and the mean. The halo holds the resampling filter and the warm-up of the zero-phase filters, in
    which the slowest of their responses falls by 28 powers of e; a trace within one block is filtered as a whole. Only
    near a trace's own ends, which are padded by two seconds, can values depend on the blocks in the fourth digit.
    """
    rate = fs / down
    n = int(seconds * rate)
    slowest = [np.pi * at / signal.NOTCH_Q for at in notches] + ([0.38 * np.pi * min(band[0], band[1] - band[0])] if band else [])
    warm = sum(int(np.ceil(28 * rate / s)) for s in slowest)
    length, halo = epochs * n * down, (warm + (20 if down > 1 else 0)) * down

    def f(seed: int, block: int, start: int, x: np.ndarray) -> dict:
        x = x.astype(float)
        x = signal.resampled(x, down) if down > 1 else x
        if band:
            x = signal.butterworth(x, *band, rate)
        for at in notches:
            x = signal.notch(x, at, rate)
        own = (block * length - start) // down
        x = x[own : own + epochs * n]
        if len(x) < n:
            return {"freqs": [], "powers": []}
        freqs, power = signal.density(x[: len(x) // n * n].reshape(-1, n), rate, not hand_rolled, hand_rolled)
        return {"freqs": freqs.tolist(), "powers": power.tolist()}

    out = per_row(blocks(samples, key, order, value, length, halo), f, [key, "block"], ["block", "start", "samples"], "freqs array<double>, powers array<array<double>>")
    out = out.select(key, "block", "freqs", F.posexplode("powers").alias("k", "power"))
    return out.select(key, "freqs", (F.col("block") * epochs + F.col("k")).alias("epoch"), "power")


def rate_map(bins: np.ndarray, occ: np.ndarray, spikes: np.ndarray, shape: tuple[int, int], least: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed rates and validity of a map, as in `maps.smoothed`."""
    seconds = np.bincount(bins, occ, shape[0] * shape[1]).reshape(shape)
    counts = np.bincount(bins[spikes], minlength=shape[0] * shape[1]).reshape(shape)
    valid = seconds >= least
    rate = np.where(valid, counts / np.where(valid, seconds, 1), 0)
    pad = lambda a: np.pad(a.astype(float), 1)
    r, m = pad(rate * valid), pad(valid)
    top = sum((2 - abs(i)) * (2 - abs(j)) * r[1 + i : r.shape[0] - 1 + i, 1 + j : r.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1))
    low = sum((2 - abs(i)) * (2 - abs(j)) * m[1 + i : m.shape[0] - 1 + i, 1 + j : m.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1))
    return np.where(valid, top / np.where(low > 0, low, 1), 0), seconds * valid


def information(rate: np.ndarray, seconds: np.ndarray) -> float:
    total = seconds.sum()
    if total <= 0:
        return 0.0
    p = seconds / total
    mean = (p * rate).sum()
    if mean <= 0:
        return 0.0
    on = rate > 0
    return float((p[on] * rate[on] / mean * np.log2(rate[on] / mean)).sum())


def shuffled_information(units: DataFrame, keys: list[str], nx: int, ny: int, fps: float, draws: int = 1000, margin: float = 20.0, least: float = 1.0) -> DataFrame:
    """sir, null_mean, null_p95 and significant: the information of each unit against circular shifts of its spikes.

    units: keys, bins (of each frame, x * ny + y), occ (seconds of each frame) and spikes (frame of each spike). Shifts
    are whole numbers from margin * fps to the frames less that; a session too short for them has null nulls.
    """

    def f(seed: int, bins: np.ndarray, occ: np.ndarray, spikes: np.ndarray) -> dict:
        if not len(bins):
            return {}
        bins, spikes, occ = bins.astype(np.int64), spikes.astype(np.int64), occ.astype(float)
        seconds, none = np.bincount(bins, occ, nx * ny).reshape(nx, ny), np.zeros((nx, ny), bool)
        one = lambda shifts: shifted_information(bins, seconds, spikes, shifts, least, none, 0.0)
        real, low, high = float(one(np.array([0]))[0]), int(margin * fps), len(bins) - int(margin * fps)
        if high < low or not len(spikes):
            return {"sir": real}
        null = one(np.random.default_rng(seed).integers(low, high + 1, draws))
        p95 = float(np.percentile(null, 95))
        return {"sir": real, "null_mean": float(null.mean()), "null_p95": p95, "significant": bool(real > p95)}

    return per_row(units, f, keys, ["bins", "occ", "spikes"], "sir double, null_mean double, null_p95 double, significant boolean")


def fields(rate: np.ndarray, valid: np.ndarray, share: float = 0.2, smallest: float = 0.04, diagonal: bool = True) -> list[np.ndarray]:
    """Masks of the place fields: from the highest free bin, its neighbours (8, or 4) of at least a share of it."""
    free, out = valid & (rate > 0), []
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0) and (diagonal or i * j == 0)]
    while free.any():
        order = np.lexsort((*(g.ravel() for g in np.indices(rate.shape)[::-1]), -np.where(free, rate, -np.inf).ravel()))
        seed = np.unravel_index(order[0], rate.shape)
        allowed = free & (rate >= share * rate[seed])
        mask = np.zeros_like(free)
        mask[seed] = True
        while True:
            p = np.pad(mask, 1)
            grown = mask.copy()
            for i, j in steps:
                grown |= p[1 + i : p.shape[0] - 1 + i, 1 + j : p.shape[1] - 1 + j]
            grown &= allowed
            if (grown == mask).all():
                break
            mask = grown
        free &= ~mask
        if mask.sum() >= smallest * valid.sum():
            out.append(mask)
    return out


def largest_field(rate: np.ndarray, valid: np.ndarray, part: float = 2.5, smallest: int = 9) -> list[np.ndarray]:
    """The mask of the largest group of 4-connected bins above the highest rate / part, of `smallest` bins or more, that
    holds the first bin of a full block of 3 x 3 bins above it; none or one.

    As in the reference, a bin needs a neighbour with a rate, the block may take bins of other groups, and it doesn't
    reach the last row or column. Of groups of one size the first by columns is taken.
    """
    rate = np.where(valid, rate, 0)
    if not rate.size or rate.max() <= 0:
        return []
    p = np.pad(rate, 1) > 0
    on = (rate > rate.max() / part) & (p[2:, 1:-1] | p[:-2, 1:-1] | p[1:-1, 2:] | p[1:-1, :-2])
    q = np.pad(on, ((0, 2), (0, 2)))
    block = np.all([q[i : i + on.shape[0], j : j + on.shape[1]] for i in range(3) for j in range(3)], 0)
    block[-3:], block[:, -3:] = False, False
    groups, free = [], on.copy()
    for y, x in zip(*np.nonzero(on.T)):
        if not free[x, y]:
            continue
        mask = np.zeros_like(on)
        mask[x, y] = True
        while True:
            m = np.pad(mask, 1)
            grown = on & (mask | m[2:, 1:-1] | m[:-2, 1:-1] | m[1:-1, 2:] | m[1:-1, :-2])
            if (grown == mask).all():
                break
            mask = grown
        free &= ~mask
        groups.append(mask)
    return [g for g in sorted(groups, key=lambda g: -g.sum()) if g.sum() >= smallest and (g & block).any()][:1]


def place_fields(maps: DataFrame, keys: list[str], nx: int, ny: int, rule: Callable[..., list[np.ndarray]] = fields, **options) -> DataFrame:
    """keys, field, n_bins, peak and the centre of mass of each field that the rule (fields or largest_field) finds.

    maps: keys, bx, by_, rate, valid as arrays.
    """

    def f(seed: int, bx: np.ndarray, by: np.ndarray, rate: np.ndarray, valid: np.ndarray) -> dict:
        r, v = np.zeros((nx, ny)), np.zeros((nx, ny), bool)
        r[bx.astype(int), by.astype(int)], v[bx.astype(int), by.astype(int)] = rate.astype(float), valid.astype(bool)
        out = []
        for k, m in enumerate(rule(r, v, **options)):
            x, y = np.nonzero(m)
            w = r[m]
            out.append({"field": k, "n_bins": int(m.sum()), "peak": float(w.max()), "cx": float((x * w).sum() / w.sum()), "cy": float((y * w).sum() / w.sum())})
        return {"fields": out}

    kind = "array<struct<field:bigint;n_bins:bigint;peak:double;cx:double;cy:double>>"
    kinds = dict(maps.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"fields {kind.replace(';', ',')}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[np.asarray(v.as_py()) for v in batch.column(c)] for c in ("bx", "by_", "rate", "valid")]
            found = [f(0, *row)["fields"] for row in zip(*cols)]
            item = pa.list_(pa.struct([("field", pa.int64()), ("n_bins", pa.int64()), ("peak", pa.float64()), ("cx", pa.float64()), ("cy", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(found, item)], names=[*keys, "fields"])

    rows = maps.select(*keys, "bx", "by_", "rate", "valid").mapInArrow(run, schema)
    return rows.select(*keys, F.inline("fields"))


def cluster_null(files: DataFrame, key: str, df: int, draws: int = 500, times: int = 3, ridge: float = 1e-10) -> DataFrame:
    """key, cluster, n, l_ratio and iso of the clusters of each file, and of their null: pool, n_valid, and for either measure
    the mean, sd, p and z.

    files: key, labels and points (an array of df features for each). The null clusters are drawn without replacement
    from the `times` * n other points nearest to the cluster; p = (hits + 1) / (draws + 1), and z is how many deviations
    (n - 1) the cluster is better than their mean. A cluster of more than half of its file's points has no null.
    """
    kind = dict(files.dtypes)[key]
    doubles = ["l_ratio", "iso", "null_l", "null_iso", "sd_l", "sd_iso", "p_l", "p_iso", "z_l", "z_iso"]
    types = {"cluster": pa.int64(), "n": pa.int64(), "pool": pa.int64(), "n_valid": pa.int64()} | dict.fromkeys(doubles, pa.float64())

    def distances(own: np.ndarray, points: np.ndarray) -> np.ndarray:
        mean, cov = points[own].mean(0), np.cov(points[own].T).reshape(df, df) + ridge * np.eye(df)
        d = points - mean
        return np.einsum("ij,jk,ik->i", d, np.linalg.pinv(cov), d)

    def measures(d2: np.ndarray, own: np.ndarray) -> tuple[float, float]:
        noise, n = np.sort(d2[~own]), int(own.sum())
        return float(stats.chi2_tail(noise, df).sum() / n), float(noise[n - 1]) if 2 * n <= len(own) else float("nan")

    def drawn(fakes: np.ndarray, points: np.ndarray) -> list[tuple[float, float]]:
        """The measures of several clusters of as many points, given by the places of these."""
        n, own = fakes.shape[1], points[fakes]
        mean = own.mean(1, keepdims=True)
        cov = (own - mean).transpose(0, 2, 1) @ (own - mean) / (n - 1) + ridge * np.eye(df)
        d = points - mean
        d2 = np.einsum("kij,kij->ki", d @ np.linalg.pinv(cov), d)
        tails = stats.chi2_tail(d2, df)
        np.put_along_axis(tails, fakes, 0.0, 1)
        np.put_along_axis(d2, fakes, np.inf, 1)
        nth = np.partition(d2, n - 1, axis=1)[:, n - 1]
        return list(zip((tails.sum(1) / n).tolist(), nth.tolist()))

    def one(key_of: object, c: int, own: np.ndarray, points: np.ndarray) -> dict:
        n, d2 = int(own.sum()), distances(own, points)
        out = {"cluster": int(c), "n": n, "pool": 0, "n_valid": 0}
        out["l_ratio"], out["iso"] = measures(d2, own)
        near = np.argsort(np.where(own, np.inf, d2), kind="stable")[: min(times * n, int((~own).sum()))]
        if 2 * n > len(own):
            return out
        out["pool"] = len(near)
        if len(near) < n:
            return out
        rng, null = np.random.default_rng(zlib.crc32(repr((key_of, int(c))).encode())), []
        at_once = max(1, min(64, (1 << 19) // (len(own) * df)))  # so many draws, of 4 MB
        for first in range(0, draws, at_once):
            null += drawn(np.stack([rng.choice(near, n, replace=False) for _ in range(min(at_once, draws - first))]), points)
        valid = [[x[k] for x in null if np.isfinite(x[k])] for k in (0, 1)]
        out["n_valid"] = min(map(len, valid))
        for name, real, xs, sign in (("l", out["l_ratio"], np.array(valid[0]), -1), ("iso", out["iso"], np.array(valid[1]), 1)):
            if len(xs) and np.isfinite(real):
                mean, sd = float(xs.mean()), float(xs.std(ddof=1)) if len(xs) > 1 else 0.0
                out |= {f"null_{name}": mean, f"sd_{name}": sd, f"p_{name}": float(((sign * xs >= sign * real).sum() + 1) / (len(xs) + 1))}
                if sd > 0:
                    out[f"z_{name}"] = sign * (real - mean) / sd
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for k, labels, points in zip(range(batch.num_rows), batch.column("labels"), batch.column("points")):
                labels = labels.values.to_numpy(zero_copy_only=False)
                points = points.values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(labels), df)
                name = batch.column(key)[k].as_py()
                for c in np.unique(labels):
                    own = labels == c
                    if df < own.sum() < len(own):
                        rows.append(one(name, c, own, points))
                        of.append(k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(of, pa.int64())), *(pa.array([None if isinstance(v := r.get(c), float) and not np.isfinite(v) else v for r in rows], t) for c, t in types.items())], names=[key, *types]
            )

    return spread(files.select(key, "labels", "points"), [key]).mapInArrow(run, ", ".join([f"{key} {kind}", *(f"{c} {'double' if c in doubles else 'bigint'}" for c in types)]))


def speed_modulation(units: DataFrame, keys: list[str], fps: float, draws: int = 1000, margin: float = 20.0, width: float = 5.0, low: float = 1.0, high: float = 90.0, rare: float = 0.002, counts: bool = False, sigma: float = 0.3, least: int = 100) -> DataFrame:
    """slope, intercept, r, p, rho, shapiro_p, n_null, shuffle_mean, shuffle_low, shuffle_high, shuffle_p and modulated.

    units: keys, speed (cm/s) and n (spikes) of each frame. Rates are smoothed by `sigma` seconds. Bins of `width` begin at
    `low`; those with less than a rare share of the frames are dropped, and fewer than three fit no line.

    In the first mode the speed is smoothed too, the line is weighted by frames, and the null rolls the smoothed rate: the
    unit is modulated if shuffle_p is below 0.05; shuffle_high is the 95th percentile of the null's sizes. With `counts` the
    speed is as it is, the line is of ordinary least squares, and the null rolls the counts, which are smoothed anew: the
    unit is modulated if its r lies outside the 2.5th to 97.5th percentile. Of a session too short for the margin the first
    mode takes a quarter, the second no null; with fewer than `least` valid draws the second tells nothing.
    """

    def f(seed: int, speed: np.ndarray, n: np.ndarray) -> dict:
        speed, n = speed.astype(float), n.astype(float)
        spread = max(sigma * fps, 1e-6)
        rate = signal.gaussian_smoothed(n * fps, spread)
        speed = speed if counts else signal.gaussian_smoothed(speed, spread)
        places = int(np.ceil((high - low) / width - 1e-9))
        ok = np.flatnonzero((speed > low) & (speed < high))
        place = np.clip(np.floor((speed[ok] - low) / width), 0, places - 1).astype(int)
        frames = np.bincount(place, minlength=places)
        bins = np.flatnonzero((frames > 0) & (frames >= rare * frames.sum()))
        if len(bins) < 3:
            return {}
        x, weight = low + (bins + 0.5) * width, np.ones(len(bins)) if counts else frames[bins].astype(float)
        weight /= weight.sum()
        share = np.zeros((places, len(n)))  # what each frame adds to its bin's mean
        share[place, ok] = 1 / frames[place]
        share = share[bins]

        def lines(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Slope, intercept and r of each column of mean rates; no r of those that differ by rounding alone."""
            a, b = weight @ x, weight @ y
            xx, xy, yy = weight @ (x - a) ** 2, (weight * (x - a)) @ (y - b), weight @ (y - b) ** 2
            return xy / xx, b - xy / xx * a, np.divide(xy, np.sqrt(xx * yy), out=np.full_like(xy, np.nan), where=yy > 1e-24 * (weight @ y**2))

        y = share @ rate
        slope, intercept, r = (float(v[0]) for v in lines(y[:, None]))
        rank = lambda v: np.searchsorted(np.sort(v), v, "left") + np.searchsorted(np.sort(v), v, "right")
        rho = float(np.corrcoef(rank(x), rank(np.round(y, 9)))[0, 1]) if np.isfinite(r) else float("nan")  # means that differ by less tie
        out = {"slope": slope, "intercept": intercept, "r": r, "p": stats.correlation_p(r, len(x)) if np.isfinite(r) else float("nan"), "rho": rho, "shapiro_p": stats.shapiro_wilk(y - intercept - slope * x)[1] if np.isfinite(r) else float("nan")}
        first = int(margin * fps)
        if not counts and len(n) <= 2 * first:
            first = max(1, len(n) // 4)
        if len(n) > 2 * first and draws and np.isfinite(r):
            shifts = np.random.default_rng(seed).integers(first, len(n) - first + 1, draws)
            # The means after every shift are a circular correlation; smoothing, which is linear, moves over to the shares.
            given = signal.gaussian_spread(share, spread) * fps if counts else share
            means = np.fft.irfft(np.fft.rfft(given) * np.conj(np.fft.rfft(n if counts else rate)), len(n))[:, shifts % len(n)]
            null = lines(means)[2]
            null = null[np.isfinite(null)]
            out["n_null"] = len(null)
            if len(null) >= (least if counts else 1):
                p = float(((np.abs(null) >= abs(r)).sum() + 1) / (len(null) + 1))
                low_, high_ = np.percentile(null, [2.5, 97.5]) if counts else (np.nan, np.percentile(np.abs(null), 95))
                modulated = r < low_ or r > high_ if counts else p < 0.05
                out |= {"shuffle_mean": float(null.mean()), "shuffle_low": float(low_), "shuffle_high": float(high_), "shuffle_p": p, "modulated": bool(modulated)}
        return {k: v if isinstance(v, (bool, int)) else float(v) for k, v in out.items()}

    schema = "slope double, intercept double, r double, p double, rho double, shapiro_p double, n_null bigint, shuffle_mean double, shuffle_low double, shuffle_high double, shuffle_p double, modulated boolean"
    return per_row(units, f, keys, ["speed", "n"], schema)


def gridded_speed(units: DataFrame, keys: list[str], fps: float, window: float = 0.08, low: float = 4.0, high: float = 100.0, width: float = 2.0, rare: float = 0.01) -> DataFrame:
    """raw_r, n_bins, slope, intercept, r and p of the older speed score, on a grid of equal steps.

    units: keys, x, y (cm) and t (ms) of each position, and spikes (ms). Speeds are steps times fps, the last one repeated. Spikes
    are counted in steps of 1000 / fps from the first position on (the last place holds those at its time alone), and
    smoothed forth and back by equal weights of `window` seconds, as that script's Gaussian is when so wide; at the ends the
    signal is reflected about its last value by three times the filter, and the filter begins as if the first value had
    always been. As in that script the rates are cut to as many as there are spikes. Bins of `width` with less than a rare share
    of the samples are left out of the line, whose x are their middles.
    """

    def forth_and_back(x: np.ndarray, taps: int) -> np.ndarray:
        if taps < 2 or len(x) <= 3 * (taps - 1):
            return x
        pad = 3 * (taps - 1)
        y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
        for _ in range(2):
            y = np.convolve(np.concatenate([np.full(taps - 1, y[0]), y]), np.full(taps, 1 / taps), "valid")[::-1]
        return y[pad : pad + len(x)]

    def f(seed: int, x: np.ndarray, y: np.ndarray, t: np.ndarray, spikes: np.ndarray) -> dict:
        if len(x) < 2:
            return {}
        x, y, t, spikes = (v.astype(float) for v in (x, y, t, spikes))
        speed = np.hypot(np.diff(x), np.diff(y)) * fps
        speed = np.append(speed, speed[-1])
        edges = t[0] + np.arange(int((t[-1] - t[0]) * fps / 1000 + 1e-9) + 1) * 1000 / fps
        at = np.searchsorted(edges, spikes, "right") - 1
        at = at[(at >= 0) & ((at < len(edges) - 1) | (spikes == edges[-1]))]
        rate = forth_and_back(np.bincount(at, minlength=len(edges)) * fps, int(round(window * fps)))[: len(spikes)]
        n = min(len(speed), len(rate))
        on = (speed[:n] > low) & (speed[:n] < high)
        v, r = speed[:n][on], rate[:n][on]
        if len(v) < 2 or v.std() == 0 or r.std() == 0:
            return {}
        place = np.floor((v - low) / width).astype(int)
        counts = np.bincount(place, minlength=int((high - low) / width))
        bins = np.flatnonzero((counts > 0) & (counts >= rare * counts.sum()))
        out = {"raw_r": float(np.corrcoef(v, r)[0, 1]), "n_bins": len(bins)}
        if len(bins) > 2:
            a, b = low + (bins + 0.5) * width, np.bincount(place, r, len(counts))[bins] / counts[bins]
            slope, intercept = np.polyfit(a, b, 1)
            score = float(np.corrcoef(a, b)[0, 1]) if b.std() > 0 else float("nan")
            out |= {"slope": float(slope), "intercept": float(intercept), "r": score, "p": float(stats.correlation_p(score, len(bins))) if np.isfinite(score) else float("nan")}
        return out

    return per_row(units, f, keys, ["x", "y", "t", "spikes"], "raw_r double, n_bins bigint, slope double, intercept double, r double, p double")


def parameterised(rows: DataFrame, keys: list[str], low: float = 1.0, high: float = 100.0, widths: tuple[float, float] = (1.0, 8.0), most: int = 6, least: float = 0.1, times: float = 2.0, knee: bool = True) -> DataFrame:
    """offset, knee, exponent, r_squared, error and peaks (centre, height, width) of each spectrum (freqs, power).

    log10 power is an aperiodic part, offset - log10(knee + f**exponent), and Gaussians: the first fit leaves out points
    above it, the tallest remainder is taken as a peak until none is high enough, all peaks are fitted together, and the
    aperiodic part once more to what is left.
    """

    def f(seed: int, freqs: np.ndarray, power: np.ndarray) -> dict:
        on = (freqs >= low) & (freqs <= high) & (freqs > 0) & (power > 0)
        if on.sum() < 8:
            return {}
        x, y = freqs[on].astype(float), np.log10(power[on].astype(float))
        aperiodic = lambda q: q[0] - np.log10(np.maximum(np.abs(q[1]) * knee + x ** q[2], 1e-12))
        bumps = lambda q: sum((h * np.exp(-((x - c) ** 2) / (2 * s * s)) for c, h, s in q.reshape(-1, 3)), np.zeros_like(x))

        def bump_slopes(q: np.ndarray, step: np.ndarray) -> np.ndarray:
            """Differences by each number of each peak, which moves that peak alone."""
            (c, h, s), (dc, dh, ds) = (v.reshape(-1, 3).T[:, :, None] for v in (q, step))
            one = lambda c, h, s: h * np.exp(-((x - c) ** 2) / (2 * s * s))
            own = one(c, h, s)
            moved = np.stack([one(c + dc, h, s), one(c, h + dh, s), one(c, h, s + ds)], 1)
            total, before = np.zeros((len(q), len(x))), np.zeros_like(x)
            for k in range(len(own)):  # summed in the order of bumps
                moved_of = total.reshape(-1, 3, len(x))
                moved_of[:k] += own[k]
                moved_of[k] = before + moved[k]
                moved_of[k + 1 :] += own[k]
                before = before + own[k]
            return np.ascontiguousarray((((total - flat) - (before - flat)) / step[:, None]).T)

        start = np.array([y[0], 0.0, (y[0] - y[-1]) / np.log10(x[-1] / x[0])])
        first = least_squares(lambda q: aperiodic(q) - y, start)
        rest = y - aperiodic(first)
        under = rest <= np.percentile(rest, 2.5) if (rest <= np.percentile(rest, 2.5)).sum() > 8 else rest <= np.median(rest)
        robust = least_squares(lambda q: (aperiodic(q) - y)[under], first)
        flat = y - aperiodic(robust)
        left, guess = flat.copy(), []
        while len(guess) < most:
            k = int(np.argmax(left))
            if left[k] < least or left[k] < times * left.std():
                break
            half = np.flatnonzero(left < left[k] / 2)
            near = [abs(int(i) - k) for i in (half[half < k][-1:].tolist() + half[half > k][:1].tolist())]
            spread = (min(near) if near else 2) * (x[1] - x[0]) * 2 / 2.3548
            s = float(np.clip(spread, widths[0] / 2, widths[1] / 2))
            guess.append((x[k], left[k], s))
            left = left - left[k] * np.exp(-((x - x[k]) ** 2) / (2 * s * s))
        peaks = np.array([g for g in guess if low + g[2] < g[0] < high - g[2]]).ravel()
        if len(peaks):
            peaks = least_squares(lambda q: bumps(q) - flat, peaks, slopes=bump_slopes)
            peaks.reshape(-1, 3)[:, 2] = np.clip(np.abs(peaks.reshape(-1, 3)[:, 2]), widths[0] / 2, widths[1] / 2)
        final = least_squares(lambda q: aperiodic(q) - (y - bumps(peaks)), robust)
        model = aperiodic(final) + bumps(peaks)
        r2 = np.corrcoef(model, y)[0, 1] ** 2 if y.std() > 0 and model.std() > 0 else float("nan")
        return {"offset": float(final[0]), "knee": float(abs(final[1]) * knee), "exponent": float(final[2]), "r_squared": float(r2), "error": float(np.abs(model - y).mean()), "peaks": [[float(c), float(h), float(2 * abs(s))] for c, h, s in sorted(peaks.reshape(-1, 3).tolist())]}

    return per_row(spread(rows, keys), f, keys, ["freqs", "power"], "offset double, knee double, exponent double, r_squared double, error double, peaks array<array<double>>")


def least_squares(f: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int = 100, slopes: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Levenberg-Marquardt with differences for the derivatives, those of slopes(q, step) if given; it stays where they
    aren't finite."""
    q, damp = np.array(start, float), 1e-2
    r = f(q)
    for _ in range(rounds):
        step = 1e-6 * np.maximum(1, np.abs(q))
        j = slopes(q, step) if slopes else np.stack([(f(q + np.eye(len(q))[i] * step[i]) - r) / step[i] for i in range(len(q))], 1)
        a, g = j.T @ j, j.T @ r
        if not (np.isfinite(a).all() and np.isfinite(g).all()):
            break
        try:
            move = -np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0]
        except np.linalg.LinAlgError:
            break
        new = f(q + move)
        if np.isfinite(new).all() and new @ new < r @ r:
            done = r @ r - new @ new < 1e-12 * (r @ r)
            q, r, damp = q + move, new, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e10:
                break
    return q


def smoothed(samples: DataFrame, key: str, order: str, value: str, method: str, width: float, length: int = 1 << 16) -> DataFrame:
    """key, i and v: each trace smoothed in place, by a Gaussian, or by local polynomials (not below 0), as whole traces are.

    samples: as for `blocks`. A Gaussian reads four of its deviations, a polynomial its window. In place each value becomes the
    mean of `width` (odd) around it, of which the earlier ones are smoothed already: what a block can't know of those fades
    by a factor with each sample, the largest root of that recursion, and the halo is as long as it takes to vanish.
    """
    half = int(width) // 2
    if method == "in_place":
        root = np.abs(np.roots([width, *[-1.0] * half])).max() if half else 0.0
        halo = half + (int(np.ceil(-40 / np.log(root))) if root > 0 else 0)
        f = lambda x: signal.smoothed_in_place(x, int(width))
    elif method == "gaussian":
        halo, f = int(4 * width + 0.5), lambda x: signal.gaussian_smoothed(x, width)
    elif method == "polynomial":
        halo, f = int(width), lambda x: np.maximum(signal.savitzky_golay(x, int(width)), 0)
    else:
        raise ValueError(method)

    def own(seed: int, block: int, start: int, x: np.ndarray) -> dict:
        at = block * length - start
        return {"smooth": f(x.astype(float))[at : at + length].tolist()}

    rows = per_row(blocks(samples, key, order, value, length, halo), own, [key, "block"], ["block", "start", "samples"], "smooth array<double>")
    return rows.select(key, "block", F.posexplode("smooth").alias("i", "v")).select(key, (F.col("block") * length + F.col("i")).alias("i"), "v")


def wave_features(files: DataFrame, key: str) -> DataFrame:
    """key, energy and pc1 of each spike of a file (waves: an array of equally long arrays).

    energy is the root mean square; pc1 the first principal component of the waves of unit length, with samples
    standardised; its sign makes its largest weight positive.
    """

    def f(seed: int, waves: np.ndarray) -> dict:
        if not len(waves):
            return {"energy": [], "pc1": []}
        w = np.stack(waves).astype(float)
        energy = np.sqrt((w**2).mean(1))
        unit = w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
        z = unit - unit.mean(0)
        z /= np.where(z.std(0) > 0, z.std(0), 1)
        first = np.linalg.eigh(z.T @ z / len(z))[1][:, -1]
        first *= np.sign(first[np.abs(first).argmax()]) or 1
        return {"energy": energy.tolist(), "pc1": (z @ first).tolist()}

    return per_row(files, f, [key], ["waves"], "energy array<double>, pc1 array<double>")


def intrinsic_firing(rows: DataFrame, key: str, width: float, bands: tuple[tuple[float, float], ...] = ((4, 12), (2, 4))) -> DataFrame:
    """theta_freq, theta_z, delta_freq, delta_z, mean_freq and mode_freq of autocorrelograms (counts, bins of `width` seconds).

    Power is standardised over the spectrum above 0; the mean and the mode (in whole Hz) are of the instantaneous
    frequency of the counts filtered to the theta band.
    """

    def f(seed: int, counts: np.ndarray) -> dict:
        x = signal.detrended(counts.astype(float), False)
        if len(x) < 16 or x.std() == 0:
            return {}
        power, freqs = np.abs(np.fft.rfft(x))[1:] ** 2, np.fft.rfftfreq(len(x), width)[1:]
        z = (power - power.mean()) / (power.std() or 1)
        out = {}
        for name, (low, high) in zip(("theta", "delta"), bands):
            on = np.flatnonzero((freqs >= low) & (freqs <= high))
            if len(on):
                k = on[z[on].argmax()]
                out |= {f"{name}_freq": float(freqs[k]), f"{name}_z": float(z[k])}
        if bands[0][1] < 0.5 / width:
            f_inst = signal.instantaneous_frequency(signal.butterworth(x, *bands[0], 1 / width), 1 / width)
            inside = f_inst[(f_inst >= bands[0][0]) & (f_inst <= bands[0][1])]
            if len(inside):
                out |= {"mean_freq": float(inside.mean()), "mode_freq": float(np.bincount(np.round(inside).astype(int)).argmax())}
        return out

    return per_row(rows, f, [key], ["counts"], "theta_freq double, theta_z double, delta_freq double, delta_z double, mean_freq double, mode_freq double")


def shifted_information(bins: np.ndarray, seconds: np.ndarray, spikes: np.ndarray, shifts: np.ndarray, least: float, taken: np.ndarray, base: float) -> np.ndarray:
    """The information of the map after each shift of the spikes, with the bins that are taken clamped to the base rate."""
    shape, valid, out = seconds.shape, seconds >= least, []
    p = np.where(valid, seconds, 0) / max(seconds[valid].sum(), 1e-300)
    weights = [(i, j, (2 - abs(i)) * (2 - abs(j))) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    around = lambda a: sum(w * a[..., 1 + i : a.shape[-2] - 1 + i, 1 + j : a.shape[-1] - 1 + j] for i, j, w in weights)
    low = around(np.pad(valid.astype(float), 1))
    few = max(1, 2_000_000 // max(len(spikes), seconds.size))
    for part in np.array_split(shifts, range(few, len(shifts), few)):
        at = bins[(spikes + part[:, None]) % len(bins)] + np.arange(len(part))[:, None] * seconds.size
        counts = np.bincount(at.ravel(), minlength=len(part) * seconds.size).reshape(-1, *shape)
        r = np.where(valid, counts / np.where(valid, seconds, 1), 0)
        r = np.where(valid, around(np.pad(r, ((0, 0), (1, 1), (1, 1)))) / np.where(low > 0, low, 1), 0)
        r = np.where(taken, base, r)
        mean = (p * r).sum((1, 2))
        ratio = r / np.where(mean > 0, mean, 1)[:, None, None]
        out.append((p * ratio * np.log2(np.where(ratio > 0, ratio, 1))).sum((1, 2)))
    return np.concatenate(out)


def first_field(rate: np.ndarray, free: np.ndarray, share: float, least: float) -> np.ndarray | None:
    """The 8-connected field around the highest free bin whose field has `least` bins; none if no bin's has."""
    for k in np.argsort(-np.where(free, rate, -np.inf), axis=None, kind="stable"):
        seed = np.unravel_index(k, rate.shape)
        if not free[seed] or rate[seed] <= 0:
            return None
        allowed, mask = free & (rate >= share * rate[seed]), np.zeros_like(free)
        mask[seed] = True
        while True:
            q = np.pad(mask, 1)
            grown = allowed & np.any([q[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)], 0)
            if (grown == mask).all():
                break
            mask = grown
        if mask.sum() >= least:
            return mask
    return None


def suppressed_fields(seed: int, bins: np.ndarray, occ: np.ndarray, spikes: np.ndarray, nx: int, ny: int, fps: float, draws: int = 1000, margin: float = 20.0, least: float = 1.0, limit: float = 0.5, share: float = 0.2, smallest: float = 0.04, more: int = 50, peaks: tuple[float, float] = (1.0, 15.0), sparse: float = 0.9) -> list[tuple[int, float, float]]:
    """Bins, peak and the information left of each field of one unit, as in iterative_fields."""
    low, high = int(margin * fps), len(bins) - int(margin * fps)
    if not len(bins) or not len(spikes) or high < low:
        return []
    bins, spikes, occ = bins.astype(np.int64), spikes.astype(np.int64), occ.astype(float)
    rate, seconds = rate_map(bins, occ, spikes, (nx, ny), least)
    valid, every, rng = seconds > 0, np.bincount(bins, occ, nx * ny).reshape(nx, ny), np.random.default_rng(seed)
    base, taken = rate[valid].min() if valid.any() else 0.0, np.zeros((nx, ny), bool)

    def place_cell() -> bool:
        mean, square = (seconds * rate).sum(), (seconds * rate**2).sum() * seconds.sum()
        if not (len(spikes) > more and peaks[0] < rate.max() < peaks[1] and mean**2 < sparse * square and information(rate, seconds) > limit):
            return False
        null = shifted_information(bins, every, spikes, rng.integers(low, high + 1, draws), least, taken, base)
        return information(rate, seconds) > np.percentile(null, 95)

    out = []
    while place_cell():
        found = first_field(rate, valid & ~taken, share, smallest * valid.sum())
        if found is None:
            break
        size, peak = int(found.sum()), float(rate[found].max())
        taken |= found
        rate = np.where(taken, base, rate)
        out.append((size, peak, information(rate, seconds)))
    return out


def iterative_fields(units: DataFrame, keys: list[str], nx: int, ny: int, fps: float, **options) -> DataFrame:
    """n_fields, sizes, peaks and the information left after each field has been lowered to the map's smallest rate.

    The strongest field is taken and suppressed while the unit is a place cell: more than `more` spikes, a peak rate within
    peaks, information above the limit and above the 95th percentile of shuffles, sparsity below `sparse`. After each
    field the shuffles are drawn again, with all fields suppressed in them too. units: as for shuffled_information; options:
    of suppressed_fields.
    """

    def f(seed: int, bins: np.ndarray, occ: np.ndarray, spikes: np.ndarray) -> dict:
        found = suppressed_fields(seed, bins, occ, spikes, nx, ny, fps, **options)
        return {"n_fields": len(found), "sizes": [x[0] for x in found], "peaks": [x[1] for x in found], "left": [x[2] for x in found]}

    return per_row(units, f, keys, ["bins", "occ", "spikes"], "n_fields bigint, sizes array<bigint>, peaks array<double>, left array<double>")
