"""Peaks of long traces: spacing in blocks with halos, prominence by what blocks carry to those after them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signal
from .kernels import blocks
from .storage import kept

#: What a block tells of itself: its maxima with their bases, and the heights by which it hides what lies behind it.
BLOCK = (
    "unsure boolean, at array<long>, v array<double>, left_low array<double>, left_closed array<boolean>, right_low array<double>, right_closed array<boolean>, "
    "low double, high double, last_heights array<double>, last_lows array<double>, first_heights array<double>, first_lows array<double>"
)


def _steps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the first value on, each that is higher than all before it, and the lowest value before it (inf for the first)."""
    top = np.maximum.accumulate(x)
    new = np.concatenate([[True], top[1:] > top[:-1]])
    low = np.concatenate([[np.inf], np.minimum.accumulate(x)[:-1]])
    return x[new], low[new]


def _block(x: np.ndarray, start: int, first: int, length: int, halo: int, distance: int) -> dict:
    """BLOCK's values, of a block of `length` samples from number `first` on, out of samples from number `start` on."""
    begins, ends = start == 0, start + len(x) < first + length + halo
    a, b = first - start, min(first - start + length, len(x))
    at = signal.maxima(x)
    begin, end = signal.runs(x)
    low = -np.inf if begins else float(end[0])
    high = np.inf if ends else float(begin[-1])
    # A run cut off by the view may have its middle in the block.
    unsure = not begins and end[0] // 2 >= a or not ends and (begin[-1] + len(x) - 1) // 2 < b
    state = signal.spaced(at, x[at], distance, low, high)
    own = (at >= a) & (at < b)
    unsure = bool(unsure or (state[own] == signal.UNKNOWN).any())
    at, x = at[own & (state == signal.KEPT)] - a, x[a:b]
    # All the block's maxima hide what is behind them, those that are not far enough from others too.
    left_low, left_closed = _bases(x, at)
    right_low, right_closed = (y[::-1] for y in _bases(x[::-1], len(x) - 1 - at[::-1]))
    last, before = _steps(x[::-1])
    head, after = _steps(x)
    values = (unsure, at + first, x[at], left_low, left_closed, right_low, right_closed, float(x.min()), float(x.max()), last, before, head, after)
    return dict(zip((c.split()[0] for c in BLOCK.split(", ")), values))


def _bases(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As signal.bases, of some places that need not be maxima within x (a plateau may go on beyond it)."""
    every = np.union1d(signal.maxima(x), at).astype(np.int64)
    low, closed = signal.bases(x, every)
    which = np.searchsorted(every, at)
    return low[which], closed[which]


def _in_blocks(samples: DataFrame, key: str, order: str, value: str, distance: int, length: int, halo: int, only: DataFrame | None = None) -> DataFrame:
    rows = blocks(samples, key, order, value, length, halo, only)
    kinds = dict(rows.dtypes)
    names = [c.split()[0] for c in BLOCK.split(", ")]
    types = [pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.float64(), pa.float64(), *[pa.list_(pa.float64())] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_block(x.values.to_numpy(zero_copy_only=False).astype(float), s, b * length, length, halo, distance) for b, s, x in zip(batch.column("block").to_pylist(), batch.column("start").to_pylist(), batch.column("samples"))]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("block"), *(pa.array([f[n] for f in found], t) for n, t in zip(names, types))], names=[key, "block", *names])

    return rows.mapInArrow(run, f"{key} {kinds[key]}, block long, {BLOCK}")


def _carried(table: pd.DataFrame, side: str) -> list[np.ndarray]:
    """The bases on one side of the peaks that are open, with what the blocks before (or, from the right, after) add."""
    out, heights, lows = [], np.empty(0), np.empty(0)  # nearest first, heights rising; the lowest value nearer than each
    rest = np.inf  # the lowest of all that is nearer than the trace's end
    near, hide = ("left", "last") if side == "left" else ("right", "first")
    for r in table.itertuples():
        low, closed = np.array([p[f"{near}_low"] for p in r.open], float), np.array([p[f"{near}_closed"] for p in r.open], bool)
        found = np.searchsorted(heights, np.array([p["v"] for p in r.open], float), "right")
        beyond = np.append(lows, rest)[found]
        out.append(np.where(closed, low, np.minimum(low, beyond)))
        own, before = np.array(getattr(r, f"{hide}_heights"), float), np.array(getattr(r, f"{hide}_lows"), float)
        keep = heights > r.high
        heights, lows = np.concatenate([own, heights[keep]]), np.concatenate([before, np.minimum(lows[keep], r.low)])
        rest = min(rest, r.low)
    return out


def peaks(samples: DataFrame, key: str, order: str, value: str, distance: int = 1, prominence: float | Column = 0.0, length: int = 1 << 16, halo: int | None = None) -> DataFrame:
    """key, i, v and prominence of the local maxima of each trace (the middle of a plateau; ends are none), that are
    `distance` samples apart, higher ones first and of equal ones the last, and then rise by `prominence` or more.

    samples: as for `kernels.blocks`. A prominence is the height above the higher of the two lowest values on the way to
    something higher, or to the end. prominence may be an expression of key, or a column to join by it first.

    Spacing depends on a maximum's surroundings only: blocks whose halo (16 distances) was too small for what it says are
    done again with four times the halo, until none is left. What is higher may be anywhere: most peaks have it in their own
    block; for the others, as few as a block's values rise in steps towards its edges, each block keeps these steps, and one
    pass over the blocks of a trace carries them on.
    """
    halo = max(halo or 16 * distance, 2)
    found, done = kept(_in_blocks(samples, key, order, value, distance, length, halo)), None
    while not found.filter("unsure").isEmpty():
        halo *= 4
        sure = found.filter("NOT unsure")
        done = sure if done is None else done.unionByName(sure)
        found = kept(_in_blocks(samples, key, order, value, distance, length, halo, found.filter("unsure").select(key, "block")))
    found = found if done is None else done.unionByName(found)
    kind = dict(found.dtypes)[key]
    each = F.arrays_zip("at", "v", "left_low", "left_closed", "right_low", "right_closed")
    sure = lambda p: p["left_closed"] & p["right_closed"]
    known = found.select(key, F.explode(F.filter(each, sure)).alias("p"))
    known = known.select(key, F.col("p.at").alias("i"), "p.v", (F.col("p.v") - F.greatest("p.left_low", "p.right_low")).alias("prominence"))

    def joined(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("block")
        left, right = np.concatenate(_carried(table, "left")), np.concatenate(_carried(table[::-1], "right")[::-1])
        rows = [p for own in table["open"] for p in own]
        v = np.array([p["v"] for p in rows], float)
        keys = np.empty(len(rows), object)
        keys[:] = [table[key].iloc[0]] * len(rows)
        return pd.DataFrame({key: keys, "i": np.array([p["at"] for p in rows], np.int64), "v": v, "prominence": v - np.maximum(left, right)})

    steps = ["low", "high", "last_heights", "last_lows", "first_heights", "first_lows"]
    rest = found.select(key, "block", F.filter(each, lambda p: ~sure(p)).alias("open"), *steps)
    rest = rest.groupBy(key).applyInPandas(joined, f"{key} {kind}, i long, v double, prominence double")
    return known.unionByName(rest).filter(F.col("prominence") >= prominence)


def phase_profile(traces: DataFrame, snippet: str, channel: str, i: str, value: str, fs: float, reference: object, distance: float = 0.1, guard: float = 0.2, share: float = 0.5, signed: bool = True, **options) -> DataFrame:
    """channel, phase (radians), r, n (snippets) and lag (seconds) of each channel's first peak after the reference's; period.

    traces: filtered samples of each snippet and channel, numbered from 0. Peaks are `distance` seconds apart and rise by a
    share of their trace's deviation. The reference's first peak from `guard` seconds on is time 0, the median of
    the steps between its peaks the period: of a snippet with fewer than two such peaks nothing is known. Snippets are merged
    as sums of unit vectors; a lag is a phase times the mean period. signed: phases in (-pi, pi], else in [0, 2 pi).
    """
    rows = traces.select(F.struct(F.col(snippet).alias("s"), F.col(channel).alias("c")).alias("key"), F.col(i).alias("i"), F.col(value).alias("v"))
    limits = rows.groupBy("key").agg(F.greatest(share * F.stddev_pop("v"), F.lit(1e-9)).alias("limit"))
    found = peaks(rows, "key", "i", "v", max(1, int(distance * fs)), **options).join(limits, "key").filter("prominence >= `limit`")
    found = kept(found.select("key.s", "key.c", (F.col("i") / fs).alias("t")))
    times = F.array_sort(F.collect_list("t"))
    lead = found.filter((F.col("c") == F.lit(reference)) & (F.col("t") >= guard)).groupBy("s").agg(times.alias("t")).filter(F.size("t") >= 2)
    steps = F.array_sort(F.transform(F.slice("t", 2, F.size("t") - 1), lambda x, k: x - F.get(F.col("t"), k)))
    middle = lambda k: F.get(F.col("steps"), k.cast("int"))
    lead = lead.select("s", F.get("t", F.lit(0)).alias("start"), steps.alias("steps"))
    lead = lead.select("s", "start", ((middle(F.floor((F.size("steps") - 1) / 2)) + middle(F.floor(F.size("steps") / 2))) / 2).alias("period"))
    first = found.join(lead, "s").filter("t >= start").groupBy("s", "c", "period").agg(F.min(F.col("t") - F.col("start")).alias("lag"))
    turn = 2 * F.pi() * (F.col("lag") % F.col("period")) / F.col("period")
    sums = first.groupBy("c").agg(F.sum(F.cos(turn)).alias("x"), F.sum(F.sin(turn)).alias("y"), F.count(F.lit(1)).alias("n"))
    mean = lead.agg(F.avg("period")).first()[0]  # one number
    phase = F.atan2("y", "x") if signed else F.pmod(F.atan2("y", "x"), F.lit(2 * np.pi))
    out = sums.select(F.col("c").alias(channel), phase.alias("phase"), (F.hypot("x", "y") / F.col("n")).alias("r"), "n", F.lit(mean).cast("double").alias("period"))
    return out.select(channel, "phase", "r", "n", (F.col("phase") / (2 * F.pi()) * F.col("period")).alias("lag"), "period")
