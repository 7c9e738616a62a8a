"""Spatial maps: occupancy, spike counts, rates, smoothing, information measures and map comparisons.

A map is a table of bins (keys, bx, by_). Neighbourhoods are joins with a small table of offsets, whose size
is fixed by the kernel; each bin is sent to its neighbours, so bins meet by an equal key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation

#: Weights of the 3 by 3 triangular filter.
TRIANGLE = {(dx, dy): (2 - abs(dx)) * (2 - abs(dy)) for dx in (-1, 0, 1) for dy in (-1, 0, 1)}


def binned(rows: DataFrame, x: str, y: str, size: float, by: list[str]) -> DataFrame:
    """bx and by_: bins of equal size from 0, what lies at the far edge in the last one."""
    whole = Window.partitionBy(*by)
    place = lambda c: F.greatest(F.lit(0), F.least(F.floor(F.col(c) / size), F.ceil(F.max(c).over(whole) / size) - 1)).cast("long")
    return rows.withColumns({"bx": place(x), "by_": place(y)})


def binned_open(rows: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """bx and by_ without the far edge's clip."""
    return rows.withColumns({"bx": F.floor(F.col(x) / size), "by_": F.floor(F.col(y) / size)})


def occupancy(rows: DataFrame, by: list[str], ts: str, fps: float, unit: float = 1e6) -> DataFrame:
    """Seconds in each bin: the time since the frame before, at most two frames', and one frame's for the first."""
    w = Window.partitionBy(*by).orderBy(ts)
    dt = F.coalesce(F.least((F.col(ts) - F.lag(ts).over(w)) / unit, F.lit(2 / fps)), F.lit(1 / fps))
    return rows.withColumn("__dt", dt).groupBy(*by, "bx", "by_").agg(F.sum("__dt").alias("occ"))


def occupancy_fixed(rows: DataFrame, by: list[str], seconds: float) -> DataFrame:
    """Seconds in each bin when every frame lasts equally long."""
    return rows.groupBy(*by, "bx", "by_").agg((F.count(F.lit(1)) * seconds).alias("occ"))


def occupancy_median(rows: DataFrame, by: list[str], ts: str, unit: float = 1e3) -> DataFrame:
    """Frames in each bin times the median time between frames."""
    w = Window.partitionBy(*by).orderBy(ts)
    rows = rows.withColumn("__dt", (F.col(ts) - F.lag(ts).over(w)) / unit)
    step = rows.groupBy(*by).agg(F.percentile("__dt", F.lit(0.5)).alias("__step"))
    return rows.groupBy(*by, "bx", "by_").agg(F.count(F.lit(1)).alias("n")).join(step, by).select(*by, "bx", "by_", (F.col("n") * F.col("__step")).alias("occ"))


def rates(occ: DataFrame, spikes: DataFrame, keys: list[str], least: float) -> DataFrame:
    """occ with n, valid (occ at least `least`) and rate: n / occ in valid bins, else 0."""
    counts = spikes.groupBy(*keys, "bx", "by_").agg(F.count(F.lit(1)).alias("n"))
    rows = occ.join(counts, [*keys, "bx", "by_"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "valid": F.col("occ") >= least})
    return rows.withColumn("rate", F.when(F.col("valid"), F.col("n") / F.col("occ")).otherwise(0.0))


def spread(bins: DataFrame, keys: list[str], value: str, offsets: dict[tuple[int, int], float]) -> DataFrame:
    """Each bin's value at the places of the offsets, with their weights: keys, bx, by_, v, w."""
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("w")) for (dx, dy), w in offsets.items()]))
    rows = bins.select(*keys, "bx", "by_", F.col(value).alias("v"), steps.alias("s"))
    return rows.select(*keys, (F.col("bx") + F.col("s.dx")).alias("bx"), (F.col("by_") + F.col("s.dy")).alias("by_"), "v", F.col("s.w").alias("w"))


def smoothed(bins: DataFrame, keys: list[str], value: str = "rate", offsets: dict[tuple[int, int], float] = TRIANGLE, name: str = "smooth") -> DataFrame:
    """Bins with the weighted mean of the valid bins around, 0 where a bin isn't valid."""
    around = spread(bins.filter("valid"), keys, value, offsets).groupBy(*keys, "bx", "by_").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias(name))
    rows = bins.join(around, [*keys, "bx", "by_"], "left")
    return rows.withColumn(name, F.when(F.col("valid"), F.col(name)).otherwise(0.0))


def disk(radius: int) -> dict[tuple[int, int], float]:
    return {(dx, dy): 1.0 for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius}


def gaussian(sigma: float, truncate: float = 4.0) -> dict[tuple[int, int], float]:
    import math

    r = int(truncate * sigma + 0.5)
    return {(dx, dy): math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)) for dx in range(-r, r + 1) for dy in range(-r, r + 1)}


def information(bins: DataFrame, keys: list[str], rate: str = "smooth", occ: str = "occ") -> DataFrame:
    """peak_fr, mean_fr, sir (bits a spike, 0 without a rate) and sparsity over the valid bins."""
    group = keys or ["__all"]
    rows = bins.filter("valid") if keys else bins.filter("valid").withColumn("__all", F.lit(0))
    share = rows.groupBy(*group).agg(F.sum(occ).alias("__t"), F.max(rate).alias("peak_fr"), (F.sum(F.col(rate) * F.col(occ)) / F.sum(occ)).alias("mean_fr"), (F.sum(F.col(rate) * F.col(rate) * F.col(occ)) / F.sum(occ)).alias("__square"))
    part = F.when(F.col(rate) > 0, F.col(occ) / F.col("__t") * (F.col(rate) / F.col("mean_fr")) * F.log2(F.col(rate) / F.col("mean_fr"))).otherwise(0.0)
    joined = rows.join(share, group).groupBy(*group)
    out = joined.agg(F.first("peak_fr").alias("peak_fr"), F.first("mean_fr").alias("mean_fr"), F.sum(part).alias("sir"), F.first("__square").alias("__square"))
    return out.select(*keys, "peak_fr", "mean_fr", F.when(F.col("mean_fr") > 0, F.col("sir")).otherwise(0.0).alias("sir"), F.when(F.col("__square") > 0, F.col("mean_fr") ** 2 / F.col("__square")).alias("sparsity"))


def neighbour_mean(bins: DataFrame, keys: list[str], value: str, isolated: float | None = None) -> DataFrame:
    """Valid bins with `around`, the mean of their 8 valid neighbours; bins without any are dropped, or get `isolated`."""
    steps = {k: 1.0 for k in TRIANGLE if k != (0, 0)}
    rows = bins.filter("valid")
    around = spread(rows, keys, value, steps).groupBy(*keys, "bx", "by_").agg(F.avg("v").alias("around"))
    out = rows.join(around, [*keys, "bx", "by_"], "inner" if isolated is None else "left")
    return out if isolated is None else out.withColumn("around", F.coalesce("around", F.lit(isolated)))


def coherence(bins: DataFrame, keys: list[str], value: str = "rate") -> DataFrame:
    """Fisher z of the correlation of bins and their neighbours' means; null with fewer than 3 bins."""
    r = F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), correlation(value, "around")))
    return neighbour_mean(bins, keys, value).groupBy(*keys).agg(F.when(F.count(F.lit(1)) > 2, 0.5 * F.ln((1 + r) / (1 - r))).alias("coherence"))


def coherence_all(bins: DataFrame, keys: list[str], value: str = "rate") -> DataFrame:
    """The plain correlation, bins without neighbours having a neighbours' mean of 0."""
    return neighbour_mean(bins, keys, value, 0.0).groupBy(*keys).agg(correlation(value, "around").alias("coherence"))


def compared(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of two maps over the bins that both have: Pearson's r, r over bins where either isn't 0, Spearman's r; -2 where undefined."""
    rows = a.select(*keys, "bx", "by_", F.col(value).alias("x")).join(b.select(*keys, "bx", "by_", F.col(value).alias("y")), [*keys, "bx", "by_"])
    for c in "xy":
        group = Window.partitionBy(*keys)
        first = F.rank().over(group.orderBy(c))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
        rows = rows.withColumn(f"r{c}", first + (ties - 1) / 2)
    some = (F.col("x") != 0) | (F.col("y") != 0)
    r = lambda x, y: F.coalesce(correlation(x, y), F.lit(-2.0))
    x, y = F.col("x"), F.col("y")
    return rows.groupBy(*keys).agg(r(x, y).alias("pearson"), r(F.when(some, x), F.when(some, y)).alias("pearson_some"), r("rx", "ry").alias("spearman"))


def visited(bins: DataFrame, track: DataFrame, by: str, x: str, y: str, distance: float) -> DataFrame:
    """Bins (by, bx, by_, cx, cy) with a position within the distance of their centre. Both sides meet in cells as wide."""
    cell = lambda c: F.floor(F.col(c) / distance)
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = bins.withColumn("__i", F.explode(F.transform(steps, lambda d: cell("cx") + d))).withColumn("__j", F.explode(F.transform(steps, lambda d: cell("cy") + d)))
    right = track.select(by, F.col(x).alias("__x"), F.col(y).alias("__y"), cell(x).alias("__i"), cell(y).alias("__j")).distinct()
    near = left.join(right, [by, "__i", "__j"]).filter(F.hypot(F.col("cx") - F.col("__x"), F.col("cy") - F.col("__y")) <= distance)
    return bins.join(near.select(by, "bx", "by_").distinct(), [by, "bx", "by_"], "left_semi")


def directional(rows: DataFrame, by: str, degrees: Column, width: float = 6.0) -> DataFrame:
    """rows with `sector`: bins (a, b] of a direction in degrees, 0 counting as 360."""
    d = F.pmod(degrees, F.lit(360.0))
    return rows.withColumn("sector", F.ceil(F.when(d == 0, 360.0).otherwise(d) / width))


def direction(rows: DataFrame, by: str, order: str, x: str, y: str) -> DataFrame:
    """direction: whole degrees, 0 to 359, of the step to the next row."""
    w = Window.partitionBy(by).orderBy(order)
    angle = F.degrees(F.atan2(F.lead(y).over(w) - F.col(y), F.lead(x).over(w) - F.col(x)))
    return rows.withColumn("direction", F.pmod(F.bround(F.pmod(angle, F.lit(360.0))), F.lit(360.0)))
