"""Spike-train and waveform measures by unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation
from . import joins


def intervals(spikes: DataFrame, by: str, ts: str, amp: str | None = None) -> DataFrame:
    """isi: the time since the unit's spike before, null for its first; prior: that spike's amplitude."""
    w = Window.partitionBy(by).orderBy(ts)
    rows = spikes.withColumn("isi", F.col(ts) - F.lag(ts).over(w))
    return rows.withColumn("prior", F.lag(amp).over(w)) if amp else rows


def violations(rows: DataFrame, by: str, refractory: float) -> DataFrame:
    """isi_violations: per cent of the intervals below the refractory period; rpv: per cent of the spikes."""
    short = F.when(F.col("isi") < refractory, 1.0).otherwise(0.0)
    return rows.groupBy(by).agg((100 * F.avg(F.when(F.col("isi").isNotNull(), short))).alias("isi_violations"), (100 * F.sum(short) / F.count(F.lit(1))).alias("rpv"))


def complex_index(rows: DataFrame, by: str, amp: str, low: float, high: float) -> DataFrame:
    """csi: per cent of all intervals within low to high whose second spike is smaller."""
    hit = (F.col("isi") >= low) & (F.col("isi") <= high) & (F.col(amp) < F.col("prior"))
    return rows.filter("isi IS NOT NULL").groupBy(by).agg((100 * F.avg(F.when(hit, 1.0).otherwise(0.0))).alias("csi"))


def interval_histogram(rows: DataFrame, by: str, width: float, limit: float) -> DataFrame:
    """Counts of intervals in bins of `width` up to the limit, which the last bin includes."""
    place = F.least(F.floor(F.col("isi") / width), F.lit(int(limit / width) - 1)).cast("long")
    return rows.filter((F.col("isi") >= 0) & (F.col("isi") <= limit)).groupBy(by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def burst_power(rows: DataFrame, by: str, width: float) -> DataFrame:
    """Per cent of the intervals that are at most `width`."""
    return rows.filter("isi IS NOT NULL").groupBy(by).agg((100 * F.avg(F.when(F.col("isi") <= width, 1.0).otherwise(0.0))).alias("burst"))


def half_width(histogram: DataFrame, by: str, width: float, low: float, high: float) -> DataFrame:
    """peak (the largest count), at (its bin's middle), and low and high: where the counts cross half of it on each side.

    The histogram (bin, n) counts bins of `width` from `low`; bins up to `high` that it lacks count as 0. A crossing lies on
    the line from the first bin of at most half the peak to its neighbour; without such a bin it is the range's end.
    """
    bins = round((high - low) / width)
    grid = histogram.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    rows = grid.join(histogram.select(by, "bin", "n"), [by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order, group = Window.partitionBy(by).orderBy("bin"), Window.partitionBy(by)
    rows = rows.withColumns({"__a": F.lag("n").over(order), "__b": F.lead("n").over(order), "peak": F.max("n").over(group), "__at": F.max_by("bin", F.struct("n", -F.col("bin"))).over(group)})
    x, half, few = (F.col("bin") + 0.5) * width + low, F.col("peak") / 2, F.col("n") <= F.col("peak") / 2
    left = F.max_by(x + F.try_divide(half - F.col("n"), F.col("__b") - F.col("n")) * width, F.when((F.col("bin") < F.col("__at")) & few, F.col("bin")))
    right = F.min_by(x - width + F.try_divide(half - F.col("__a"), F.col("n") - F.col("__a")) * width, F.when((F.col("bin") > F.col("__at")) & few, F.col("bin")))
    return rows.groupBy(by).agg(
        F.first("peak").alias("peak"), ((F.first("__at") + 0.5) * width + low).alias("at"),
        F.greatest(F.lit(low), F.coalesce(left, F.lit(low))).alias("low"), F.least(F.lit(high), F.coalesce(right, F.lit(high))).alias("high"),
    )


def autocorrelogram(pairs: DataFrame, by: str, width: float) -> DataFrame:
    """Counts of lags in bins of `width`, towards 0 from both sides."""
    return pairs.groupBy(by, (F.col("lag") / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cross_histogram(spikes: DataFrame, by: str, ts: str, unit: float, reach: int, width: int) -> DataFrame:
    """lag and n: the cross-correlation of a train's counts in bins of one unit with itself, up to `reach` units, without
    the centre, summed in runs of `width` lags from -reach on; a run is named by where it begins, those after the centre
    one run later. Runs without a pair are left out."""
    counts = spikes.groupBy(by, F.floor(F.col(ts) / unit).alias("t")).agg(F.count(F.lit(1)).alias("c"))
    pairs = joins.band_pairs(counts, by, "t", reach, ["c"])
    place = F.floor((F.when(F.col("lag") < 0, F.col("lag") + reach).otherwise(F.col("lag") + reach - 1)) / width)
    lag = -reach + width * F.when(place < reach // width, place).otherwise(place + 1)
    return pairs.groupBy(by, lag.cast("long").alias("lag")).agg(F.sum(F.col("c_a") * F.col("c_b")).alias("n"))


def theta_modulation(spikes: DataFrame, by: str, ts: str, window: float, width: float, seconds: float, low: float = 3.0, high: float = 7.0, times: float = 2.0, least: int = 10) -> DataFrame:
    """n, modulated, peak_freq and best: whether the autocorrelogram's power from low to high Hz exceeds `times` the mean of its half
    spectrum, 0 included, where it is largest, and how large.

    Lags within `window` are counted in bins of `width`, which last `seconds`, from the earliest on; the counts are an array
    and their spectrum a sum over it. Units with fewer than `least` spikes aren't modulated and have no frequency.
    """
    bins = int(round(2 * window / width))
    half, step = bins // 2, 1 / (seconds * bins)
    band = [k for k in range(half) if low <= k * step <= high]
    place = F.least(F.floor((F.col("lag") + window) / width), F.lit(bins - 1)).cast("int")
    counts = joins.band_pairs(spikes, by, ts, window, []).groupBy(by, place.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    packed = counts.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"))
    rows = spikes.groupBy(by).agg(F.count(F.lit(1)).alias("n")).join(packed, by, "left")
    series = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)).cast("double"))
    rows = rows.select(by, "n", series.alias("c"))

    def power(k: Column) -> Column:
        part = lambda f: F.aggregate(F.transform("c", lambda c, b: c * f(2 * F.pi() * (k * b % bins) / bins)), F.lit(0.0), lambda a, x: a + x)
        return part(F.cos) ** 2 + part(F.sin) ** 2

    rows = rows.select(by, "n", F.transform(F.sequence(F.lit(0), F.lit(half - 1)), power).alias("p"))
    mean = F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / half
    best = F.array_max(F.transform(F.array(*map(F.lit, band)), lambda k: F.struct(F.get("p", k).alias("p"), (-k).alias("k")))) if band else F.lit(None).cast("struct<p:double,k:int>")
    rows = rows.select(by, "n", mean.alias("mean"), best.alias("best"))
    enough = F.col("n") >= least
    return rows.select(by, "n", (enough & F.coalesce(F.col("best.p") > times * F.col("mean"), F.lit(False))).alias("modulated"), F.when(enough, F.round(-F.col("best.k") * step, 2)).alias("peak_freq"), F.when(enough, F.col("best.p")).alias("best"))


def samples(waves: DataFrame, keys: list[str], wave: str) -> DataFrame:
    """A row for each sample: i and v."""
    return waves.select(*keys, F.posexplode(wave).alias("i", "v"))


def mean_wave(waves: DataFrame, by: list[str], wave: str) -> DataFrame:
    """mean and sd (n - 1) of each sample, and d, the mean's step from the sample before."""
    rows = samples(waves, by, wave).groupBy(*by, "i").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    return rows.withColumn("d", F.col("mean") - F.lag("mean").over(Window.partitionBy(*by).orderBy("i")))


def wave_shape(means: DataFrame, by: list[str]) -> DataFrame:
    """peak, its place, the trough at or after it, its place, their ratio and the width between them."""
    group = Window.partitionBy(*by)
    rows = means.withColumn("__at", F.max_by("i", F.struct("mean", -F.col("i"))).over(group))
    out = rows.groupBy(*by).agg(
        F.max("mean").alias("peak"), F.first("__at").alias("peak_at"),
        F.min(F.when(F.col("i") >= F.col("__at"), F.col("mean"))).alias("trough"),
        F.min_by("i", F.when(F.col("i") >= F.col("__at"), F.struct("mean", "i"))).alias("trough_at"),
    )
    return out.withColumns({"ratio": F.col("peak") / F.abs("trough"), "width": F.col("trough_at") - F.col("peak_at")})


def array_peaks(wave: Column, least: float) -> Column:
    """An array of (height, before, prominence, width): the local maxima of an array (the first of equal values; ends are
    none) of at least that prominence; before is less the place, so that the largest struct is the highest, first peak.

    A width is the distance between the points at which the lines between values cross half of the prominence.
    """
    n = F.size(wave)
    rises = lambda i: F.get(wave, i) > F.get(wave, i - 1)
    falls = lambda i: F.coalesce(F.get(F.filter(F.slice(wave, i + 2, n), lambda x: x != F.get(wave, i)), F.lit(0)) < F.get(wave, i), F.lit(False))
    tops = F.filter(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: (n > 2) & rises(i) & falls(i))

    def base(values: Column, h: Column) -> Column:
        start = F.struct(h.alias("low"), F.lit(True).alias("open"))
        step = lambda s, x: F.when(s["open"] & (x <= h), F.struct(F.least(s["low"], x).alias("low"), F.lit(True).alias("open"))).otherwise(F.struct(s["low"].alias("low"), F.lit(False).alias("open")))
        return F.aggregate(values, start, step)["low"]

    def crossing(values: Column, h: Column, level: Column) -> Column:
        """Steps from the peak to where the values, going away from it, reach the level."""
        k = F.get(F.filter(F.transform(values, lambda x, j: F.when(x <= level, j)), lambda j: j.isNotNull()), F.lit(0))
        prior = F.when(k == 0, h).otherwise(F.get(values, k - 1))
        return k + (prior - level) / (prior - F.get(values, k))

    def measured(i: Column) -> Column:
        h, left, right = F.get(wave, i), F.reverse(F.slice(wave, F.lit(1), i)), F.slice(wave, i + 2, n)
        prominence = h - F.greatest(base(left, h), base(right, h))
        level = h - prominence / 2
        return F.struct(h.alias("height"), (-i).alias("before"), prominence.alias("prominence"), (crossing(left, h, level) + crossing(right, h, level)).alias("width"))

    return F.filter(F.transform(tops, measured), lambda p: p["prominence"] >= least)


def wave_properties(waves: DataFrame, by: list[str], channel: str, wave: str, step: float, duration: float, least_peak: float = 15.0, least_trough: float = 5.0, ahead: int = 10) -> DataFrame:
    """by, channel, peak, trough, ratio, peak_to_trough, width, ahp_width, end_slope, amplitude_rsd and rate of each unit.

    waves: a row for each spike and channel, `step` apart. Everything is of the channel with the highest mean wave, the first of a
    tie. trough is the lowest value from the peak on, peak_to_trough the places to it, the peak's own included, times step.
    width and ahp_width are those of the highest peak, and of the deepest trough after the largest value, at half prominence;
    end_slope the change from the first such trough over `ahead` places, for nine steps' time. What isn't there (a flat tail,
    a tail that is too short) is null. amplitude_rsd: the deviation (n - 1) of the spikes' maxima over their mean; rate: spikes
    for each unit of `duration`.
    """
    size = waves.groupBy(*by, channel).agg(F.count(F.lit(1)).alias("n"), (F.try_divide(F.stddev_samp(F.array_max(wave)), F.avg(F.array_max(wave)))).alias("amplitude_rsd"))
    means = samples(waves, [*by, channel], wave).groupBy(*by, channel, "i").agg(F.avg("v").alias("m"))
    means = means.groupBy(*by, channel).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x.m).alias("shape"))
    order = Window.partitionBy(*by).orderBy(F.desc(F.array_max("shape")), channel)
    rows = size.join(means, [*by, channel]).withColumn("__rank", F.row_number().over(order)).filter("__rank = 1")
    at = F.array_position("shape", F.array_max("shape")).cast("int")
    rows = rows.withColumn("after", F.slice("shape", at, F.size("shape")))
    rows = rows.withColumns({"tops": array_peaks(F.col("shape"), least_peak), "dips": array_peaks(F.transform("after", lambda x: -x), least_trough)})
    first = F.array_min(F.transform("dips", lambda p: -p["before"]))
    low = F.array_min("after")
    return rows.select(
        *by, channel, F.array_max("shape").alias("peak"), low.alias("trough"), F.try_divide(F.array_max("shape"), low).alias("ratio"),
        (F.array_position("after", low) * step).alias("peak_to_trough"), (F.array_max("tops")["width"] * step).alias("width"), (F.array_max("dips")["width"] * step).alias("ahp_width"),
        ((F.get("after", first + ahead) - F.get("after", first)) / (step / 9)).alias("end_slope"), "amplitude_rsd", (F.col("n") / duration).alias("rate"),
    )


def peak_to_peak(waves: DataFrame, by: list[str], wave: str) -> DataFrame:
    """p2p: the mean of the largest less the smallest sample."""
    return waves.groupBy(*by).agg(F.avg(F.array_max(wave) - F.array_min(wave)).alias("p2p"))


def noise_ratio(waves: DataFrame, by: list[str], wave: str, baseline: int = 4) -> DataFrame:
    """snr: mean p2p over twice the population deviation of the first samples; cv: the deviation of p2p over its mean."""
    p2p = F.array_max(wave) - F.array_min(wave)
    size = waves.groupBy(*by).agg(F.avg(p2p).alias("p2p"), F.stddev_pop(p2p).alias("__sd"))
    noise = samples(waves.withColumn(wave, F.slice(wave, 1, baseline)), by, wave).groupBy(*by).agg(F.stddev_pop("v").alias("__noise"))
    rows = size.join(noise, by)
    return rows.select(*by, (F.col("p2p") / (2 * F.col("__noise"))).alias("snr"), (F.col("__sd") / F.col("p2p")).alias("cv"))


def duration(waves: DataFrame, wave: str, baseline: int = 5, times: float = 2.0) -> DataFrame:
    """peak and trough (places of the extremes), onset (the last sample in the baseline's band up to the first of them) and
    offset (the first one from the last of them on); without such a sample the wave's first and last.

    The band is the mean of the first samples, give or take `times` their deviation: the median one over 0.6745, else the
    standard one, else the smallest number.
    """
    middle = lambda xs: (F.get(F.array_sort(xs), F.lit((baseline - 1) // 2)) + F.get(F.array_sort(xs), F.lit(baseline // 2))) / 2
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / baseline
    rows = waves.withColumns({"__base": F.slice(wave, 1, baseline), "peak": F.array_position(wave, F.array_max(wave)).cast("int") - 1, "trough": F.array_position(wave, F.array_min(wave)).cast("int") - 1})
    rows = rows.withColumns({"__mean": mean(F.col("__base")), "__mid": middle(F.col("__base"))})
    rows = rows.withColumns({"__mad": middle(F.transform("__base", lambda x: F.abs(x - F.col("__mid")))), "__sd": F.sqrt(mean(F.transform("__base", lambda x: (x - F.col("__mean")) ** 2)))})
    sigma = F.when(F.col("__mad") > 0, F.col("__mad") / 0.6745).when(F.col("__sd") > 0, F.col("__sd")).otherwise(2.220446049250313e-16)
    quiet = F.filter(F.transform(wave, lambda v, i: F.when(F.abs(v - F.col("__mean")) < times * sigma, i)), lambda i: i.isNotNull())
    rows = rows.withColumn("__quiet", quiet)
    onset = F.array_max(F.filter("__quiet", lambda i: i <= F.least("peak", "trough")))
    offset = F.array_min(F.filter("__quiet", lambda i: i >= F.greatest("peak", "trough")))
    rows = rows.withColumns({"onset": F.coalesce(onset, F.lit(0)), "offset": F.coalesce(offset, F.size(wave) - 1)})
    return rows.drop("__base", "__mean", "__mid", "__mad", "__sd", "__quiet")


def robust_noise(waves: DataFrame, by: list[str], wave: str, baseline: int = 5) -> DataFrame:
    """sigma: the median absolute deviation of the first samples over 0.6745."""
    rows = samples(waves.withColumn(wave, F.slice(wave, 1, baseline)), by, wave)
    rows = rows.join(rows.groupBy(*by).agg(F.percentile("v", F.lit(0.5)).alias("__m")), by)
    return rows.groupBy(*by).agg((F.percentile(F.abs(F.col("v") - F.col("__m")), F.lit(0.5)) / 0.6745).alias("sigma"))


def best_channel(means: DataFrame, by: list[str], channel: str, value: Column) -> DataFrame:
    """The channel with the largest value of its mean wave, the first of a tie."""
    return means.groupBy(*by).agg(F.max_by(channel, F.struct(value, -F.col(channel))).alias("channel"))


def template_correlation(waves: DataFrame, by: list[str], key: str, wave: str) -> DataFrame:
    """The mean of each wave's correlation with its group's mean wave, undefined ones left out."""
    rows = samples(waves, [*by, key], wave)
    rows = rows.join(rows.groupBy(*by, "i").agg(F.avg("v").alias("__m")), [*by, "i"])
    each = rows.groupBy(*by, key).agg(correlation("v", "__m").alias("r"))
    return each.groupBy(*by).agg(F.avg("r").alias("template_r"))


def snr_label(snr: Column) -> Column:
    return F.when(snr < 1.5, "poor").when(snr < 2.5, "fair").when(snr <= 4.0, "good").otherwise("excellent")


def isi_label(per_cent: Column) -> Column:
    return F.when(per_cent < 1, "clean").when(per_cent < 5, "acceptable").otherwise("contaminated")


def single_unit(rpv: Column, snr: Column, cv: Column) -> Column:
    return (rpv < 1) & (snr >= 3) & (cv <= 0.5)


def complex_cell(n: Column, single: Column, csi: Column) -> Column:
    return F.when((n >= 50) & single, csi > 5).otherwise(F.lit(False))


def place_cell(n: Column, peak: Column, sir: Column, sparsity: Column, significant: Column) -> Column:
    """Null if any input is."""
    known = n.isNotNull() & peak.isNotNull() & sir.isNotNull() & sparsity.isNotNull() & significant.isNotNull()
    return F.when(known, (n > 50) & (peak > 1) & (peak < 15) & (sir > 0.5) & (sparsity < 0.9) & significant)
