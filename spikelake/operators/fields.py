"""Field-potential epochs and spectra: rejection rules, averages and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation, student_p

MAD_SCALE = 0.6745


def numbered(trace: DataFrame, by: str, i: str, n: int) -> DataFrame:
    """epoch of each sample, n samples each; the incomplete last one is dropped."""
    size = F.count(F.lit(1)).over(Window.partitionBy(by))
    rows = trace.withColumns({"epoch": F.floor(F.col(i) / n), "__whole": F.floor(size / n)})
    return rows.filter(F.col("epoch") < F.col("__whole")).drop("__whole")


def robust_z(rows: DataFrame, by: list[str], value: str, reference: Column | None = None, name: str = "z") -> DataFrame:
    """0.6745 (x - median) / MAD, both over the reference rows; a MAD of 0 counts as 1e-20."""
    own = F.when(reference, F.col(value)) if reference is not None else F.col(value)
    group = Window.partitionBy(*by)
    rows = rows.withColumn("__m", F.percentile(own, F.lit(0.5)).over(group)).withColumn("__d", F.abs(own - F.col("__m")))
    mad = F.percentile("__d", F.lit(0.5)).over(group)
    rows = rows.withColumn("__mad", F.when(mad == 0, 1e-20).otherwise(mad))
    return rows.withColumn(name, MAD_SCALE * (F.col(value) - F.col("__m")) / F.col("__mad")).drop("__m", "__d", "__mad")


def noisy(rows: DataFrame, by: list[str], value: str, times: float = 5.0) -> DataFrame:
    """noisy: above median + times * 1.4826 * MAD, or not above 0."""
    group = Window.partitionBy(*by)
    rows = rows.withColumn("__m", F.percentile(value, F.lit(0.5)).over(group))
    rows = rows.withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    limit = F.col("__m") + times * 1.4826 * F.percentile("__d", F.lit(0.5)).over(group)
    return rows.withColumn("noisy", (F.col(value) > limit) | (F.col(value) <= 0)).drop("__m", "__d")


def kept_epochs(rows: DataFrame, by: list[str], speed: str, delta: str, theta: str, p2p: str, slowest: float | None, z: float = 5.0) -> DataFrame:
    """Epochs that are fast enough, have delta at most theta, and whose p2p and delta are no outliers among those left.

    Without a speed limit, a key of which nothing is left keeps all its epochs.
    """
    passed = (F.col(speed) > slowest) & (F.col(delta) <= F.col(theta)) if slowest is not None else F.col(delta) <= F.col(theta)
    rows = rows.withColumn("__ok", passed)
    for c in (p2p, delta):
        rows = robust_z(rows, by, c, F.col("__ok"), f"__z_{c}")
    rows = rows.withColumn("keep", F.col("__ok") & (F.col(f"__z_{p2p}") <= z) & (F.col(f"__z_{delta}") <= z))
    if slowest is None:
        rows = rows.withColumn("keep", F.col("keep") | ~F.max("keep").over(Window.partitionBy(*by)))
    return rows.filter("keep").drop("__ok", "keep", *(f"__z_{c}" for c in (p2p, delta)))


def both_mad(rows: DataFrame, by: list[str], columns: list[str], times: float = 5.0) -> DataFrame:
    """Rows at or below median + times * MAD / 0.6745 of each column."""
    group, ok = Window.partitionBy(*by), F.lit(True)
    for c in columns:
        rows = rows.withColumn(f"__m_{c}", F.percentile(c, F.lit(0.5)).over(group))
        rows = rows.withColumn(f"__d_{c}", F.abs(F.col(c) - F.col(f"__m_{c}")))
        rows = rows.withColumn(f"__l_{c}", F.col(f"__m_{c}") + times * F.percentile(f"__d_{c}", F.lit(0.5)).over(group) / MAD_SCALE)
        ok = ok & (F.col(c) <= F.col(f"__l_{c}"))
    return rows.filter(ok).drop(*(f"__{x}_{c}" for x in "mdl" for c in columns))


def mean_sem(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean and sem (population deviation over the root of the count)."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("sem"))


def band_power(rows: DataFrame, keys: list[str], freq: str, power: str, low: float, high: float, df: float) -> DataFrame:
    """summed: the sum times df; trapezoid: over the frequencies; mean_log: of log10."""
    rows = rows.filter(F.col(freq).between(low, high))
    w = Window.partitionBy(*keys).orderBy(freq)
    area = (F.col(power) + F.lag(power).over(w)) / 2 * (F.col(freq) - F.lag(freq).over(w))
    rows = rows.withColumn("__area", area)
    return rows.groupBy(*keys).agg((F.sum(power) * df).alias("summed"), F.coalesce(F.sum("__area"), F.lit(0.0)).alias("trapezoid"), F.avg(F.log10(power)).alias("mean_log"))


def relative(rows: DataFrame, keys: list[str], freq: str, power: str, low: float, high: float, df: float) -> DataFrame:
    """relative: power over the power of the band."""
    band = F.sum(F.when(F.col(freq).between(low, high), F.col(power)).otherwise(0.0)).over(Window.partitionBy(*keys))
    return rows.withColumn("relative", F.col(power) / (band * df))


def unity(rows: DataFrame, by: list[str], value: str, subset: Column | None = None, sd: float | None = None) -> DataFrame:
    """nss: less the mean, over the population deviation, of the subset (or all); a deviation of 0 counts as 1.

    The sums are made in parts, and a row for each key is joined back: no task takes all rows of a key.
    """
    own = F.when(subset, F.col(value)) if subset is not None else F.col(value)
    stats = rows.groupBy(*[F.col(c).alias(f"__of_{c}") for c in by]).agg(F.avg(own).alias("__mean"), F.stddev_pop(own).alias("__sd"))
    deviation = F.lit(float(sd)) if sd is not None else F.col("__sd")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    rows = rows.join(stats, same).withColumn("nss", (F.col(value) - F.col("__mean")) / F.when(deviation == 0, 1.0).otherwise(deviation))
    return rows.drop("__mean", "__sd", *(f"__of_{c}" for c in by))


def amplitude_gain(rows: DataFrame, keys: list[str], value: str, share: float = 0.99, height: float = 0.42) -> DataFrame:
    """scale, the share's quantile of sizes, and gain, which brings it to `height`; a scale of 0 has gain 1."""
    found = rows.groupBy(*keys).agg(F.percentile(F.abs(value), F.lit(share)).alias("scale"))
    return found.withColumn("gain", F.when(F.col("scale") > 0, height / F.col("scale")).otherwise(1.0))


def circular(rows: DataFrame, keys: list[str], angle: str) -> DataFrame:
    """The mean direction, resultant length and count of angles in radians."""
    c, s = F.sum(F.cos(angle)), F.sum(F.sin(angle))
    return rows.groupBy(*keys).agg(F.atan2(s, c).alias("direction"), (F.hypot(c, s) / F.count(angle)).alias("r"), F.count(angle).alias("n"))


def spectrum(trace: DataFrame, by: list[str], i: str, value: str, n: int, bins: int) -> DataFrame:
    """Squared length of the discrete Fourier transform of n samples (i from 0) at the first bins, as sums of products."""
    k = F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    rows = trace.select(*by, i, value, k.alias("k"))
    turn = 2 * 3.141592653589793 * F.col(i) * F.col("k") / n
    return rows.groupBy(*by, "k").agg((F.sum(F.col(value) * F.cos(turn)) ** 2 + F.sum(F.col(value) * F.sin(turn)) ** 2).alias("power"))


def fit_line(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Ordinary least squares: slope, intercept, r, n and p, of a slope that isn't 0 (two-sided)."""
    fit = rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), correlation(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    return fit.withColumn("p", _correlation_p(F.col("r"), F.col("n")))


def _correlation_p(r: Column, n: Column) -> Column:
    rest = 1 - r * r
    return F.when(n >= 3, F.when(rest <= 0, 0.0).otherwise(student_p(r * F.sqrt(F.try_divide(n - 2, rest)), n - 2)))


def fit_weighted(rows: DataFrame, keys: list[str], x: str, y: str, weight: str) -> DataFrame:
    """Weighted least squares: slope, intercept, weighted correlation, and p of Wald's two-sided test of the slope."""
    w, a, b = F.col(weight), F.col(x), F.col(y)
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * a).alias("x"), F.sum(w * b).alias("y"), F.sum(w * a * a).alias("xx"), F.sum(w * a * b).alias("xy"), F.sum(w * b * b).alias("yy"))
    xx, xy, yy = F.col("w") * F.col("xx") - F.col("x") ** 2, F.col("w") * F.col("xy") - F.col("x") * F.col("y"), F.col("w") * F.col("yy") - F.col("y") ** 2
    slope, r = F.try_divide(xy, xx), F.try_divide(xy, F.sqrt(F.greatest(F.lit(0.0), xx * yy)))
    # slope / sqrt(weighted residuals / (n - 2) / sxx) is r sqrt((n - 2) / (1 - r ** 2)).
    return sums.select(*keys, slope.alias("slope"), ((F.col("y") - slope * F.col("x")) / F.col("w")).alias("intercept"), r.alias("r"), _correlation_p(r, F.col("n")).alias("p"))


def low_quality(fits: DataFrame, r_squared: str = "r_squared", error: str = "error", least: float = 0.98, most: float = 0.4) -> DataFrame:
    """Fits with too small an r squared or too large an error."""
    return fits.filter((F.col(r_squared) < least) | (F.col(error) > most))


def strongest_peaks(peaks: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]]) -> DataFrame:
    """For each key and band cf, pw and bw of the strongest fitted peak (cf, pw, bw) with its centre in the band, the lower of
    a tie, and low and high: cf less and plus half of bw, its full width. Bands without a peak give no row."""
    spans = F.array(*[F.struct(F.lit(k).alias("band"), F.lit(float(a)).alias("from"), F.lit(float(b)).alias("to")) for k, (a, b) in bands.items()])
    rows = peaks.select("*", F.explode(spans).alias("s")).filter(F.col("cf").between(F.col("s.from"), F.col("s.to")))
    best = rows.groupBy(*keys, F.col("s.band").alias("band")).agg(F.max_by(F.struct("cf", "pw", "bw"), F.struct("pw", -F.col("cf"))).alias("p"))
    return best.select(*keys, "band", "p.*", (F.col("p.cf") - F.col("p.bw") / 2).alias("low"), (F.col("p.cf") + F.col("p.bw") / 2).alias("high"))


def calmest(epochs: DataFrame, by: str, epoch: str, p2p: str, low: str, gap: int = 5) -> DataFrame:
    """The two calmest epochs of a key, at least `gap` apart, or else simply the two calmest: those with the least p2p and
    power of low frequencies, each over its median. rank is 1 or 2; ties go to the earlier epoch."""
    group = Window.partitionBy(by)
    over = lambda c: F.col(c) / F.percentile(c, F.lit(0.5)).over(group)
    rows = epochs.withColumn("noise", over(p2p) + over(low))
    rows = rows.withColumn("__first", F.min_by(epoch, F.struct("noise", epoch)).over(group))
    far = (F.abs(F.col(epoch) - F.col("__first")) >= gap).cast("int")
    order = Window.partitionBy(by).orderBy((F.col(epoch) != F.col("__first")).cast("int"), F.desc(far), "noise", epoch)
    return rows.withColumn("rank", F.row_number().over(order)).filter("rank <= 2").select(by, epoch, "noise", "rank")


def best_windows(epochs: DataFrame, by: str, epoch: str, p2p: str, limit: float, parts: int = 10) -> DataFrame:
    """For each part of a key's epochs the one with the least p2p, clean ones (p2p at most the limit) first."""
    seg = F.floor(F.lit(float(parts)) * F.col(epoch) / (F.max(epoch).over(Window.partitionBy(by)) + 1))
    return epochs.withColumn("seg", seg).groupBy(by, "seg").agg(F.min_by(epoch, F.struct(F.col(p2p) > limit, p2p, epoch)).alias(epoch))


def interpolated(spectra: DataFrame, keys: list[str], freq: str, power: str, at: float, half: float, log_freq: bool = False) -> DataFrame:
    """Spectra with the powers within `half` of a frequency, ends included, on the line between the nearest frequencies
    outside: of the log of power over frequency, or over its log. Beyond the last frequency the nearest power holds."""
    group, inside = Window.partitionBy(*keys), F.abs(F.col(freq) - at) <= half
    f, p = F.col(freq), F.ln(F.greatest(F.col(power), F.lit(1e-30)))
    x = F.ln(f) if log_freq else f
    low = F.max_by(F.struct(x.alias("x"), p.alias("p")), F.when(~inside & (f < at), f)).over(group)
    high = F.min_by(F.struct(x.alias("x"), p.alias("p")), F.when(~inside & (f > at), f)).over(group)
    rows = spectra.withColumns({"__low": low, "__high": high})
    line = F.col("__low.p") + (F.col("__high.p") - F.col("__low.p")) * F.try_divide(x - F.col("__low.x"), F.col("__high.x") - F.col("__low.x"))
    new = F.exp(F.coalesce(line, F.col("__low.p"), F.col("__high.p")))
    return rows.withColumn(power, F.when(inside, F.coalesce(new, F.col(power))).otherwise(F.col(power))).drop("__low", "__high")


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The correlation of average ranks."""
    for c in (x, y):
        first = F.rank().over(Window.partitionBy(*keys).orderBy(c))
        rows = rows.withColumn(f"__r_{c}", first + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2)
    return rows.groupBy(*keys).agg(correlation(f"__r_{x}", f"__r_{y}").alias("rho"))


def phases(peaks: DataFrame, by: str, ts: str, reference: object, width: float) -> DataFrame:
    """The peaks of all other keys with `phase`, how far each lies between two peaks of the reference, in radians.

    The spans between reference peaks are put into every bucket of `width` that they meet, and peaks look in their own: no
    task takes all peaks of a recording. Peaks before the first or after the last reference peak have no phase.
    """
    spans = peaks.filter(F.col(by) == F.lit(reference)).select(F.col(ts).alias("__from"))
    spans = spans.withColumn("__to", F.lead("__from").over(Window.orderBy("__from"))).dropna()  # one channel's peaks
    bucket = lambda c: F.floor(F.col(c) / width)
    spans = spans.withColumn("__bucket", F.explode(F.sequence(bucket("__from"), bucket("__to"))))
    rows = peaks.filter(F.col(by) != F.lit(reference)).withColumn("__bucket", bucket(ts)).join(spans, "__bucket")
    rows = rows.filter((F.col(ts) >= F.col("__from")) & (F.col(ts) < F.col("__to")))
    phase = 2 * F.pi() * (F.col(ts) - F.col("__from")) / (F.col("__to") - F.col("__from"))
    return rows.withColumn("phase", phase).drop("__from", "__to", "__bucket")
