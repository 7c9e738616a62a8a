"""Queries of the epoch, spectrum and statistics operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation
from ..operators import extrema, fields, recordings
from .proxies import HOUR, SPECTRA, TRACE, TRACK, query, read, rounded, spectra, trace, track

EPOCHS = f"{TRACE}, n AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM trace), e AS (SELECT channel, CAST(i // 8 AS BIGINT) AS epoch, i, v FROM n WHERE i // 8 < n // 8), p AS (SELECT channel, epoch, max(v) - min(v) AS p2p, avg(v) AS delta, median(v) + 4 AS theta, max(v) AS speed FROM e GROUP BY ALL)"


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fields.numbered(trace(spark, sf_dir), "channel", "i", 8)
    return rows.groupBy("channel", "epoch").agg((F.max("v") - F.min("v")).alias("p2p"), F.avg("v").alias("delta"), (F.percentile("v", F.lit(0.5)) + 4).alias("theta"), F.max("v").alias("speed"))


@query("w22_epochs", f"WITH {EPOCHS} SELECT channel, epoch, round(p2p, 6) AS p2p, round(delta, 6) AS delta FROM p")
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_epochs(spark, sf_dir).select("channel", "epoch", "p2p", "delta"), "p2p", "delta")


@query("a13_robust_z", f"WITH {EPOCHS}, m AS (SELECT *, median(p2p) OVER (PARTITION BY channel) AS m FROM p), d AS (SELECT *, median(abs(p2p - m)) OVER (PARTITION BY channel) AS mad FROM m) SELECT channel, epoch, round(0.6745::DOUBLE * (p2p - m) / CASE WHEN mad = 0 THEN 1e-20 ELSE mad END, 4) AS z FROM d")
def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.robust_z(_epochs(spark, sf_dir), ["channel"], "p2p").select("channel", "epoch", "z"), "z", digits=4)


KEPT = f"""{EPOCHS}, o AS (SELECT *, %s AS ok FROM p), m AS (SELECT *, median(CASE WHEN ok THEN p2p END) OVER c AS mp, median(CASE WHEN ok THEN delta END) OVER c AS md FROM o WINDOW c AS (PARTITION BY channel)),
    d AS (SELECT *, median(abs(CASE WHEN ok THEN p2p END - mp)) OVER c AS dp, median(abs(CASE WHEN ok THEN delta END - md)) OVER c AS dd FROM m WINDOW c AS (PARTITION BY channel)),
    z AS (SELECT *, coalesce(ok AND 0.6745 * (p2p - mp) / CASE WHEN dp = 0 THEN 1e-20 ELSE dp END <= 2 AND 0.6745 * (delta - md) / CASE WHEN dd = 0 THEN 1e-20 ELSE dd END <= 2, false) AS keep FROM d)"""


@query("n8_kept_epochs_moving", f"WITH {KEPT % 'speed > 40 AND delta <= theta'} SELECT channel, epoch FROM z WHERE keep")
def kept_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.kept_epochs(_epochs(spark, sf_dir), ["channel"], "speed", "delta", "theta", "p2p", 40.0, 2.0).select("channel", "epoch")


@query("n8_kept_epochs", f"WITH {KEPT % 'delta <= theta'} SELECT channel, epoch FROM z QUALIFY keep OR NOT bool_or(keep) OVER (PARTITION BY channel)")
def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.kept_epochs(_epochs(spark, sf_dir), ["channel"], "speed", "delta", "theta", "p2p", None, 2.0).select("channel", "epoch")


@query("n9_both_mad", f"WITH {EPOCHS}, m AS (SELECT *, median(p2p) OVER c AS mp, median(delta) OVER c AS md FROM p WINDOW c AS (PARTITION BY channel)), d AS (SELECT *, mp + median(abs(p2p - mp)) OVER c / 0.6745::DOUBLE AS lp, md + median(abs(delta - md)) OVER c / 0.6745::DOUBLE AS ld FROM m WINDOW c AS (PARTITION BY channel)) SELECT channel, epoch FROM d WHERE p2p <= lp AND delta <= ld")
def both_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.both_mad(_epochs(spark, sf_dir), ["channel"], ["p2p", "delta"], 1.0).select("channel", "epoch")


@query("p21_noisy_bins", f"WITH {EPOCHS}, m AS (SELECT *, median(p2p) OVER c AS m FROM p WINDOW c AS (PARTITION BY channel)), d AS (SELECT *, m + 1 * 1.4826::DOUBLE * median(abs(p2p - m)) OVER (PARTITION BY channel) AS l FROM m) SELECT channel, epoch, p2p > l OR p2p <= 0 AS noisy FROM d")
def noisy_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.noisy(_epochs(spark, sf_dir), ["channel"], "p2p", 1.0).select("channel", "epoch", "noisy")


#: Each whole bin of 8 samples at 8 Hz: deviation, and the area under its density from 1 to 3 Hz.
SCAN = f"""{TRACE}, n AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM trace), e AS (SELECT channel, CAST(i // 8 AS BIGINT) AS bin, i % 8 AS j, v FROM n WHERE i // 8 < n // 8),
    c AS (SELECT *, v - avg(v) OVER (PARTITION BY channel, bin) AS d, 0.5 - 0.5 * cos(2 * pi() * j / 8) AS w FROM e),
    f AS (SELECT channel, bin, k, 2 * (sum(w * d * cos(2 * pi() * j * k / 8)) ^ 2 + sum(w * d * sin(2 * pi() * j * k / 8)) ^ 2) / (8 * sum(w * w)) AS p FROM c, (SELECT unnest([1, 2, 3]) AS k) GROUP BY channel, bin, k),
    scan AS (SELECT s.channel, s.bin, s.sd, a.power FROM (SELECT channel, bin, stddev_pop(v) AS sd FROM e GROUP BY ALL) s JOIN (SELECT channel, bin, sum(CASE WHEN k = 2 THEN p ELSE p / 2 END) AS power FROM f GROUP BY ALL) a ON s.channel = a.channel AND s.bin = a.bin),
    metric AS (SELECT bin, median(sd) AS metric, count(*) AS channels FROM scan GROUP BY bin), mid AS (SELECT *, median(metric) OVER () AS m FROM metric),
    noise AS (SELECT bin, metric, channels, metric > m + 1.0::DOUBLE * 1.4826::DOUBLE * median(abs(metric - m)) OVER () OR metric <= 0 AS noisy FROM mid)"""


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordings.scanned(trace(spark, sf_dir), "channel", "i", "v", 8.0, 1.0, (1.0, 3.0), 4)


@query("n33_bin_scan", f"WITH {SCAN} SELECT channel, bin, round(sd, 6) AS sd, round(power, 5) AS power FROM scan")
def bin_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(_scan(spark, sf_dir), "sd"), "power", digits=5)


@query("n33_noisy_bins", f"WITH {SCAN} SELECT bin, round(metric, 6) AS metric, channels, noisy FROM noise")
def scan_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recordings.bin_noise(_scan(spark, sf_dir), 1.0), "metric")


@query("n33_depth_power", f"WITH {SCAN} SELECT channel, round(10 * log10(avg(power) + 1e-12), 6) AS db FROM scan WHERE bin IN (SELECT bin FROM noise WHERE NOT noisy) GROUP BY channel")
def depth_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = _scan(spark, sf_dir)
    return rounded(recordings.depth_power(scan, recordings.bin_noise(scan, 1.0), "channel"), "db")


@query("n36_unity", f"WITH {TRACE} SELECT channel, i, round((v - avg(CASE WHEN i < 20 THEN v END) OVER c) / CASE WHEN stddev_pop(CASE WHEN i < 20 THEN v END) OVER c = 0 THEN 1 ELSE stddev_pop(CASE WHEN i < 20 THEN v END) OVER c END, 6) AS nss FROM trace WINDOW c AS (PARTITION BY channel)")
def unity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.unity(trace(spark, sf_dir), ["channel"], "v", F.col("i") < 20), "nss").select("channel", "i", "nss")


@query("n31_median_reference", f"WITH {TRACE} SELECT channel, i, round(v - median(v) OVER (PARTITION BY i), 6) AS v FROM trace")
def median_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(recordings.referenced(trace(spark, sf_dir), "channel", "i", "v"), "v")


@query(
    "n31_bad_channels",
    f"""WITH {TRACE}, x AS (SELECT channel % 8 AS c, i // 16 AS b, i % 16 AS j, sum(v) AS v FROM trace WHERE i < 32 GROUP BY ALL), d AS (SELECT *, v - avg(v) OVER (PARTITION BY c, b) AS d FROM x),
    near AS (SELECT a.c, a.b, a.j, a.d, median(o.d) AS m FROM d a JOIN d o ON a.b = o.b AND a.j = o.j AND a.c <> o.c AND abs(a.c - o.c) <= 2 GROUP BY ALL), alike AS (SELECT c, b, coalesce(corr(d, m), 0) AS r FROM near GROUP BY c, b),
    f AS (SELECT c, b, k, CASE WHEN k = 8 THEN 1 ELSE 2 END * (sum(w * d * cos(2 * pi() * j * k / 16)) ^ 2 + sum(w * d * sin(2 * pi() * j * k / 16)) ^ 2) / (16 * sum(w * w)) AS p FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / 16) AS w FROM d), (SELECT unnest([7, 8]) AS k) GROUP BY c, b, k),
    loud AS (SELECT c, b, avg(p) AS p FROM f GROUP BY c, b), q AS (SELECT s.c, median(s.r) AS similarity, median(l.p) AS loudness FROM alike s JOIN loud l ON s.c = l.c AND s.b = l.b GROUP BY s.c),
    v AS (SELECT *, median(similarity) OVER (ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around, median(loudness) OVER () AS middle FROM q)
    SELECT c AS channel, round(similarity, 5) AS similarity, round(loudness, 4) AS loudness, CASE WHEN around - similarity >= 0.25 THEN 'dead' WHEN loudness > 1.5 * middle THEN 'noisy' ELSE 'good' END AS verdict FROM v""",
)
def bad_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users modulo 8 as channels in depth, blocks of 16 samples at 16 Hz."""
    rows = trace(spark, sf_dir).filter("i < 32").groupBy((F.col("channel") % 8).alias("channel"), "i").agg(F.sum("v").alias("v"))
    channels = rows.select("channel").distinct().withColumn("depth", F.col("channel").cast("double"))
    quality = recordings.channel_quality(rows, channels, "channel", "i", "v", 16.0, around=2, length=16)
    found = recordings.judged_channels(quality, "channel", dead=0.25, times=1.5, around=2)
    return rounded(rounded(found, "similarity", digits=5), "loudness", digits=4).drop("depth")


@query("n4_detrended", f"WITH {TRACE}, l AS (SELECT channel, regr_slope(v, i) AS a, regr_intercept(v, i) AS b FROM trace GROUP BY channel) SELECT channel, i, round(v - a * i - b, 4) AS v FROM trace JOIN l USING (channel)")
def detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace(spark, sf_dir)
    line = fields.fit_line(rows, ["channel"], "i", "v").select("channel", "slope", "intercept")
    return rounded(rows.join(line, "channel").select("channel", "i", (F.col("v") - F.col("slope") * F.col("i") - F.col("intercept")).alias("v")), "v", digits=4)


@query(
    "n18_half_spectrum",
    f"""WITH {TRACE}, n AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM trace), e AS (SELECT channel, CAST(i // 16 AS BIGINT) AS epoch, i % 16 AS j, v FROM n WHERE i // 16 < n // 16),
    k AS (SELECT unnest(range(9)) AS k), s AS (SELECT channel, epoch, k, sum(v * cos(2 * pi() * j * k / 16)) ^ 2 + sum(v * sin(2 * pi() * j * k / 16)) ^ 2 AS power FROM e, k GROUP BY ALL)
    SELECT channel, epoch, round(avg(power), 5) AS mean, round(max(CASE WHEN k BETWEEN 2 AND 4 THEN power END), 5) AS band, max(CASE WHEN k BETWEEN 2 AND 4 THEN power END) > 2 * avg(power) AS modulated FROM s GROUP BY channel, epoch""",
)
def half_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fields.numbered(trace(spark, sf_dir), "channel", "i", 16).withColumn("j", F.col("i") % 16)
    rows = fields.spectrum(rows, ["channel", "epoch"], "j", "v", 16, 9)
    band = F.max(F.when(F.col("k").between(2, 4), F.col("power")))
    return rounded(rows.groupBy("channel", "epoch").agg(F.avg("power").alias("mean"), band.alias("band"), (band > 2 * F.avg("power")).alias("modulated")), "mean", "band", digits=5)


@query("a24_mean_sem", f"WITH {SPECTRA} SELECT freq, round(avg(power), 6) AS mean, round(stddev_pop(power) / sqrt(count(power)), 6) AS sem FROM spectra GROUP BY freq")
def mean_sem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.mean_sem(spectra(spark, sf_dir), ["freq"], "power"), "mean", "sem")


@query(
    "a35_band_power",
    f"WITH {SPECTRA}, b AS (SELECT *, (power + lag(power) OVER w) / 2 * (freq - lag(freq) OVER w) AS area FROM spectra WHERE freq BETWEEN 3 AND 7 WINDOW w AS (PARTITION BY file ORDER BY freq)) SELECT file, round(sum(power) * 0.5::DOUBLE, 6) AS summed, round(coalesce(sum(area), 0), 6) AS trapezoid, round(avg(log10(power)), 6) AS mean_log FROM b GROUP BY file",
)
def band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.band_power(spectra(spark, sf_dir), ["file"], "freq", "power", 3, 7, 0.5), "summed", "trapezoid", "mean_log")


@query("a36_relative_power", f"WITH {SPECTRA} SELECT file, freq, round(power / (sum(CASE WHEN freq BETWEEN 1 AND 10 THEN power ELSE 0 END) OVER (PARTITION BY file) * 0.5::DOUBLE), 9) AS relative FROM spectra")
def relative_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.relative(spectra(spark, sf_dir), ["file"], "freq", "power", 1, 10, 0.5), "relative", digits=9).select("file", "freq", "relative")


@query(
    "n10_mains_interpolated",
    f"WITH {SPECTRA}, g AS (SELECT file, max(ln(freq)) FILTER (WHERE freq < 6) AS f1, arg_max(ln(power), freq) FILTER (WHERE freq < 6) AS p1, min(ln(freq)) FILTER (WHERE freq > 8) AS f2, arg_min(ln(power), freq) FILTER (WHERE freq > 8) AS p2 FROM spectra GROUP BY file) SELECT file, freq, round(CASE WHEN abs(freq - 7) <= 1 THEN exp(coalesce(p1 + (p2 - p1) * (ln(freq) - f1) / (f2 - f1), p1, p2)) ELSE power END, 6) AS power FROM spectra JOIN g USING (file)",
)
def mains_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.interpolated(spectra(spark, sf_dir), ["file"], "freq", "power", 7.0, 1.0, log_freq=True), "power")


@query("a37_amplitude_gain", f"WITH {TRACE}, s AS (SELECT channel, quantile_cont(abs(v), 0.99) AS scale FROM trace GROUP BY channel) SELECT channel, round(scale, 6) AS scale, round(CASE WHEN scale > 0 THEN 0.42::DOUBLE / scale ELSE 1 END, 6) AS gain FROM s")
def amplitude_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.amplitude_gain(trace(spark, sf_dir), ["channel"], "v"), "scale", "gain")


@query("a25_circular_mean", f"WITH {TRACK}, a AS (SELECT unit, x / 80 * 2 * pi() AS a FROM track) SELECT unit, round(atan2(sum(sin(a)), sum(cos(a))), 5) AS direction, round(sqrt(sum(cos(a)) ^ 2 + sum(sin(a)) ^ 2) / count(a), 6) AS r, count(a) AS n FROM a GROUP BY unit")
def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).withColumn("a", F.col("x") / 80 * 2 * F.pi())
    return rounded(rounded(fields.circular(rows, ["unit"], "a"), "r"), "direction", digits=5)


def _p_sql(r: str, n: str) -> str:
    """Student's two-sided p of a correlation: sin is |r| and cos squared 1 - r^2; the series' factors are gamma functions."""
    series = lambda top, bottom, count: f"coalesce(list_sum([exp({top} - {bottom}) * (1 - {r} ^ 2) ^ j for j in range({count})]), 0)"
    odd = series("lgamma(j + 1.0::DOUBLE) + lgamma(1.5::DOUBLE)", "lgamma(j + 1.5::DOUBLE)", f"({n} - 3) // 2")
    even = series("lgamma(j + 0.5::DOUBLE)", "lgamma(0.5::DOUBLE) - lgamma(j + 1.0::DOUBLE)", f"({n} - 2) // 2")
    inside = f"CASE WHEN {n} % 2 = 1 THEN 2 / pi() * (asin(least(1, abs({r}))) + abs({r}) * sqrt(greatest(0, 1 - {r} ^ 2)) * {odd}) ELSE abs({r}) * {even} END"
    return f"CASE WHEN {n} >= 3 AND {r} IS NOT NULL THEN CASE WHEN 1 - {r} ^ 2 <= 0 THEN 0 ELSE greatest(0, 1 - {inside}) END END"


SPEED_BINS = f"{TRACK}, s AS (SELECT unit, floor(x / 5) AS b, avg(y) AS rate, CAST(count(*) AS DOUBLE) AS w FROM track WHERE x > 1 AND x < 79 GROUP BY ALL)"


def _speed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(spark, sf_dir).filter("x > 1 AND x < 79").groupBy("unit", F.floor(F.col("x") / 5).alias("b")).agg(F.avg("y").alias("rate"), F.count(F.lit(1)).cast("double").alias("w"))


@query("p11_a21_n27_speed_fit", f"WITH {SPEED_BINS}, q AS (SELECT unit, regr_slope(rate, b) AS slope, regr_intercept(rate, b) AS intercept, corr(b, rate) AS r, count(*) AS n FROM s GROUP BY unit HAVING count(*) >= 3) SELECT unit, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r, n, round(({_p_sql('r', 'n')})::DOUBLE, 6) AS p FROM q")
def speed_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.fit_line(_speed_bins(spark, sf_dir), ["unit"], "b", "rate").filter("n >= 3"), "slope", "intercept", "r", "p")


@query(
    "a22_n28_weighted_fit",
    f"WITH {SPEED_BINS}, q AS (SELECT unit, count(*) AS n, sum(w) AS w, sum(w * b) AS x, sum(w * rate) AS y, sum(w * b * b) AS xx, sum(w * b * rate) AS xy, sum(w * rate * rate) AS yy FROM s GROUP BY unit HAVING count(*) >= 3), z AS (SELECT unit, n, (w * xy - x * y) / (w * xx - x * x) AS slope, (y - (w * xy - x * y) / (w * xx - x * x) * x) / w AS intercept, (w * xy - x * y) / sqrt((w * xx - x * x) * (w * yy - y * y)) AS r FROM q) SELECT unit, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r, round(({_p_sql('r', 'n')})::DOUBLE, 6) AS p FROM z",
)
def weighted_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _speed_bins(spark, sf_dir)
    rows = rows.join(rows.groupBy("unit").count().filter("count >= 3").select("unit"), "unit", "left_semi")
    return rounded(fields.fit_weighted(rows, ["unit"], "b", "rate", "w"), "slope", "intercept", "r", "p")


@query("a23_spearman", f"WITH {SPEED_BINS}, k AS (SELECT unit, rank() OVER (PARTITION BY unit ORDER BY b) AS rx, rank() OVER (PARTITION BY unit ORDER BY rate) + (count(*) OVER (PARTITION BY unit, rate) - 1) / 2.0 AS ry FROM s) SELECT unit, round(corr(rx, ry), 6) AS rho FROM k GROUP BY unit HAVING count(*) >= 3")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _speed_bins(spark, sf_dir)
    rows = rows.join(rows.groupBy("unit").count().filter("count >= 3").select("unit"), "unit", "left_semi")
    return rounded(fields.spearman(rows, ["unit"], "b", "rate"), "rho")


@query("a29_describe", "SELECT l_returnflag, count(*) AS n, round(avg(l_tax), 6) AS mean, round(median(l_tax), 6) AS middle, round(stddev_samp(l_tax), 6) AS sd FROM lineitem GROUP BY l_returnflag")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_tax").alias("mean"), F.percentile("l_tax", F.lit(0.5)).alias("middle"), F.stddev_samp("l_tax").alias("sd"))
    return rounded(rows, "mean", "middle", "sd")


@query(
    "p19_low_quality_fits",
    f"WITH {SPECTRA}, f AS (SELECT file, corr(freq, log10(power)) ^ 2 AS r2, sqrt(avg((log10(power)) ^ 2) - avg(log10(power)) ^ 2) AS error FROM spectra GROUP BY file) SELECT file, round(r2, 6) AS r_squared, round(error, 6) AS error FROM f WHERE r2 < 0.98 OR error > 0.4",
)
def low_quality_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = F.log10("power")
    rows = spectra(spark, sf_dir).groupBy("file").agg((correlation(F.col("freq"), log) ** 2).alias("r_squared"), F.sqrt(F.avg(log**2) - F.avg(log) ** 2).alias("error"))
    return rounded(fields.low_quality(rows), "r_squared", "error")


@query(
    "n12_strongest_peaks",
    f"""WITH {SPECTRA}, p AS (SELECT *, lag(power) OVER w AS a, lead(power) OVER w AS b FROM spectra WINDOW w AS (PARTITION BY file ORDER BY freq)),
    peaks AS (SELECT file, freq + (b - a) / (a + b + power) AS cf, log10(power) AS pw, 1 + abs(2 * power - a - b) / power AS bw FROM p WHERE power > a AND power > b),
    q AS (SELECT file, band, cf, pw, bw, row_number() OVER (PARTITION BY file, band ORDER BY pw DESC, cf) AS r FROM peaks JOIN (VALUES ('theta', 3, 7), ('alpha', 8, 12), ('all', 1, 12)) t(band, low, high) ON cf BETWEEN low AND high)
    SELECT file, band, round(cf, 6) AS cf, round(pw, 6) AS pw, round(bw, 6) AS bw, round(cf - bw / 2, 6) AS low, round(cf + bw / 2, 6) AS high FROM q WHERE r = 1""",
)
def strongest_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("file").orderBy("freq")
    rows = spectra(spark, sf_dir).withColumns({"a": F.lag("power").over(w), "b": F.lead("power").over(w)}).filter("power > a AND power > b")
    peaks = rows.select("file", F.expr("freq + (b - a) / (a + b + power)").alias("cf"), F.log10("power").alias("pw"), F.expr("1 + abs(2 * power - a - b) / power").alias("bw"))
    return rounded(fields.strongest_peaks(peaks, ["file"], {"theta": (3, 7), "alpha": (8, 12), "all": (1, 12)}), "cf", "pw", "bw", "low", "high")


@query(
    "o6_calmest_epochs",
    f"""WITH {EPOCHS}, l AS (SELECT channel, epoch, p2p, abs(delta) + 1 AS low FROM p), m AS (SELECT *, p2p / median(p2p) OVER c + low / median(low) OVER c AS noise FROM l WINDOW c AS (PARTITION BY channel)),
    f AS (SELECT *, first_value(epoch) OVER (PARTITION BY channel ORDER BY noise, epoch) AS first FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY epoch <> first, abs(epoch - first) < 5, noise, epoch) AS rank FROM f)
    SELECT channel, epoch, round(noise, 6) AS noise, CAST(rank AS INT) AS rank FROM r WHERE rank <= 2""",
)
def calmest_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _epochs(spark, sf_dir).withColumn("low", F.abs("delta") + 1)
    return rounded(fields.calmest(rows, "channel", "epoch", "p2p", "low"), "noise")


@query(
    "o7_best_windows",
    f"WITH {EPOCHS}, g AS (SELECT *, CAST(floor(10.0 * epoch / (max(epoch) OVER (PARTITION BY channel) + 1)) AS BIGINT) AS seg, p2p > 60 AS bad FROM p) SELECT channel, seg, arg_min(epoch, struct_pack(b := bad, p := p2p, e := epoch)) AS epoch FROM g GROUP BY ALL",
)
def best_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.best_windows(_epochs(spark, sf_dir), "channel", "epoch", "p2p", 60.0)


@query(
    "n10_notch_interpolated",
    f"WITH {SPECTRA}, g AS (SELECT file, max(freq) FILTER (WHERE freq < 5) AS f1, arg_max(ln(power), freq) FILTER (WHERE freq < 5) AS p1, min(freq) FILTER (WHERE freq > 8) AS f2, arg_min(ln(power), freq) FILTER (WHERE freq > 8) AS p2 FROM spectra GROUP BY file) SELECT file, freq, round(CASE WHEN abs(freq - 6.5) <= 1.5 THEN exp(coalesce(p1 + (p2 - p1) * (freq - f1) / (f2 - f1), p1, p2)) ELSE power END, 6) AS power FROM spectra JOIN g USING (file)",
)
def notch_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.interpolated(spectra(spark, sf_dir), ["file"], "freq", "power", 6.5, 1.5), "power")


def _peaks_sql(trace: str, distance: int) -> str:
    """Tables of the peaks of a table (k, i, v): runs of equal values, maxima, those that stay by height, prominences."""
    return f"""runs_new AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY k ORDER BY i) THEN 0 ELSE 1 END AS new FROM {trace}),
    runs_of AS (SELECT k, v, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS g FROM runs_new), runs AS (SELECT k, g, min(i) AS a, max(i) AS b, min(v) AS v FROM runs_of GROUP BY k, g),
    tops AS (SELECT k, CAST((a + b) // 2 AS BIGINT) AS i, v FROM (SELECT *, lag(v) OVER w AS x, lead(v) OVER w AS y FROM runs WINDOW w AS (PARTITION BY k ORDER BY g)) WHERE v > x AND v > y),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, i DESC) AS r FROM tops),
    picked(k, r, kept) AS (SELECT DISTINCT k, 0::BIGINT, []::BIGINT[] FROM tops UNION ALL SELECT s.k, p.r, CASE WHEN list_min(list_transform(s.kept, lambda x: abs(x - p.i))) < {distance} THEN s.kept ELSE list_append(s.kept, p.i) END FROM picked s JOIN ranked p ON p.k = s.k AND p.r = s.r + 1),
    far AS (SELECT t.* FROM tops t JOIN (SELECT k, unnest(arg_max(kept, r)) AS i FROM picked GROUP BY k) f ON t.k = f.k AND t.i = f.i),
    higher AS (SELECT f.k, f.i, f.v, coalesce(max(y.i) FILTER (y.i < f.i AND y.v > f.v), -1) AS a, min(y.i) FILTER (y.i > f.i AND y.v > f.v) AS b FROM far f JOIN {trace} y ON f.k = y.k GROUP BY f.k, f.i, f.v),
    prominent AS (SELECT h.k, h.i, h.v, h.v - greatest(min(y.v) FILTER (y.i > a AND y.i <= h.i), min(y.v) FILTER (y.i >= h.i AND (b IS NULL OR y.i < b))) AS prominence FROM higher h JOIN {trace} y ON h.k = y.k GROUP BY h.k, h.i, h.v)"""


@query("w20_peaks", f"WITH RECURSIVE {TRACE}, keyed AS (SELECT channel AS k, i, v FROM trace), {_peaks_sql('keyed', 4)} SELECT k AS channel, i, round(prominence, 6) AS prominence FROM prominent WHERE prominence >= 25")
def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(extrema.peaks(trace(spark, sf_dir), "channel", "i", "v", 4, 25.0).select("channel", "i", "prominence"), "prominence")


@query(
    "n34_phase_profile",
    f"""WITH RECURSIVE {TRACE}, keyed AS (SELECT struct_pack(s := i // 16, c := channel % 4) AS k, i % 16 AS i, sum(v) AS v FROM trace GROUP BY ALL), {_peaks_sql('keyed', 3)},
    limits AS (SELECT k, greatest(0.5::DOUBLE * stddev_pop(v), 1e-9) AS least FROM keyed GROUP BY k), pk AS (SELECT p.k.s AS s, p.k.c AS c, p.i / 10.0::DOUBLE AS t FROM prominent p JOIN limits l ON p.k = l.k WHERE p.prominence >= l.least),
    ref AS (SELECT s, min(t) AS start, median(t - u) AS period FROM (SELECT s, t, lag(t) OVER (PARTITION BY s ORDER BY t) AS u FROM pk WHERE c = 1 AND t >= 0.2) GROUP BY s HAVING count(*) >= 2),
    lags AS (SELECT pk.s, pk.c, min(t - start) AS lag, any_value(period) AS period FROM pk JOIN ref ON pk.s = ref.s WHERE t >= start GROUP BY pk.s, pk.c),
    sums AS (SELECT c, sum(cos(2 * pi() * fmod(lag, period) / period)) AS x, sum(sin(2 * pi() * fmod(lag, period) / period)) AS y, count(*) AS n FROM lags GROUP BY c)
    SELECT c AS channel, round(x / n, 5) AS x, round(y / n, 5) AS y, round(sqrt(x * x + y * y) / n, 5) AS r, n, round((SELECT avg(period) FROM ref), 6) AS period FROM sums""",
)
def phase_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users modulo 4 as channels, 16 samples as a snippet at 10 Hz; the mean vector, for an angle jumps at half a turn."""
    rows = trace(spark, sf_dir).groupBy(F.expr("i div 16").alias("s"), (F.col("channel") % 4).alias("c"), (F.col("i") % 16).alias("i")).agg(F.sum("v").alias("v"))
    found = extrema.phase_profile(rows, "s", "c", "i", "v", 10.0, 1, distance=0.3, guard=0.2)
    found = rounded(found.withColumns({"x": F.col("r") * F.cos("phase"), "y": F.col("r") * F.sin("phase")}), "x", "y", "r", digits=5)
    return rounded(found, "period").select(F.col("c").alias("channel"), "x", "y", "r", "n", "period")


@query("tumbling_epochs", f"SELECT CAST(epoch_us(ts) // {24 * HOUR} AS BIGINT) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.epochs import tumbling

    rows = tumbling(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", ["event_type"], "value")
    return rounded(rows.select((F.unix_micros("start") / (24 * HOUR)).cast("long").alias("day"), "event_type", "n", "total"), "total", digits=4)
