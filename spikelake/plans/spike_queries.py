"""Queries of the spike-train, waveform and cluster operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import clusters, joins, kernels, spikes as ops
from .proxies import FEATURES, HOUR, POINTS, SPIKES, WAVES, points, query, read, rounded, spikes, waves

ISI = f"{SPIKES}, isi AS (SELECT *, ts - lag(ts) OVER w AS isi, lag(amp) OVER w AS prior FROM spikes WINDOW w AS (PARTITION BY unit ORDER BY ts))"


def _isi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.intervals(spikes(spark, sf_dir), "unit", "ts", "amp")


@query("a17_isi_violations", f"WITH {ISI} SELECT unit, round(100.0 * avg(CASE WHEN isi IS NOT NULL THEN CASE WHEN isi < {2 * HOUR} THEN 1.0 ELSE 0.0 END END), 6) AS isi_violations, round(100.0 * sum(CASE WHEN isi < {2 * HOUR} THEN 1.0 ELSE 0.0 END) / count(*), 6) AS rpv FROM isi GROUP BY unit")
def isi_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.violations(_isi(spark, sf_dir), "unit", 2 * HOUR), "isi_violations", "rpv")


@query("a18_complex_index", f"WITH {ISI} SELECT unit, round(100.0 * avg(CASE WHEN isi BETWEEN {3 * HOUR} AND {20 * HOUR} AND amp < prior THEN 1.0 ELSE 0.0 END), 6) AS csi FROM isi WHERE isi IS NOT NULL GROUP BY unit")
def complex_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.complex_index(_isi(spark, sf_dir), "unit", "amp", 3 * HOUR, 20 * HOUR), "csi")


HISTOGRAM = f"hist AS (SELECT unit, CAST(least(floor(isi / {10.0 * HOUR}), 19) AS BIGINT) AS bin, count(*) AS n FROM isi WHERE isi BETWEEN 0 AND {200 * HOUR} GROUP BY ALL)"


@query("a20_isi_histogram", f"WITH {ISI}, {HISTOGRAM} SELECT unit, bin, n FROM hist")
def isi_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.interval_histogram(_isi(spark, sf_dir), "unit", 10 * HOUR, 200 * HOUR)


@query("a20_burst_power", f"WITH {ISI} SELECT unit, round(100.0 * avg(CASE WHEN isi <= {5 * HOUR} THEN 1.0 ELSE 0.0 END), 6) AS burst FROM isi WHERE isi IS NOT NULL GROUP BY unit")
def burst_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.burst_power(_isi(spark, sf_dir), "unit", 5 * HOUR), "burst")


@query(
    "w14_half_maximum",
    f"""WITH {ISI}, {HISTOGRAM}, g AS (SELECT unit, unnest(range(20)) AS bin FROM (SELECT DISTINCT unit FROM hist)), f AS (SELECT g.unit, g.bin, coalesce(n, 0) AS n FROM g LEFT JOIN hist USING (unit, bin)),
    top AS (SELECT unit, max(n) AS peak, arg_max(bin, struct_pack(n := n, b := -bin)) AS spot FROM f GROUP BY unit),
    c AS (SELECT f.*, peak, spot, (bin + 0.5) * 10 AS x, lag(n) OVER w AS a, lead(n) OVER w AS b FROM f JOIN top USING (unit) WINDOW w AS (PARTITION BY unit ORDER BY bin))
    SELECT unit, any_value(peak) AS peak, any_value((spot + 0.5) * 10)::DOUBLE AS "at", round(greatest(0, coalesce(arg_max(x + (peak / 2 - n) / (b - n) * 10, bin) FILTER (WHERE bin < spot AND n <= peak / 2), 0))::DOUBLE, 6) AS low,
      round(least(200, coalesce(arg_min(x - 10 + (peak / 2 - a) / (n - a) * 10, bin) FILTER (WHERE bin > spot AND n <= peak / 2), 200))::DOUBLE, 6) AS high FROM c GROUP BY unit""",
)
def half_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.half_width(isi_histogram(spark, sf_dir), "unit", 10.0, 0.0, 200.0), "at", "low", "high")


@query("n17_autocorrelogram", f"WITH {SPIKES} SELECT a.unit, CAST(trunc((b.ts - a.ts) / {4.0 * HOUR}) AS BIGINT) AS bin, count(*) AS n FROM spikes a JOIN spikes b ON a.unit = b.unit AND abs(b.ts - a.ts) <= {48 * HOUR} AND a.ts <> b.ts GROUP BY ALL")
def autocorrelogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.autocorrelogram(joins.band_pairs(spikes(spark, sf_dir), "unit", "ts", 48 * HOUR, []), "unit", 4.0 * HOUR)


@query(
    "n19_cross_histogram",
    f"""WITH {SPIKES}, h AS (SELECT unit, CAST(floor(ts / {4.0 * HOUR}) AS BIGINT) AS t, count(*) AS c FROM spikes GROUP BY ALL),
    x AS (SELECT a.unit, b.t - a.t AS lag, sum(a.c * b.c) AS n FROM h a JOIN h b ON a.unit = b.unit AND b.t - a.t BETWEEN -50 AND 50 AND a.t <> b.t GROUP BY ALL),
    k AS (SELECT unit, (CASE WHEN lag < 0 THEN lag + 50 ELSE lag + 49 END) // 20 AS k, n FROM x)
    SELECT unit, CAST(-50 + 20 * (CASE WHEN k < 2 THEN k ELSE k + 1 END) AS BIGINT) AS lag, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY ALL""",
)
def cross_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cross_histogram(spikes(spark, sf_dir), "unit", "ts", 4.0 * HOUR, 50, 20)


MEANS = f"{WAVES}, means AS (SELECT label, i, avg(v) AS mean, stddev_samp(v) AS sd FROM samples GROUP BY ALL)"


@query("a32_mean_wave", f"WITH {MEANS} SELECT label, CAST(i AS INT) AS i, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - lag(mean) OVER (PARTITION BY label ORDER BY i), 6) AS d FROM means")
def mean_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.mean_wave(waves(spark, sf_dir), ["label"], "wave"), "mean", "sd", "d")


@query(
    "a32_wave_shape",
    f"""WITH {MEANS}, p AS (SELECT label, arg_max(i, struct_pack(m := mean, i := -i)) AS spot FROM means GROUP BY label),
    s AS (SELECT label, any_value(spot) AS peak_at, max(mean) AS peak, min(mean) FILTER (WHERE i >= spot) AS trough, arg_min(i, struct_pack(m := mean, i := i)) FILTER (WHERE i >= spot) AS trough_at FROM means JOIN p USING (label) GROUP BY label)
    SELECT label, round(peak, 6) AS peak, CAST(peak_at AS INT) AS peak_at, round(trough, 6) AS trough, CAST(trough_at AS INT) AS trough_at, round(peak / abs(trough), 6) AS ratio, CAST(trough_at - peak_at AS INT) AS width FROM s""",
)
def wave_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.wave_shape(ops.mean_wave(waves(spark, sf_dir), ["label"], "wave"), ["label"]), "peak", "trough", "ratio")


def _maxima_sql(name: str, source: str, least: float) -> str:
    """Tables of the local maxima of a table (k, i, v), their prominences and widths, and `name` with those that are kept."""
    return f"""{name}_t AS (SELECT *, lag(v) OVER w AS x, lead(v) OVER w AS y FROM {source} WINDOW w AS (PARTITION BY k ORDER BY i)), {name}_p AS (SELECT k, i, v FROM {name}_t WHERE v > x AND v > y),
    {name}_h AS (SELECT p.k, p.i, p.v, coalesce(max(s.i) FILTER (s.i < p.i AND s.v > p.v), -1) AS a, coalesce(min(s.i) FILTER (s.i > p.i AND s.v > p.v), 1000) AS b FROM {name}_p p JOIN {source} s ON p.k = s.k GROUP BY ALL),
    {name}_m AS (SELECT h.k, h.i, h.v, h.v - greatest(min(s.v) FILTER (s.i > a AND s.i <= h.i), min(s.v) FILTER (s.i < b AND s.i >= h.i)) AS prominence FROM {name}_h h JOIN {source} s ON h.k = s.k GROUP BY h.k, h.i, h.v),
    {name}_l AS (SELECT m.k, m.i, m.v, m.prominence, m.v - m.prominence / 2 AS level, max(s.i) FILTER (s.i < m.i AND s.v <= m.v - m.prominence / 2) AS l, min(s.i) FILTER (s.i > m.i AND s.v <= m.v - m.prominence / 2) AS r FROM {name}_m m JOIN {source} s ON m.k = s.k WHERE m.prominence >= {least} GROUP BY ALL),
    {name} AS (SELECT c.k, c.i, c.v, (c.r - (c.level - r0.v) / (r1.v - r0.v)) - (c.l + (c.level - l0.v) / (l1.v - l0.v)) AS width FROM {name}_l c JOIN {source} l0 ON c.k = l0.k AND c.l = l0.i JOIN {source} l1 ON c.k = l1.k AND c.l + 1 = l1.i JOIN {source} r0 ON c.k = r0.k AND c.r = r0.i JOIN {source} r1 ON c.k = r1.k AND c.r - 1 = r1.i)"""


@query(
    "a32_wave_properties",
    f"""WITH w AS (SELECT CAST(label AS BIGINT) AS label, vec_id % 7 AS part, c, list_transform(embedding[32 * c + 1 : 32 * c + 32], lambda x: x::DOUBLE * 1000) AS wave FROM embeddings, (SELECT unnest([0, 1]) AS c)),
    n AS (SELECT label, part, c, count(*) AS n, stddev_samp(list_max(wave)) / avg(list_max(wave)) AS rsd FROM w GROUP BY ALL), m AS (SELECT label, part, c, i, avg(wave[i + 1]) AS v FROM w, (SELECT unnest(range(32)) AS i) GROUP BY ALL),
    top AS (SELECT label, part, c, max(v) AS peak, arg_max(i, struct_pack(v := v, i := -i)) AS spot FROM m GROUP BY ALL), best AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY label, part ORDER BY peak DESC, c) = 1),
    shape AS (SELECT struct_pack(l := label, p := part) AS k, m.i AS i, m.v AS v FROM m JOIN best USING (label, part, c)), tail AS (SELECT struct_pack(l := label, p := part) AS k, m.i - spot AS i, -m.v AS v FROM m JOIN best USING (label, part, c) WHERE m.i >= spot),
    {_maxima_sql("tops", "shape", 15)}, {_maxima_sql("dips", "tail", 5)}, tt AS (SELECT k, arg_max(width, struct_pack(v := v, i := -i)) AS width FROM tops GROUP BY k), dd AS (SELECT k, arg_max(width, struct_pack(v := v, i := -i)) AS ahp, min(i) AS first FROM dips GROUP BY k),
    low AS (SELECT k, -max(v) AS trough, arg_max(i, struct_pack(v := v, i := -i)) + 1 AS steps FROM tail GROUP BY k)
    SELECT b.label, b.part, b.c AS channel, round(b.peak, 5) AS peak, round(trough, 5) AS trough, round(b.peak / trough, 5) AS ratio, round(steps * 0.5::DOUBLE, 5) AS peak_to_trough, round(tt.width * 0.5::DOUBLE, 5) AS width, round(dd.ahp * 0.5::DOUBLE, 5) AS ahp_width,
      round((t0.v - t1.v) / (0.5::DOUBLE / 9), 4) AS end_slope, round(rsd, 6) AS amplitude_rsd, round(n / 100.0::DOUBLE, 6) AS rate
    FROM best b JOIN n USING (label, part, c) JOIN low ON low.k = struct_pack(l := b.label, p := b.part) LEFT JOIN tt ON tt.k = low.k LEFT JOIN dd ON dd.k = low.k LEFT JOIN tail t0 ON t0.k = low.k AND t0.i = dd.first LEFT JOIN tail t1 ON t1.k = low.k AND t1.i = dd.first + 10""",
)
def wave_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven units a label, the two halves of a vector as their channels, in thousandths."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), (F.col("vec_id") % 7).alias("part"), F.explode(F.array(F.lit(0), F.lit(1))).alias("c"), "embedding")
    rows = rows.select("label", "part", "c", F.transform(F.slice("embedding", 32 * F.col("c") + 1, F.lit(32)), lambda x: x.cast("double") * 1000).alias("wave"))
    found = ops.wave_properties(rows, ["label", "part"], "c", "wave", 0.5, 100.0).withColumnRenamed("c", "channel")
    return rounded(rounded(rounded(found, "peak", "trough", "ratio", "peak_to_trough", "width", "ahp_width", digits=5), "end_slope", digits=4), "amplitude_rsd", "rate")


@query(
    "n18_theta_modulation",
    f"""WITH {SPIKES}, n AS (SELECT unit, count(*) AS n FROM spikes GROUP BY unit), h AS (SELECT a.unit, CAST(least(floor((b.ts - a.ts + {96 * HOUR}) / {4.0 * HOUR}), 47) AS INT) AS b, count(*) AS c FROM spikes a JOIN spikes b ON a.unit = b.unit AND abs(b.ts - a.ts) <= {96 * HOUR} AND a.ts <> b.ts GROUP BY ALL),
    g AS (SELECT unit, b, coalesce(c, 0) AS c FROM n CROSS JOIN (SELECT unnest(range(48)) AS b) LEFT JOIN h USING (unit, b)), k AS (SELECT unnest(range(24)) AS k),
    p AS (SELECT unit, k, sum(c * cos(2 * pi() * (k * b % 48) / 48)) ^ 2 + sum(c * sin(2 * pi() * (k * b % 48) / 48)) ^ 2 AS p FROM g, k GROUP BY unit, k),
    m AS (SELECT unit, avg(p) AS mean, max(p) FILTER (k BETWEEN 3 AND 6) AS best FROM p GROUP BY unit)
    SELECT unit, n, n >= 12 AND best > 0.5::DOUBLE * mean AS modulated, round(CASE WHEN n >= 12 THEN best END, 4) AS best FROM n JOIN m USING (unit)""",
)
def theta_modulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags within 96 hours in bins of 4, which stand for 20 ms; the power, for equal ones may stand at any of their places."""
    return rounded(ops.theta_modulation(spikes(spark, sf_dir), "unit", "ts", 96.0 * HOUR, 4.0 * HOUR, 0.02, times=0.5, least=12), "best", digits=4).select("unit", "n", "modulated", "best")


@query("a14_peak_to_peak", f"WITH {WAVES} SELECT label, round(avg(list_max(wave) - list_min(wave)), 6) AS p2p FROM waves GROUP BY label")
def peak_to_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.peak_to_peak(waves(spark, sf_dir), ["label"], "wave"), "p2p")


NOISE = f"{WAVES}, p AS (SELECT label, avg(list_max(wave) - list_min(wave)) AS m, stddev_pop(list_max(wave) - list_min(wave)) AS sd FROM waves GROUP BY label), z AS (SELECT label, stddev_pop(v) AS noise FROM samples WHERE i < 4 GROUP BY label)"


@query("a19_noise_ratio", f"WITH {NOISE} SELECT label, round(m / (2 * noise), 6) AS snr, round(sd / m, 6) AS cv FROM p JOIN z USING (label)")
def noise_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.noise_ratio(waves(spark, sf_dir), ["label"], "wave"), "snr", "cv")


@query("a12_robust_noise", f"WITH {WAVES} SELECT label, round(mad(v) / 0.6745::DOUBLE, 6) AS sigma FROM samples WHERE i < 5 GROUP BY label")
def robust_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.robust_noise(waves(spark, sf_dir), ["label"], "wave"), "sigma")


@query("a15_best_channel", f"WITH {MEANS} SELECT label, CAST(arg_max(i, struct_pack(v := abs(mean), i := -i)) AS INT) AS by_size, CAST(arg_max(i, struct_pack(v := mean, i := -i)) AS INT) AS by_peak FROM means GROUP BY label")
def best_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = ops.mean_wave(waves(spark, sf_dir), ["label"], "wave")
    one = ops.best_channel(means, ["label"], "i", F.abs("mean")).withColumnRenamed("channel", "by_size")
    return one.join(ops.best_channel(means, ["label"], "i", F.col("mean")).withColumnRenamed("channel", "by_peak"), "label")


@query("a16_template_correlation", f"WITH {MEANS}, r AS (SELECT s.label, s.vec_id, corr(s.v, m.mean) AS r FROM samples s JOIN means m ON s.label = m.label AND s.i = m.i GROUP BY ALL) SELECT label, round(avg(r), 6) AS template_r FROM r WHERE NOT isnan(r) GROUP BY label")
def template_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.template_correlation(waves(spark, sf_dir), ["label"], "vec_id", "wave"), "template_r")


@query(
    "w15_onset_offset",
    f"""WITH {WAVES}, b AS (SELECT *, wave[1:5] AS base, list_position(wave, list_max(wave)) - 1 AS peak, list_position(wave, list_min(wave)) - 1 AS trough FROM waves),
    t AS (SELECT *, list_avg(base) AS middle, 2 * CASE WHEN list_mad(base) > 0 THEN list_mad(base) / 0.6745::DOUBLE WHEN list_stddev_pop(base) > 0 THEN list_stddev_pop(base) ELSE 2.220446049250313e-16 END AS near FROM b)
    SELECT vec_id, CAST(peak AS INT) AS peak, CAST(trough AS INT) AS trough, CAST(coalesce(list_max([i - 1 for i in range(1, 33) if i - 1 <= least(peak, trough) AND abs(wave[i] - middle) < near]), 0) AS INT) AS onset,
      CAST(coalesce(list_min([i - 1 for i in range(1, 33) if i - 1 >= greatest(peak, trough) AND abs(wave[i] - middle) < near]), 31) AS INT) AS offset_ FROM t""",
)
def onset_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.duration(waves(spark, sf_dir), "wave").select("vec_id", "peak", "trough", "onset", F.col("offset").alias("offset_"))


QUALITY = f"{ISI}, n AS (SELECT unit, count(*) AS n, 100.0 * sum(CASE WHEN isi < {2 * HOUR} THEN 1.0 ELSE 0.0 END) / count(*) AS rpv, avg(amp) / stddev_pop(amp) * 3 AS snr, stddev_pop(amp) / avg(amp) / 2 AS cv, 100.0 * avg(CASE WHEN isi IS NOT NULL THEN CASE WHEN isi BETWEEN {3 * HOUR} AND {20 * HOUR} AND amp < prior THEN 1.0 ELSE 0.0 END END) AS csi FROM isi GROUP BY unit)"


@query(
    "p15_p17_p18_unit_labels",
    f"""WITH {QUALITY} SELECT unit, CASE WHEN snr < 1.5 THEN 'poor' WHEN snr < 2.5 THEN 'fair' WHEN snr <= 4 THEN 'good' ELSE 'excellent' END AS snr_label, CASE WHEN rpv < 1 THEN 'clean' WHEN rpv < 5 THEN 'acceptable' ELSE 'contaminated' END AS isi_label,
    (rpv < 1 AND snr >= 3 AND cv <= 0.5) AS single_unit, CASE WHEN n >= 50 AND rpv < 1 AND snr >= 3 AND cv <= 0.5 THEN csi > 5 ELSE false END AS complex_cell FROM n""",
)
def unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _isi(spark, sf_dir)
    mean, sd = F.avg("amp"), F.stddev_pop("amp")
    size = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), (columns.divided(mean, sd) * 3).alias("snr"), (columns.divided(sd, mean) / 2).alias("cv"))
    size = size.join(ops.violations(rows, "unit", 2 * HOUR), "unit").join(ops.complex_index(rows, "unit", "amp", 3 * HOUR, 20 * HOUR), "unit", "left")
    single = ops.single_unit(F.col("rpv"), F.col("snr"), F.col("cv"))
    return size.select("unit", ops.snr_label(F.col("snr")).alias("snr_label"), ops.isi_label(F.col("rpv")).alias("isi_label"), single.alias("single_unit"), ops.complex_cell(F.col("n"), single, F.col("csi")).alias("complex_cell"))


@query(
    "p14_place_cells",
    f"""WITH {SPIKES}, u AS (SELECT unit, count(*) AS n, max(amp) / 10 AS peak, avg(amp) / 10 AS sir, CASE WHEN unit % 5 <> 0 THEN stddev_pop(amp) / 30 END AS sparsity, unit % 2 = 0 AS sig FROM spikes GROUP BY unit)
    SELECT unit, CASE WHEN sparsity IS NOT NULL THEN n > 5 * 10 AND peak > 1 AND peak < 15 AND sir > 0.5 AND sparsity < 0.9 AND sig END AS place_cell FROM u""",
)
def place_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spikes(spark, sf_dir).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), (F.max("amp") / 10).alias("peak"), (F.avg("amp") / 10).alias("sir"), (F.stddev_pop("amp") / 30).alias("sd"))
    sparsity = F.when(F.col("unit") % 5 != 0, F.col("sd"))
    return rows.select("unit", ops.place_cell(F.col("n"), F.col("peak"), F.col("sir"), sparsity, F.col("unit") % 2 == 0).alias("place_cell"))


def _d2_sql() -> str:
    """Squared distances by the LDL' form of each cluster's covariance."""
    k = range(len(FEATURES))
    means = ", ".join(f"avg({FEATURES[i]}) AS m_{i}" for i in k)
    cov = ", ".join(f"covar_samp({FEATURES[i]}, {FEATURES[j]}){' + 1e-10' if i == j else ''} AS a_{i}_{j}" for i in k for j in range(i + 1))
    steps = []
    for j in k:
        steps.append(f"a_{j}_{j}" + "".join(f" - l_{j}_{x} ^ 2 * d_{x}" for x in range(j)) + f" AS d_{j}")
        steps += [f"(a_{i}_{j}" + "".join(f" - l_{i}_{x} * l_{j}_{x} * d_{x}" for x in range(j)) + f") / d_{j} AS l_{i}_{j}" for i in range(j + 1, len(k))]
    z = ", ".join(f"{FEATURES[i]} - m_{i}" + "".join(f" - l_{i}_{j} * z_{j}" for j in range(i)) + f" AS z_{i}" for i in k)
    d2 = " + ".join(f"z_{i} ^ 2 / d_{i}" for i in k)
    return (
        f"{POINTS}, m AS (SELECT file, label AS cluster, count(*) AS nc, {means}, {cov} FROM points GROUP BY file, label), "
        f"l AS (SELECT *, sum(nc) OVER (PARTITION BY file) AS n, {', '.join(steps)} FROM m), "
        f"d AS (SELECT file, cluster, vec_id, label = cluster AS own, nc, n, {z}, {d2} AS d2 FROM points JOIN l USING (file))"
    )


D2 = _d2_sql()


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.distances(points(spark, sf_dir), "file", "label", "vec_id", FEATURES)


@query("a26_mahalanobis", f"WITH {D2} SELECT cluster, vec_id, own, round(d2, 6) AS d2 FROM d")
def mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_distances(spark, sf_dir), "d2").select("cluster", "vec_id", "own", "d2")


TAIL = "exp(-d2 / 2) * (1 + d2 / 2 + (d2 / 2) ^ 2 / 2 + (d2 / 2) ^ 3 / 6)"
RATIO = f"{D2}, q AS (SELECT cluster, sum(CASE WHEN NOT own THEN {TAIL} ELSE 0 END) / any_value(nc) AS l_ratio FROM d GROUP BY cluster), r AS (SELECT cluster, d2, nc, n, row_number() OVER (PARTITION BY cluster ORDER BY d2, vec_id) AS r FROM d WHERE NOT own), i AS (SELECT cluster, d2 AS iso FROM r WHERE r = nc AND 2 * nc <= n)"


@query("a27_l_ratio", f"WITH {RATIO} SELECT cluster, round(l_ratio, 6) AS l_ratio FROM q")
def l_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clusters.l_ratio(_distances(spark, sf_dir), len(FEATURES)), "l_ratio").drop("file")


@query("a28_o2_isolation_distance", f"WITH {RATIO} SELECT q.cluster, round(i.iso, 6) AS iso FROM q LEFT JOIN i USING (cluster)")
def isolation_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clusters.isolation(_distances(spark, sf_dir), "vec_id"), "iso").drop("file")


@query("o3_nearest_pool", f"WITH {RATIO} SELECT cluster, count(*) AS n, round(max(d2), 6) AS furthest FROM r WHERE r <= 3 * nc GROUP BY cluster")
def nearest_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clusters.pool(_distances(spark, sf_dir), "vec_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("furthest")), "furthest")


@query("p16_cluster_labels", f"WITH {RATIO} SELECT q.cluster, CASE WHEN l_ratio < 0.2 AND iso > 10 THEN 'Good' ELSE 'Poor' END AS quality, CASE WHEN l_ratio / 100 < 0.05 THEN 'Yes' ELSE 'No' END AS shuffled FROM q LEFT JOIN i USING (cluster)")
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _distances(spark, sf_dir)
    rows = clusters.l_ratio(d, len(FEATURES)).join(clusters.isolation(d, "vec_id"), ["file", "cluster"], "left")
    return rows.select("cluster", clusters.label(F.col("l_ratio"), F.col("iso")).alias("quality"), clusters.shuffle_label(F.col("l_ratio") / 100).alias("shuffled"))


@query(
    "n23_cluster_pools",
    f"""WITH {RATIO}, c AS (SELECT DISTINCT file, cluster, nc, n FROM d) SELECT c.file, c.cluster, CAST(nc AS BIGINT) AS n, round(l_ratio, 5) AS l_ratio, round(iso, 5) AS iso, CAST(CASE WHEN 2 * nc <= n THEN least(3 * nc, n - nc) ELSE 0 END AS BIGINT) AS pool
    FROM c JOIN q ON q.cluster = c.cluster LEFT JOIN i ON i.cluster = c.cluster WHERE nc > 8 AND nc < n""",
)
def cluster_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the null model of N23 starts from: the real clusters, and how many points it draws from."""
    rows = points(spark, sf_dir).select("file", F.struct("vec_id", "label", F.array(*FEATURES).alias("x")).alias("p"))
    rows = rows.groupBy("file").agg(F.array_sort(F.collect_list("p")).alias("p")).select("file", F.col("p.label").alias("labels"), F.col("p.x").alias("points"))
    found = kernels.cluster_null(rows, "file", len(FEATURES), draws=0)
    return rounded(found.select("file", "cluster", "n", "l_ratio", "iso", "pool"), "l_ratio", "iso", digits=5)


@query("j18_u3_cluster_and_rest", f"WITH {POINTS} SELECT vec_id FROM points EXCEPT SELECT vec_id FROM points WHERE label = 3")
def cluster_and_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    return rows.select("vec_id").exceptAll(rows.filter("label = 3").select("vec_id"))
