"""Queries of the spatial-map operators, the flagship among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import maps
from .proxies import HOUR, SMOOTH, SPIKES, TRACK, grid, grid_sql, query, rounded, spikes, track

MEASURES = """peak AS (SELECT sum(occ) AS t, max(s) AS peak_fr, sum(s * occ) / sum(occ) AS mean_fr, sum(s * s * occ) / sum(occ) AS sq FROM smooth)
SELECT round(any_value(p.peak_fr), 6) AS peak_fr, round(any_value(p.mean_fr), 6) AS mean_fr, round(sum(CASE WHEN s > 0 THEN occ / t * (s / mean_fr) * log2(s / mean_fr) ELSE 0 END), 6) AS sir, round(any_value(mean_fr * mean_fr / sq), 6) AS sparsity FROM smooth, peak p"""


@query("flagship_rate_map", f"WITH {grid_sql()}, {SMOOTH}, {MEASURES}")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy and spikes of a grid, smoothed rates, peak, mean, information and sparsity."""
    return rounded(maps.information(maps.smoothed(grid(spark, sf_dir), []), []), "peak_fr", "mean_fr", "sir", "sparsity")


@query(
    "a6_a8_information_of_halves",
    f"""WITH {grid_sql("half")}, smooth AS (SELECT g.half, g.bx, g.by_, g.occ, sum(o.rate * (2 - abs(g.bx - o.bx)) * (2 - abs(g.by_ - o.by_))) / sum((2 - abs(g.bx - o.bx)) * (2 - abs(g.by_ - o.by_))) AS s FROM grid g JOIN grid o ON g.half = o.half AND abs(g.bx - o.bx) <= 1 AND abs(g.by_ - o.by_) <= 1 AND o.valid WHERE g.valid GROUP BY ALL),
    peak AS (SELECT half, sum(occ) AS t, max(s) AS peak_fr, sum(s * occ) / sum(occ) AS mean_fr, sum(s * s * occ) / sum(occ) AS sq FROM smooth GROUP BY half)
    SELECT half, round(any_value(peak_fr), 6) AS peak_fr, round(any_value(mean_fr), 6) AS mean_fr, round(sum(CASE WHEN s > 0 THEN occ / t * (s / mean_fr) * log2(s / mean_fr) ELSE 0 END), 6) AS sir, round(any_value(mean_fr * mean_fr / sq), 6) AS sparsity FROM smooth JOIN peak USING (half) GROUP BY half""",
)
def information_of_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maps.information(maps.smoothed(grid(spark, sf_dir, ["half"]), ["half"]), ["half"]), "peak_fr", "mean_fr", "sir", "sparsity")


@query("n14_smoothed_map", f"WITH {grid_sql()}, {SMOOTH} SELECT g.bx, g.by_, g.valid, round(coalesce(s.s, 0), 6) AS smooth FROM grid g LEFT JOIN smooth s ON g.bx = s.bx AND g.by_ = s.by_")
def smoothed_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maps.smoothed(grid(spark, sf_dir), []), "smooth").select("bx", "by_", "valid", "smooth")


@query("n15_disk_map", f"WITH {grid_sql()} SELECT g.bx, g.by_, round(avg(o.occ), 6) AS smooth FROM grid g JOIN grid o ON (g.bx - o.bx) ^ 2 + (g.by_ - o.by_) ^ 2 <= 25 AND o.valid WHERE g.valid GROUP BY ALL")
def disk_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maps.smoothed(grid(spark, sf_dir), [], "occ", maps.disk(5)).filter("valid"), "smooth").select("bx", "by_", "smooth")


@query("n15_gaussian_map", f"WITH {grid_sql()} SELECT g.bx, g.by_, round(sum(o.rate * exp(-((g.bx - o.bx) ^ 2 + (g.by_ - o.by_) ^ 2) / 4.5::DOUBLE)) / sum(exp(-((g.bx - o.bx) ^ 2 + (g.by_ - o.by_) ^ 2) / 4.5::DOUBLE)), 6) AS smooth FROM grid g JOIN grid o ON abs(g.bx - o.bx) <= 6 AND abs(g.by_ - o.by_) <= 6 AND o.valid WHERE g.valid GROUP BY ALL")
def gaussian_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maps.smoothed(grid(spark, sf_dir), [], "rate", maps.gaussian(1.5)).filter("valid"), "smooth").select("bx", "by_", "smooth")


@query("j9_neighbour_means", f"WITH {grid_sql()} SELECT g.bx, g.by_, round(avg(o.rate), 6) AS around FROM grid g JOIN grid o ON abs(g.bx - o.bx) <= 1 AND abs(g.by_ - o.by_) <= 1 AND (g.bx <> o.bx OR g.by_ <> o.by_) AND o.valid WHERE g.valid GROUP BY ALL")
def neighbour_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maps.neighbour_mean(grid(spark, sf_dir), [], "rate"), "around").select("bx", "by_", "around")


AROUND = "around AS (SELECT g.half, g.bx, g.by_, g.rate, avg(o.rate) AS a FROM grid g LEFT JOIN grid o ON g.half = o.half AND abs(g.bx - o.bx) <= 1 AND abs(g.by_ - o.by_) <= 1 AND (g.bx <> o.bx OR g.by_ <> o.by_) AND o.valid WHERE g.valid GROUP BY ALL)"


@query("a9_coherence", f"WITH {grid_sql('half')}, {AROUND}, r AS (SELECT half, count(*) AS n, greatest(-0.9999, least(0.9999, corr(rate, a))) AS r FROM around WHERE a IS NOT NULL GROUP BY half) SELECT half, round(CASE WHEN n > 2 THEN 0.5 * ln((1 + r) / (1 - r)) END, 6) AS coherence FROM r")
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maps.coherence(grid(spark, sf_dir, ["half"]), ["half"]), "coherence")


@query("a10_coherence_all", f"WITH {grid_sql('half')}, {AROUND} SELECT half, round(corr(rate, coalesce(a, 0)), 6) AS coherence FROM around GROUP BY half")
def coherence_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maps.coherence_all(grid(spark, sf_dir, ["half"]), ["half"]), "coherence")


RANKS = "m AS (SELECT a.rate AS x, b.rate AS y FROM grid a JOIN grid b ON a.bx = b.bx AND a.by_ = b.by_ AND a.half = 1 AND b.half = 2), k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM m)"


@query("a34_map_correlation", f"WITH {grid_sql('half')}, {RANKS} SELECT round(coalesce(nullif(corr(x, y), 'NaN'::DOUBLE), -2), 6) AS pearson, round(coalesce(nullif(corr(x, y) FILTER (WHERE x <> 0 OR y <> 0), 'NaN'::DOUBLE), -2), 6) AS pearson_some, round(coalesce(nullif(corr(rx, ry), 'NaN'::DOUBLE), -2), 6) AS spearman FROM k")
def map_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = grid(spark, sf_dir, ["half"])
    return rounded(maps.compared(both.filter("half = 1"), both.filter("half = 2"), [], "rate"), "pearson", "pearson_some", "spearman")


BINS = "binned AS (SELECT *, CAST(floor(x / 8) AS BIGINT) AS bx, CAST(floor(y / 8) AS BIGINT) AS by_ FROM track)"


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.binned_open(track(spark, sf_dir), "x", "y", 8.0)


@query(
    "a1_occupancy_capped",
    f"WITH {TRACK}, {BINS}, d AS (SELECT *, coalesce(least((ts - lag(ts) OVER (PARTITION BY unit ORDER BY ts)) / {HOUR}.0::DOUBLE, 48), 24) AS dt FROM binned) SELECT unit, bx, by_, round(sum(dt), 6) AS occ FROM d GROUP BY ALL",
)
def occupancy_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maps.occupancy(_binned(spark, sf_dir), ["unit"], "ts", 1 / 24, HOUR), "occ")


@query("a2_a4_occupancy_fixed", f"WITH {TRACK}, {BINS} SELECT unit, bx, by_, round(count(*) * 0.03::DOUBLE, 6) AS occ FROM binned GROUP BY ALL")
def occupancy_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maps.occupancy_fixed(_binned(spark, sf_dir), ["unit"], 0.03), "occ")


@query(
    "a3_occupancy_median",
    f"WITH {TRACK}, {BINS}, d AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY unit ORDER BY ts)) / {HOUR}.0::DOUBLE AS dt FROM binned), m AS (SELECT unit, median(dt) AS m FROM d GROUP BY unit) SELECT d.unit, bx, by_, round(count(*) * any_value(m.m), 6) AS occ FROM d JOIN m USING (unit) GROUP BY ALL",
)
def occupancy_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maps.occupancy_median(_binned(spark, sf_dir), ["unit"], "ts", HOUR), "occ")


@query(
    "a5_p10_rates",
    f"""WITH {TRACK}, {SPIKES}, {BINS}, occ AS (SELECT unit, bx, by_, CAST(count(*) AS DOUBLE) AS occ FROM binned GROUP BY ALL),
    near AS (SELECT s.unit, s.spike, arg_min(b.bx, struct_pack(d := abs(s.ts - b.ts), t := b.ts)) AS bx, arg_min(b.by_, struct_pack(d := abs(s.ts - b.ts), t := b.ts)) AS by_, min(abs(s.ts - b.ts)) AS d FROM spikes s JOIN binned b USING (unit) GROUP BY ALL),
    n AS (SELECT unit, bx, by_, count(*) AS n FROM near WHERE d <= {24 * HOUR} GROUP BY ALL)
    SELECT o.unit, o.bx, o.by_, coalesce(n.n, 0) AS n, o.occ >= 2 AS valid, round(CASE WHEN o.occ >= 2 THEN coalesce(n.n, 0) / o.occ ELSE 0 END, 6) AS rate FROM occ o LEFT JOIN n USING (unit, bx, by_)""",
)
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.joins import nearest

    frames = _binned(spark, sf_dir)
    placed = nearest(spikes(spark, sf_dir), frames, "unit", "ts", "frame", 24 * HOUR).filter("hit IS NOT NULL").select("unit", "hit.bx", "hit.by_")
    return rounded(maps.rates(maps.occupancy_fixed(frames, ["unit"], 1.0), placed, ["unit"], 2.0), "rate").select("unit", "bx", "by_", "n", "valid", "rate")


@query(
    "j10_visited_bins",
    f"WITH {TRACK}, {BINS}, b AS (SELECT DISTINCT unit, bx, by_, bx * 8 + 4.0 AS cx, by_ * 8 + 4.0 AS cy FROM binned) SELECT unit, bx, by_ FROM b WHERE EXISTS (SELECT 1 FROM track t WHERE t.unit = b.unit AND sqrt((t.x - b.cx) ^ 2 + (t.y - b.cy) ^ 2) <= 3)",
)
def visited_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = _binned(spark, sf_dir).select("unit", "bx", "by_", (F.col("bx") * 8 + 4.0).alias("cx"), (F.col("by_") * 8 + 4.0).alias("cy")).distinct()
    return maps.visited(bins, track(spark, sf_dir), "unit", "x", "y", 3.0).select("unit", "bx", "by_")


@query(
    "j11_n16_kernel_rate",
    f"""WITH {grid_sql()}, k AS (SELECT g.bx, g.by_, sum(o.n * exp(-((g.bx - o.bx) ^ 2 + (g.by_ - o.by_) ^ 2) / 8.0::DOUBLE)) AS a, sum(o.occ * exp(-((g.bx - o.bx) ^ 2 + (g.by_ - o.by_) ^ 2) / 8.0::DOUBLE)) AS b FROM grid g JOIN grid o ON abs(g.bx - o.bx) <= 8 AND abs(g.by_ - o.by_) <= 8 GROUP BY ALL)
    SELECT bx, by_, round(a / (b + 0.0001::DOUBLE) + 0.0001::DOUBLE, 6) AS rate FROM k""",
)
def kernel_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins, kernel = grid(spark, sf_dir).withColumn("n", F.col("n").cast("double")), maps.gaussian(2.0)
    sums = [maps.spread(bins, [], c, kernel).groupBy("bx", "by_").agg(F.sum(F.col("v") * F.col("w")).alias(c)) for c in ("n", "occ")]
    rows = bins.select("bx", "by_").join(sums[0], ["bx", "by_"]).join(sums[1], ["bx", "by_"])
    return rounded(rows.select("bx", "by_", (F.col("n") / (F.col("occ") + 1e-4) + 1e-4).alias("rate")), "rate")


@query(
    "a11_null_percentiles",
    f"""WITH {grid_sql()}, s AS (SELECT by_ AS shift, sum(rate * bx) AS v FROM grid GROUP BY by_), r AS (SELECT avg(v) AS m, quantile_cont(v, 0.95) AS p FROM s) SELECT shift, round(v, 6) AS v, round(m, 6) AS null_mean, round(p, 6) AS null_p95, v > p AS significant FROM s, r""",
)
def null_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid(spark, sf_dir).groupBy(F.col("by_").alias("shift")).agg(F.sum(F.col("rate") * F.col("bx")).alias("v"))
    w = Window.partitionBy()
    rows = rows.withColumns({"null_mean": F.avg("v").over(w), "null_p95": F.percentile("v", F.lit(0.95)).over(w)}).withColumn("significant", F.col("v") > F.col("null_p95"))
    return rounded(rows, "v", "null_mean", "null_p95")


@query("session_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .proxies import read

    return rounded(read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")), "quantity", digits=4)
