"""Queries of the tracking, window and join operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalog, joins, maps, windows
from .proxies import HOUR, SPIKES, TRACE, TRACK, query, read, rounded, spikes, trace, track

DAY = 24 * HOUR


@query("p1_p2_sentinels", f"WITH {TRACK} SELECT unit, frame, x, y FROM track WHERE x NOT IN (1, -1) AND x <> 0 AND y <> 0")
def sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track(spark, sf_dir).filter(~F.col("x").isin(1, -1) & (F.col("x") != 0) & (F.col("y") != 0)).select("unit", "frame", "x", "y")


@query(
    "p3_p4_jump_filter",
    f"""WITH {TRACK}, d AS (SELECT *, lead(ts) OVER w - ts AS dt, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM track WINDOW w AS (PARTITION BY unit ORDER BY frame))
    SELECT unit, frame, row_number() OVER (PARTITION BY unit ORDER BY ts) AS place FROM d WHERE coalesce(dt, 1) > 0 AND sqrt(coalesce(dx, 0) ^ 2 + coalesce(dy, 0) ^ 2) / coalesce(dt, 1) < 2e-9""",
)
def jump_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("unit").orderBy("frame")
    step = lambda c, last: F.coalesce(F.lead(c).over(w) - F.col(c), F.lit(last))
    rows = track(spark, sf_dir).withColumns({"dt": step("ts", 1), "dx": step("x", 0.0), "dy": step("y", 0.0)})
    rows = rows.filter((F.col("dt") > 0) & (F.hypot("dx", "dy") / F.col("dt") < 2e-9))
    return rows.select("unit", "frame", F.row_number().over(Window.partitionBy("unit").orderBy("ts")).cast("long").alias("place"))


@query("p5_drop_cluster_zero", f"WITH {SPIKES} SELECT unit, spike, cluster FROM spikes WHERE cluster <> 0")
def cluster_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes(spark, sf_dir).filter("cluster <> 0").select("unit", "spike", "cluster")


@query(
    "p6_frame_halves",
    f"WITH {TRACK}, n AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ts) AS i, count(*) OVER (PARTITION BY unit) AS n FROM track) SELECT unit, CASE WHEN i <= n // 2 THEN 1 ELSE 2 END AS half, count(*) AS frames, min(ts) AS t0, max(ts) AS t1 FROM n GROUP BY ALL",
)
def frame_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.halves(track(spark, sf_dir), "unit", "ts").groupBy("unit", "half").agg(F.count(F.lit(1)).alias("frames"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))


@query(
    "p6_spikes_of_halves",
    f"""WITH {SPIKES}, {TRACK}, n AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ts) AS i, count(*) OVER (PARTITION BY unit) AS n FROM track),
    h AS (SELECT unit, CASE WHEN i <= n // 2 THEN 1 ELSE 2 END AS half, min(ts) AS t0, max(ts) AS t1 FROM n GROUP BY ALL)
    SELECT h.unit, h.half, count(*) AS n FROM spikes s JOIN h ON s.unit = h.unit AND s.ts BETWEEN h.t0 - 50000 AND h.t1 + 50000 GROUP BY ALL""",
)
def spikes_of_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = catalog.halves(track(spark, sf_dir), "unit", "ts").groupBy("unit", "half").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    found = spikes(spark, sf_dir).join(spans, "unit").filter((F.col("ts") >= F.col("t0") - 50000) & (F.col("ts") <= F.col("t1") + 50000))
    return found.groupBy("unit", "half").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p7_time_halves",
    f"WITH {TRACK}, m AS (SELECT *, (min(ts) OVER (PARTITION BY unit) + max(ts) OVER (PARTITION BY unit)) / 2 AS m FROM track) SELECT unit, CASE WHEN ts < m THEN 1 WHEN ts > m THEN 2 END AS half, count(*) AS frames FROM m GROUP BY ALL",
)
def time_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.time_halves(track(spark, sf_dir), "unit", "ts").groupBy("unit", "half").agg(F.count(F.lit(1)).alias("frames"))


CM = "cm AS (SELECT *, greatest(max(x) OVER u - min(x) OVER u, max(y) OVER u - min(y) OVER u) / 60.0 AS unit_px, x - min(x) OVER u AS px, y - min(y) OVER u AS py FROM track WINDOW u AS (PARTITION BY unit))"


@query("p8_pixels_to_cm", f"WITH {TRACK}, {CM} SELECT unit, frame, round(px / unit_px, 6) AS x_cm, round(py / unit_px, 6) AS y_cm FROM cm")
def pixels_to_cm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalog.scaled(track(spark, sf_dir), "unit", "x", "y", 60.0), "x_cm", "y_cm").select("unit", "frame", "x_cm", "y_cm")


@query(
    "p9_spatial_bins",
    f"WITH {TRACK}, b AS (SELECT unit, CAST(greatest(0, least(floor(x / 3), ceil(max(x) OVER (PARTITION BY unit) / 3) - 1)) AS BIGINT) AS bx, CAST(greatest(0, least(floor(y / 3), ceil(max(y) OVER (PARTITION BY unit) / 3) - 1)) AS BIGINT) AS by_ FROM track) SELECT unit, bx, by_, count(*) AS n FROM b GROUP BY ALL",
)
def spatial_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.binned(track(spark, sf_dir), "x", "y", 3.0, ["unit"]).groupBy("unit", "bx", "by_").agg(F.count(F.lit(1)).alias("n"))


@query("p9_open_bins", f"WITH {TRACK} SELECT CAST(floor(x / 3) AS BIGINT) AS bx, CAST(floor(y / 3) AS BIGINT) AS by_, count(*) AS n FROM track GROUP BY ALL")
def open_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.binned_open(track(spark, sf_dir), "x", "y", 3.0).groupBy("bx", "by_").agg(F.count(F.lit(1)).alias("n"))


@query("p12_time_window", "SELECT event_id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-09'")
def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = [F.lit(t).cast("timestamp_ntz") for t in ("2024-01-02 00:00:00", "2024-01-09 00:00:00")]
    return read(spark, sf_dir, "events").filter(F.col("ts").between(*bounds)).select("event_id", "user_id")


@query(
    "p13_trim_to_events",
    f"""WITH {TRACK}, e AS (SELECT user_id AS unit, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events WHERE event_type = 'signup' GROUP BY 1),
    n AS (SELECT t.unit, arg_min(t.ts, struct_pack(d := abs(t.ts - e.a), t := t.ts)) AS s, arg_min(t.ts, struct_pack(d := abs(t.ts - e.b), t := t.ts)) AS z, min(e.a) AS a, min(e.b) AS b FROM track t JOIN e USING (unit) GROUP BY t.unit)
    SELECT t.unit, t.frame FROM track t JOIN n USING (unit) WHERE abs(s - a) <= {DAY} AND abs(z - b) <= {DAY} AND t.ts BETWEEN s AND z""",
)
def trim_to_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").filter("event_type = 'signup'").groupBy(F.col("user_id").alias("unit")).agg(*[f(F.unix_micros(F.col("ts").cast("timestamp"))).alias(c) for f, c in ((F.min, "start"), (F.max, "stop"))])
    return catalog.trimmed(track(spark, sf_dir), events, "unit", "ts", DAY).select("unit", "frame")


NEAREST = f"""WITH {SPIKES}, {TRACK}, p AS (SELECT s.unit, s.spike, t.frame, abs(s.ts - t.ts) AS d, t.ts AS tt FROM spikes s JOIN track t ON s.unit = t.unit),
    b AS (SELECT unit, spike, arg_min(frame, struct_pack(d := d, t := tt)) AS frame, min(d) AS d FROM p GROUP BY unit, spike)"""


@query("j1_nearest_frame", f"{NEAREST} SELECT s.unit, s.spike, CASE WHEN b.d <= {DAY} THEN b.frame END AS frame FROM spikes s LEFT JOIN b ON s.unit = b.unit AND s.spike = b.spike")
def nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest(spikes(spark, sf_dir), track(spark, sf_dir), "unit", "ts", "frame", DAY).select("unit", "spike", F.col("hit.frame").alias("frame"))


@query("j1_discarded", f"{NEAREST} SELECT s.unit, count(*) AS n_spikes, CAST(sum(CASE WHEN b.d <= {DAY} THEN 0 ELSE 1 END) AS BIGINT) AS n_discarded FROM spikes s LEFT JOIN b ON s.unit = b.unit AND s.spike = b.spike GROUP BY s.unit")
def discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.nearest(spikes(spark, sf_dir), track(spark, sf_dir), "unit", "ts", "frame", DAY)
    return rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n_spikes"), F.sum(F.col("hit").isNull().cast("long")).alias("n_discarded"))


@query("j2_nearest_any", f"{NEAREST} SELECT unit, spike, frame FROM b")
def nearest_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.nearest(spikes(spark, sf_dir), track(spark, sf_dir), "unit", "ts", "frame").filter("hit IS NOT NULL")
    return rows.select("unit", "spike", F.col("hit.frame").alias("frame"))


@query(
    "j3_interval_of_spike",
    f"""WITH {SPIKES}, {TRACK}, f AS (SELECT unit, ts, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY unit) AS n, lead(ts) OVER w AS u FROM track WINDOW w AS (PARTITION BY unit ORDER BY ts)),
    p AS (SELECT s.unit, s.spike, s.ts, greatest(0, least(coalesce(max(CASE WHEN f.ts <= s.ts THEN f.i END), 0), max(f.n) - 2)) AS i, max(f.n) AS n FROM spikes s JOIN f ON s.unit = f.unit GROUP BY ALL)
    SELECT p.unit, p.spike, p.i FROM p JOIN f ON p.unit = f.unit AND p.i = f.i WHERE p.n >= 2 AND least(abs(p.ts - f.ts), abs(p.ts - f.u)) <= {DAY}""",
)
def interval_of_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.interval_of(spikes(spark, sf_dir), track(spark, sf_dir), "unit", "ts", "frame", DAY)
    return rows.filter("i IS NOT NULL").select("unit", "spike", F.col("i").cast("long").alias("i"))


@query("j4_next_frame", f"WITH {SPIKES}, {TRACK} SELECT s.unit, s.spike, min(t.ts) AS next_ts FROM spikes s LEFT JOIN track t ON s.unit = t.unit AND t.ts >= s.ts GROUP BY ALL")
def next_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.forward(spikes(spark, sf_dir), track(spark, sf_dir), "unit", "ts", "frame").select("unit", "spike", F.col("hit.ts").alias("next_ts"))


@query(
    "j5_epoch_speed",
    f"""WITH {TRACK}, {SPIKES}, e AS (SELECT DISTINCT unit, CAST(floor((ts - min(ts) OVER (PARTITION BY unit)) / {DAY}.0) AS BIGINT) AS epoch, min(ts) OVER (PARTITION BY unit) AS t0 FROM spikes),
    s AS (SELECT unit, epoch, t0 + epoch * {DAY} AS start FROM e),
    m AS (SELECT s.unit, s.epoch, median(t.x) AS v FROM s JOIN track t ON s.unit = t.unit AND t.ts >= s.start AND t.ts < s.start + {DAY} GROUP BY ALL),
    n AS (SELECT s.unit, s.epoch, arg_min(t.x, struct_pack(d := abs(t.ts - (s.start + {DAY} / 2)), t := t.ts)) AS v FROM s JOIN track t ON s.unit = t.unit GROUP BY ALL)
    SELECT s.unit, s.epoch, s.start, coalesce(m.v, n.v) AS x FROM s LEFT JOIN m USING (unit, epoch) LEFT JOIN n USING (unit, epoch)""",
)
def epoch_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.epochs(spikes(spark, sf_dir), "unit", "ts", DAY).withColumn("t0", F.min("ts").over(Window.partitionBy("unit")))
    spans = rows.select("unit", "epoch", (F.col("t0") + F.col("epoch") * DAY).alias("start")).distinct()
    return joins.epoch_value(spans, track(spark, sf_dir), "unit", "ts", "x", DAY).select("unit", "epoch", "start", "x")


@query("j6_band_pairs", f"WITH {SPIKES} SELECT a.unit, count(*) AS pairs, CAST(sum(abs(b.ts - a.ts)) AS BIGINT) AS total FROM spikes a JOIN spikes b ON a.unit = b.unit AND abs(b.ts - a.ts) <= {DAY} AND a.ts <> b.ts GROUP BY a.unit")
def band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.band_pairs(spikes(spark, sf_dir), "unit", "ts", DAY, []).groupBy("unit").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.abs("lag")).alias("total"))


SPANS = f"spans AS (SELECT user_id AS unit, epoch_us(ts) - {6 * HOUR} AS a, epoch_us(ts) + {6 * HOUR} AS b, event_id AS span FROM events WHERE event_type = 'purchase')"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("unit"), (at - 6 * HOUR).alias("a"), (at + 6 * HOUR).alias("b"), F.col("event_id").alias("span"))


@query("j7_spans_without_noise", f"WITH {SPIKES}, {SPANS} SELECT unit, span FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spikes p WHERE p.unit = s.unit AND p.amp > 30 AND p.ts BETWEEN s.a AND s.b)")
def spans_without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = spikes(spark, sf_dir).filter("amp > 30")
    return joins.holding(_spans(spark, sf_dir), noise, "unit", "ts", "a", "b", 12 * HOUR).select("unit", "span")


@query("j8_within_periods", f"WITH {SPIKES}, {SPANS} SELECT unit, spike FROM spikes p WHERE EXISTS (SELECT 1 FROM spans s WHERE p.unit = s.unit AND p.ts BETWEEN s.a AND s.b)")
def within_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.inside(spikes(spark, sf_dir), _spans(spark, sf_dir), "unit", "ts", "a", "b", 12 * HOUR).select("unit", "spike")


@query("j19_event_snippets", f"WITH {SPIKES}, {SPANS} SELECT s.unit, s.span, count(*) AS n, round(avg(p.amp), 6) AS mean FROM spans s JOIN spikes p ON p.unit = s.unit AND p.ts BETWEEN s.a - {HOUR} AND s.b + {HOUR} GROUP BY ALL")
def event_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.inside(spikes(spark, sf_dir), _spans(spark, sf_dir), "unit", "ts", "a", "b", 12 * HOUR, "inner", HOUR)
    return rounded(rows.groupBy("unit", "span").agg(F.count(F.lit(1)).alias("n"), F.avg("amp").alias("mean")), "mean")


@query("w1_differences", f"WITH {TRACK} SELECT unit, frame, coalesce(lead(x) OVER w - x, x - lag(x) OVER w) AS d_x, coalesce(lead(ts) OVER w - ts, ts - lag(ts) OVER w) AS d_ts FROM track WINDOW w AS (PARTITION BY unit ORDER BY ts)")
def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.differences(track(spark, sf_dir), "unit", "ts", ["x", "ts"]).select("unit", "frame", "d_x", "d_ts")


@query("w2_speed", f"WITH {TRACK} SELECT unit, frame, round(coalesce(sqrt((x - lag(x) OVER w) ^ 2 + (y - lag(y) OVER w) ^ 2) / ((ts - lag(ts) OVER w) / {HOUR}.0), 0), 6) AS speed FROM track WINDOW w AS (PARTITION BY unit ORDER BY ts)")
def speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.speed(track(spark, sf_dir), "unit", "ts", "x", "y", HOUR), "speed").select("unit", "frame", "speed")


@query(
    "w3_jump_flags",
    f"WITH {TRACK}, f AS (SELECT unit, frame, ts, coalesce(sqrt((lead(x) OVER w - x) ^ 2 + (lead(y) OVER w - y) ^ 2) / (lead(ts) OVER w - ts) > 1e-9, false) AS fast FROM track WINDOW w AS (PARTITION BY unit ORDER BY ts)) SELECT unit, frame, fast OR coalesce(lag(fast) OVER (PARTITION BY unit ORDER BY ts), false) AS jump FROM f",
)
def jump_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.jump_flags(track(spark, sf_dir), "unit", "ts", "x", "y", "ts", 1e-9).select("unit", "frame", "jump")


@query(
    "w4_interpolated",
    f"""WITH {TRACK}, g AS (SELECT unit, frame, row_number() OVER (PARTITION BY unit ORDER BY ts) AS i, CASE WHEN frame % 3 <> 0 THEN x END AS v FROM track),
    k AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS va, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ia, first_value(v IGNORE NULLS) OVER b AS vb, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ib
      FROM g WINDOW a AS (PARTITION BY unit ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY unit ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT unit, frame, round(coalesce(v, va + (vb - va) * (i - ia) / (ib - ia), va, vb), 6) AS v FROM k""",
)
def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track(spark, sf_dir).withColumn("v", F.when(F.col("frame") % 3 != 0, F.col("x")))
    return rounded(windows.interpolated(rows, "unit", "ts", "v"), "v").select("unit", "frame", "v")


@query(
    "w5_hampel",
    f"""WITH {TRACK}, m AS (SELECT unit, frame, ts, abs(x - quantile_cont(x, 0.5) OVER w) AS d FROM track WINDOW w AS (PARTITION BY unit ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
    SELECT unit, frame, d > greatest(0.5 * 1.4826 * quantile_cont(d, 0.5) OVER (PARTITION BY unit ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 2) AS outlier FROM m""",
)
def hampel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.hampel(track(spark, sf_dir), "unit", "ts", "x", 5, 0.5, 2.0).select("unit", "frame", "outlier")


@query(
    "w6_w9_box_average",
    f"""WITH {TRACE}, n AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n, first_value(v * v) OVER (PARTITION BY channel ORDER BY i) AS a, first_value(v * v) OVER (PARTITION BY channel ORDER BY i DESC) AS z FROM trace)
    SELECT channel, i, round((sum(v * v) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + greatest(0, 5 - i) * a + greatest(0, i + 6 - n) * z) / 11, 6) AS power FROM n""",
)
def box_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace(spark, sf_dir).withColumn("square", F.col("v") * F.col("v"))
    return rounded(windows.moving_average(rows, "channel", "i", "square", 5, "power"), "power").select("channel", "i", "power")


WEIGHTS = (0.1, 0.2, 0.4, 0.2, 0.1)


@query(
    "w7_w8_weighted_window",
    f"""WITH {TRACE}, e AS (SELECT *, first_value(v) OVER (PARTITION BY channel ORDER BY i) AS a, first_value(v) OVER (PARTITION BY channel ORDER BY i DESC) AS z FROM trace)
    SELECT channel, i, round(0.1::DOUBLE * coalesce(lag(v, 2) OVER w, a) + 0.2::DOUBLE * coalesce(lag(v, 1) OVER w, a) + 0.4::DOUBLE * v + 0.2::DOUBLE * coalesce(lead(v, 1) OVER w, z) + 0.1::DOUBLE * coalesce(lead(v, 2) OVER w, z), 6) AS smooth FROM e WINDOW w AS (PARTITION BY channel ORDER BY i)""",
)
def weighted_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.weighted(trace(spark, sf_dir), "channel", "i", "v", list(WEIGHTS), "smooth"), "smooth").select("channel", "i", "smooth")


RUNS = f"""{TRACE}, u AS (SELECT *, v > 20 AS up, lag(v > 20) OVER w AS was, lead(v > 20) OVER w AS will FROM trace WINDOW w AS (PARTITION BY channel ORDER BY i)),
    r AS (SELECT *, sum(CASE WHEN up AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY i) AS run FROM u),
    islands AS (SELECT channel, min(i) - 1 AS start, max(i) AS stop FROM r WHERE up GROUP BY channel, run HAVING min(i) > 0 AND NOT bool_or(will IS NULL))"""
MERGED = """g AS (SELECT *, CASE WHEN start - max(stop) OVER (PARTITION BY channel ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 3 THEN 0 ELSE 1 END AS new FROM islands),
    h AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY start, stop) AS grp FROM g), merged AS (SELECT channel, min(start) AS start, max(stop) AS stop FROM h GROUP BY channel, grp)"""


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.islands(trace(spark, sf_dir), "channel", "i", F.col("v") > 20)


@query("w10_islands", f"WITH {RUNS} SELECT channel, start, stop FROM islands")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _islands(spark, sf_dir)


@query("w11_merged_islands", f"WITH {RUNS}, {MERGED} SELECT channel, start, stop FROM merged")
def merged_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.merged(_islands(spark, sf_dir), "channel", 3)


@query(
    "w12_w13_event_peaks",
    f"""WITH {RUNS}, {MERGED} SELECT m.channel, m.start, m.stop, max(t.v) AS peak, arg_min(t.i, struct_pack(v := t.v, i := t.i)) AS trough FROM merged m JOIN trace t ON t.channel = m.channel AND t.i BETWEEN m.start AND m.stop
    WHERE m.stop - m.start BETWEEN 2 AND 12 GROUP BY ALL HAVING max(t.v) > 40""",
)
def event_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = windows.merged(_islands(spark, sf_dir), "channel", 3).filter("stop - start BETWEEN 2 AND 12")
    rows = joins.inside(trace(spark, sf_dir), spans, "channel", "i", "start", "stop", 16, "inner")
    out = rows.groupBy("channel", "start", "stop").agg(F.max("v").alias("peak"), F.min_by("i", F.struct("v", "i")).alias("trough"))
    return out.filter("peak > 40")


@query(
    "a38_event_statistics",
    f"""WITH {RUNS}, {MERGED}, d AS (SELECT channel, stop - start AS d, start - lag(stop) OVER (PARTITION BY channel ORDER BY start) AS gap FROM merged)
    SELECT channel, count(*) AS n, round(avg(d), 6) AS mean, median(d) AS middle, round(avg(gap), 6) AS gap FROM d GROUP BY channel""",
)
def event_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = windows.merged(_islands(spark, sf_dir), "channel", 3)
    rows = spans.withColumns({"d": F.col("stop") - F.col("start"), "gap": F.col("start") - F.lag("stop").over(Window.partitionBy("channel").orderBy("start"))})
    return rounded(rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.percentile("d", F.lit(0.5)).alias("middle"), F.avg("gap").alias("gap")), "mean", "gap")


@query(
    "w16_adjusted_p",
    f"""WITH {SPIKES}, p AS (SELECT unit, CASE WHEN unit % 7 <> 0 THEN (avg(amp) - floor(avg(amp))) / 4 END AS p FROM spikes GROUP BY unit), q AS (SELECT *, p * count(p) OVER () / row_number() OVER (ORDER BY p NULLS LAST) AS q FROM p)
    SELECT unit, round(p, 9) AS p, round(CASE WHEN p IS NOT NULL THEN least(1, min(q) OVER (ORDER BY p NULLS LAST, unit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END, 6) AS p_adj FROM q""",
)
def adjusted_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.avg("amp")
    rows = spikes(spark, sf_dir).groupBy("unit").agg(((mean - F.floor(mean)) / 4).alias("p")).withColumn("p", F.when(F.col("unit") % 7 != 0, F.col("p")))
    return rounded(rounded(windows.adjusted_p(rows, "p"), "p_adj"), "p", digits=9).select("unit", "p", "p_adj")


@query(
    "w17_sliding_mean",
    f"WITH {TRACE}, m AS (SELECT channel, i, avg(v) OVER w AS mean, bool_and(v < 60) OVER w AS all_good, count(*) OVER w AS n FROM trace WINDOW w AS (PARTITION BY channel ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT channel, i, round(mean, 6) AS mean, all_good FROM m WHERE n = 5",
)
def sliding_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.sliding_mean(trace(spark, sf_dir).withColumn("good", F.col("v") < 60), "channel", "i", "v", 5, "good")
    return rounded(rows, "mean").select("channel", "i", "mean", "all_good")


@query("w18_circular_shift", f"WITH {TRACE}, n AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM trace) SELECT a.channel, a.i, a.v, b.v AS shifted FROM n a JOIN n b ON a.channel = b.channel AND a.i = (b.i + 7) % b.n")
def circular_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rolled(trace(spark, sf_dir), "channel", "i", "v", 7, "shifted").select("channel", "i", "v", "shifted")


DIRECTION = "step AS (SELECT *, degrees(atan2(lead(y) OVER w - y, lead(x) OVER w - x)) AS a FROM track WINDOW w AS (PARTITION BY unit ORDER BY ts)), d AS (SELECT unit, frame, round_even(CASE WHEN a < 0 THEN a + 360 ELSE a END, 0) % 360 AS direction FROM step WHERE a IS NOT NULL)"


@query("n35_direction", f"WITH {TRACK}, {DIRECTION} SELECT unit, frame, direction FROM d")
def direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.direction(track(spark, sf_dir), "unit", "ts", "x", "y").filter("direction IS NOT NULL").select("unit", "frame", "direction")


@query(
    "a33_w19_directional_rate",
    f"""WITH {TRACK}, {DIRECTION}, s AS (SELECT CAST(ceil(CASE WHEN direction = 0 THEN 360 ELSE direction END / 6) AS BIGINT) AS sector, count(*) AS n, CAST(sum(frame % 2) AS BIGINT) AS hits FROM d GROUP BY 1),
    r AS (SELECT sector, n, hits, hits / (n / 30.0::DOUBLE) AS rate FROM s) SELECT a.sector, a.n, a.hits, round(a.rate, 6) AS rate, round(avg(b.rate), 6) AS smooth FROM r a JOIN r b ON (a.sector - b.sector + 60) % 60 IN (0, 1, 59) GROUP BY ALL""",
)
def directional_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = maps.directional(maps.direction(track(spark, sf_dir), "unit", "ts", "x", "y").filter("direction IS NOT NULL"), "unit", F.col("direction"))
    rates = rows.groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("frame") % 2).alias("hits")).withColumn("rate", F.col("hits") / (F.col("n") / 30.0))
    around = rates.select(F.explode(F.array(*[(F.pmod(F.col("sector") - 1 + d, F.lit(60)) + 1) for d in (-1, 0, 1)])).alias("sector"), F.col("rate").alias("r"))
    return rounded(rates.join(around.groupBy("sector").agg(F.avg("r").alias("smooth")), "sector"), "rate", "smooth")
