"""Queries of the kernels; those that SQL can't express are held against other definitions in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins, kernels, maps, table_functions
from ..operators.ripples import ripples as find_ripples
from .field_queries import _p_sql
from .proxies import HOUR, SPIKES, TRACE, TRACK, grid, grid_sql, query, read, rounded, spikes, trace, track


#: The band of 4 to 12 Hz at 40 Hz: 101 taps, their unit gain at 8 Hz, and the mean square of 11 filtered samples.
RIPPLES = f"""WITH {TRACE}, raw AS (SELECT t, (2 * 12 / 40.0::DOUBLE * CASE WHEN t = 0 THEN 1 ELSE sin(pi() * 0.6 * t) / (pi() * 0.6 * t) END - 2 * 4 / 40.0::DOUBLE * CASE WHEN t = 0 THEN 1 ELSE sin(pi() * 0.2 * t) / (pi() * 0.2 * t) END) * (0.54 - 0.46 * cos(2 * pi() * (t + 50) / 100)) AS h FROM (SELECT unnest(range(-50, 51)) AS t)),
    taps AS (SELECT t, h / (SELECT sqrt(sum(h * cos(2 * pi() * 8 * t / 40)) ^ 2 + sum(h * sin(2 * pi() * 8 * t / 40)) ^ 2) FROM raw) AS h FROM raw),
    f AS (SELECT a.channel, a.i, sum(h * b.v) AS v FROM trace a JOIN trace b ON a.channel = b.channel JOIN taps ON t = a.i - b.i GROUP BY a.channel, a.i), ends AS (SELECT channel, max(i) AS last FROM f GROUP BY channel),
    p AS (SELECT f.channel, f.i, any_value(f.v) AS v, sum(o.v * o.v) / 11 AS power FROM f JOIN ends USING (channel) JOIN (SELECT unnest(range(-5, 6)) AS k) ON true JOIN f o ON o.channel = f.channel AND o.i = greatest(0, least(last, f.i + k)) GROUP BY f.channel, f.i),
    s AS (SELECT *, (power - avg(power) OVER c) / CASE WHEN stddev_pop(power) OVER c = 0 THEN 1 ELSE stddev_pop(power) OVER c END AS nss FROM p WINDOW c AS (PARTITION BY channel)),
    u AS (SELECT *, nss > 0.5 AS up, lag(nss > 0.5) OVER w AS was, lead(nss > 0.5) OVER w AS will FROM s WINDOW w AS (PARTITION BY channel ORDER BY i)), g AS (SELECT *, sum(CASE WHEN up AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY i) AS run FROM u),
    runs AS (SELECT channel, min(i) - 1 AS start, max(i) AS stop, bool_or(was IS NULL OR will IS NULL) AS open FROM g WHERE up GROUP BY channel, run), m AS (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY channel ORDER BY start) < 4 THEN 0 ELSE 1 END AS new FROM runs WHERE NOT open),
    spans AS (SELECT channel, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY start) AS g FROM m) GROUP BY channel, g),
    r AS (SELECT s.channel, start, stop, max(nss) AS power, arg_min(i, struct_pack(v := v, i := i)) AS spot FROM spans JOIN s ON s.channel = spans.channel AND s.i BETWEEN start AND stop GROUP BY ALL)"""


RIPPLES += " SELECT channel, round(start / 40.0::DOUBLE, 6) AS start_time, round(stop / 40.0::DOUBLE, 6) AS end_time, round(spot / 40.0::DOUBLE, 6) AS peak_time, round(power, 6) AS peak_normed_power, round((stop - start) / 40.0::DOUBLE * 1000, 6) AS duration_ms FROM r WHERE power > 1 AND (stop - start) / 40.0::DOUBLE BETWEEN 0.05 AND 2"


@query("n1_ripples", RIPPLES)
def ripples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as a trace at 40 Hz, with bounds to match."""
    found = find_ripples(trace(spark, sf_dir), "channel", "i", "v", 40.0, 4.0, 12.0, 0.5, 1.0, 0.1, 0.05, 2.0)
    return rounded(found, "start_time", "end_time", "peak_time", "peak_normed_power", "duration_ms")


@query("n1_ripples_from_sql", RIPPLES)
def ripples_from_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the table function."""
    table_functions.register(spark)
    trace(spark, sf_dir).createOrReplaceTempView("trace_of_users")
    found = spark.sql("SELECT * FROM find_ripples(TABLE(trace_of_users), key => 'channel', at => 'i', value => 'v', fs => 40.0, low => 4.0, high => 12.0, onset => 0.5, peak => 1.0, gap => 0.1, shortest => 0.05, longest => 2.0)")
    return rounded(found, "start_time", "end_time", "peak_time", "peak_normed_power", "duration_ms")


def _zero_phase_sql(name: str, source: str, gain: str, fs: int = 16) -> str:
    """Tables that filter (channel, i, v) by a squared gain of f (Hz, of fs): odd padding by two seconds, then a circular
    sum with the gain's inverse transform, for each padded length."""
    return f"""{name}_l AS (SELECT channel, CAST(count(*) AS BIGINT) AS len, CAST(least(count(*) - 1, {2 * fs}) AS BIGINT) AS pad FROM {source} GROUP BY channel),
    {name}_y AS (SELECT p.channel, p.j, CASE WHEN p.j < pad THEN 2 * a.v - x.v WHEN p.j >= pad + len THEN 2 * b.v - x.v ELSE x.v END AS v FROM (SELECT *, unnest(range(len + 2 * pad)) AS j FROM {name}_l) p
      JOIN {source} x ON x.channel = p.channel AND x.i = CASE WHEN p.j < pad THEN pad - p.j WHEN p.j >= pad + len THEN 2 * (len - 1) - (p.j - pad) ELSE p.j - pad END JOIN {source} a ON a.channel = p.channel AND a.i = 0 JOIN {source} b ON b.channel = p.channel AND b.i = len - 1),
    {name}_f AS (SELECT n, k, least(k, n - k) * {fs}.0::DOUBLE / n AS f FROM (SELECT n, unnest(range(n)) AS k FROM (SELECT DISTINCT len + 2 * pad AS n FROM {name}_l))), {name}_g AS (SELECT n, k, {gain} AS g FROM {name}_f),
    {name}_h AS (SELECT n, m, sum(g * cos(2 * pi() * (k * m % n) / n)) / n AS h FROM {name}_g JOIN (SELECT unnest(range((SELECT max(n) FROM {name}_g))) AS m) ON m < n GROUP BY n, m),
    {name} AS (SELECT o.channel, o.i, sum(y.v * h.h) AS v FROM (SELECT channel, pad, len + 2 * pad AS n, unnest(range(len)) AS i FROM {name}_l) o JOIN {name}_y y ON y.channel = o.channel JOIN {name}_h h ON h.n = o.n AND h.m = (o.i + o.pad - y.j + o.n) % o.n GROUP BY o.channel, o.i)"""


def _butterworth_sql(low: float, high: float, fs: float) -> str:
    """The squared gain of a band-pass of degree 4 at f, in bilinear frequencies; nothing passes at 0."""
    w, a, b = f"tan(pi() * least(f, {fs / 2} * (1 - 1e-9)) / {fs})", f"tan(pi() * {low} / {fs})", f"tan(pi() * {high} / {fs})"
    return f"CASE WHEN k = 0 THEN 0 ELSE 1 / (1 + pow(({w} * {w} - {a} * {b}) / ({w} * ({b} - {a})), 8)) END"


#: The resampling filter is a sinc under a Kaiser window, whose Bessel function is a series; then the band, the notch, and
#: densities of epochs of 16 samples.
SPECTRUM = f"""WITH {TRACE}, bessel AS (SELECT t, sum(exp(2 * (k * ln(greatest(2.5 * sqrt(greatest(0, 1 - (t / 20.0::DOUBLE) ^ 2)), 1e-300)) - lgamma(k + 1.0::DOUBLE)))) AS w FROM (SELECT unnest(range(-20, 21)) AS t), (SELECT unnest(range(60)) AS k) GROUP BY t),
    raw AS (SELECT t, w * CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t / 2) / (pi() * t / 2) END AS h FROM bessel), taps AS (SELECT t, h / (SELECT sum(h) FROM raw) AS h FROM raw),
    low AS (SELECT a.channel, CAST(a.i // 2 AS BIGINT) AS i, sum(h * b.v) AS v FROM trace a JOIN trace b ON a.channel = b.channel JOIN taps ON t = a.i - b.i WHERE a.i % 2 = 0 GROUP BY a.channel, a.i),
    {_zero_phase_sql("band", "low", _butterworth_sql(1, 7, 16))},
    {_zero_phase_sql("clear", "band", "(pow(1 - 2 * cos(pi() * 10 / 16) * cos(pi() * f / 8) + cos(pi() * f / 4), 2) + pow(2 * cos(pi() * 10 / 16) * sin(pi() * f / 8) - sin(pi() * f / 4), 2)) / (pow(1 + tan(pi() / 96) - 2 * cos(pi() * 10 / 16) * cos(pi() * f / 8) + (1 - tan(pi() / 96)) * cos(pi() * f / 4), 2) + pow(2 * cos(pi() * 10 / 16) * sin(pi() * f / 8) - (1 - tan(pi() / 96)) * sin(pi() * f / 4), 2))")},
    e AS (SELECT c.channel, CAST(i // 16 AS BIGINT) AS epoch, i % 16 AS j, v FROM clear c JOIN clear_l USING (channel) WHERE i // 16 < len // 16), d AS (SELECT *, v - avg(v) OVER (PARTITION BY channel, epoch) AS d, 0.5 - 0.5 * cos(2 * pi() * j / 16) AS w FROM e)"""


@query("n2_n3_n5_spectra", f"{SPECTRUM} SELECT channel, epoch, CAST(k AS INT) AS k, round(CASE WHEN k BETWEEN 1 AND 7 THEN 2 ELSE 1 END * (sum(w * d * cos(2 * pi() * j * k / 16)) ^ 2 + sum(w * d * sin(2 * pi() * j * k / 16)) ^ 2) / (16 * sum(w * w)), 6) AS power FROM d, (SELECT unnest(range(9)) AS k) GROUP BY channel, epoch, k")
def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kernels.spectra(trace(spark, sf_dir), "channel", "i", "v", 32.0, 1.0, notches=(5.0,), down=2, band=(1.0, 7.0))
    return rounded(rows.select("channel", "epoch", F.posexplode("power").alias("k", "power")), "power")


@query(
    "n7_hand_rolled_spectra",
    f"""WITH {TRACE}, n AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM trace), e AS (SELECT channel, CAST(i // 16 AS BIGINT) AS epoch, i % 16 AS j, v FROM n WHERE i // 16 < n // 16), l AS (SELECT channel, epoch, regr_slope(v, j) AS a, regr_intercept(v, j) AS b FROM e GROUP BY ALL),
    d AS (SELECT channel, epoch, j, (v - a * j - b) * w AS v, w FROM e JOIN l USING (channel, epoch) JOIN (SELECT unnest(range(16)) AS j, 0.5 - 0.5 * cos(2 * pi() * unnest(range(16)) / 15) AS w) USING (j))
    SELECT channel, epoch, CAST(k AS INT) AS k, round(CASE WHEN k BETWEEN 1 AND 7 THEN 2 ELSE 1 END * (sum(v * cos(2 * pi() * j * k / 16)) ^ 2 + sum(v * sin(2 * pi() * j * k / 16)) ^ 2) / (16 * sum(w * w)), 6) AS power FROM d, (SELECT unnest(range(9)) AS k) GROUP BY channel, epoch, k""",
)
def hand_rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kernels.spectra(trace(spark, sf_dir), "channel", "i", "v", 16.0, 1.0, hand_rolled=True)
    return rounded(rows.select("channel", "epoch", F.posexplode("power").alias("k", "power")), "power")


@query("n11_parameterised_spectra")
def parameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's sales by the day of the year as a spectrum of 100 frequencies."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file"), (F.dayofyear("l_shipdate") % 100 + 1).cast("double").alias("freq")).agg(F.sum("l_quantity").alias("power"))
    pairs = F.array_sort(F.collect_list(F.struct("freq", (F.col("power") / F.col("freq")).alias("power"))))
    rows = rows.groupBy("file").agg(pairs.alias("pairs")).select("file", F.col("pairs.freq").alias("freqs"), F.col("pairs.power").alias("power"))
    found = kernels.parameterised(rows, ["file"], knee=False)
    return rounded(found.withColumn("peaks", F.size("peaks").cast("long")), "offset", "knee", "exponent", "r_squared", "error", digits=3)


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with bins of 10, an hour each, and spikes by their nearest frame."""
    frames = maps.binned_open(track(spark, sf_dir), "x", "y", 10.0).withColumn("i", F.row_number().over(Window.partitionBy("unit").orderBy("ts")) - 1)
    near = joins.nearest(spikes(spark, sf_dir), frames, "unit", "ts", "frame", 48 * HOUR).filter("hit IS NOT NULL").select("unit", "hit.i")
    counts = near.groupBy("unit", "i").agg(F.count(F.lit(1)).cast("double").alias("n"))
    frames = frames.join(counts, ["unit", "i"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    ordered = F.array_sort(F.collect_list(F.struct("i", (F.col("bx") * 6 + F.col("by_")).alias("bin"), F.col("x"), "n")))
    sessions = frames.groupBy("unit").agg(ordered.alias("f"))
    sessions = sessions.select("unit", F.col("f.bin").alias("bins"), F.transform("f", lambda p: F.lit(1.0)).alias("occ"), F.col("f.x").alias("speed"), F.col("f.n").alias("n"))
    fired = near.groupBy("unit").agg(F.array_sort(F.collect_list("i")).alias("spikes"))
    return sessions.join(fired, "unit")


@query("n22_shuffled_information")
def shuffled_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kernels.shuffled_information(_units(spark, sf_dir), ["unit"], 8, 6, 1.0, margin=2.0)
    return rounded(found, "sir", "null_mean", "null_p95")


@query("n23_cluster_null")
def cluster_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight features of all vectors, 500 to a file."""
    rows = read(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 500).alias("file")).agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("label").cast("long").alias("label"), F.slice("embedding", 1, 8).cast("array<double>").alias("x")))).alias("r"))
    found = kernels.cluster_null(rows.select("file", F.col("r.label").alias("labels"), F.col("r.x").alias("points")), "file", 8)
    return rounded(found, "l_ratio", "iso", *[f"{c}_{m}" for c in ("null", "sd", "p", "z") for m in ("l", "iso")], digits=4)


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = maps.smoothed(grid(spark, sf_dir, ["half"]), ["half"])
    packed = bins.groupBy("half").agg(F.array_sort(F.collect_list(F.struct("bx", "by_", "smooth", "valid"))).alias("b"))
    return packed.select("half", F.col("b.bx").alias("bx"), F.col("b.by_").alias("by_"), F.col("b.smooth").alias("rate"), F.col("b.valid").alias("valid"))


#: Place fields of the two halves' smoothed maps (bins as x * 11 + y). N24 is a walk: the highest free bin and threshold, its
#: neighbours step by step until none is new, then the next. N26 is the components of what is high enough.
FIELDS = f"""WITH RECURSIVE {grid_sql("half")}, sm AS (SELECT g.half, g.bx, g.by_, sum(o.rate * (2 - abs(g.bx - o.bx)) * (2 - abs(g.by_ - o.by_))) / sum((2 - abs(g.bx - o.bx)) * (2 - abs(g.by_ - o.by_))) AS r FROM grid g JOIN grid o ON g.half = o.half AND abs(g.bx - o.bx) <= 1 AND abs(g.by_ - o.by_) <= 1 AND o.valid WHERE g.valid GROUP BY g.half, g.bx, g.by_),
    b AS (SELECT half, CAST(bx * 11 + by_ AS BIGINT) AS b, bx, by_, r FROM sm), full_map AS (SELECT h.half, list(coalesce(b.r, 0) ORDER BY i) AS rates FROM (SELECT half, unnest(range(286)) AS i FROM (SELECT DISTINCT half FROM b) t(half)) h LEFT JOIN b ON b.half = h.half AND b.b = h.i GROUP BY h.half),
    free AS (SELECT half, list(b ORDER BY r DESC, b) FILTER (r > 0) AS free, count(*) AS n FROM b GROUP BY half),
    walk(half, rule, share, least, rates, free, mask, fresh, floor_, step) AS (
      SELECT half, rule, share, least * n, rates, free, []::BIGINT[], []::BIGINT[], 0.0::DOUBLE, 0 FROM full_map JOIN free USING (half), (VALUES ('n24_steep', 0.95::DOUBLE, 0.02::DOUBLE), ('n24', 0.2::DOUBLE, 0.04::DOUBLE)) t(rule, share, least)
      UNION ALL SELECT half, rule, share, least, rates, CASE WHEN closed THEN rest ELSE free END, CASE WHEN closed THEN [rest[1]] ELSE list_concat(mask, new) END, CASE WHEN closed THEN [rest[1]] ELSE new END, CASE WHEN closed THEN share * rates[rest[1] + 1] ELSE floor_ END, step + 1
      FROM (SELECT *, len(fresh) = 0 AS closed, list_filter(free, lambda x: NOT list_contains(mask, x)) AS rest,
        list_filter(free, lambda x: rates[x + 1] >= floor_ AND NOT list_contains(mask, x) AND coalesce(list_bool_or(list_transform(fresh, lambda y: abs(x // 11 - y // 11) <= 1 AND abs(x % 11 - y % 11) <= 1)), false)) AS new FROM walk)
      WHERE NOT closed OR len(rest) > 0),
    kept AS (SELECT half, rule, CAST(row_number() OVER (PARTITION BY half, rule ORDER BY step) - 1 AS BIGINT) AS field, mask FROM walk WHERE len(fresh) = 0 AND len(mask) > 0 AND len(mask) >= least),
    hi AS (SELECT b.* FROM b JOIN (SELECT half, max(r) AS top FROM b GROUP BY half) t USING (half) WHERE r > top / 2.5 AND EXISTS (SELECT 1 FROM b o WHERE o.half = b.half AND abs(o.bx - b.bx) + abs(o.by_ - b.by_) = 1 AND o.r > 0)),
    reach(half, a, z) AS (SELECT half, b, b FROM hi UNION SELECT r.half, r.a, o.b FROM reach r JOIN hi m ON m.half = r.half AND m.b = r.z JOIN hi o ON o.half = m.half AND abs(o.bx - m.bx) + abs(o.by_ - m.by_) = 1),
    comp AS (SELECT r.half, r.z AS b, min((r.a % 11) * 100 + r.a // 11) AS c FROM reach r GROUP BY r.half, r.z), solid AS (SELECT h.half, h.b FROM hi h JOIN hi o ON o.half = h.half AND o.bx - h.bx BETWEEN 0 AND 2 AND o.by_ - h.by_ BETWEEN 0 AND 2 WHERE h.bx <= 22 AND h.by_ <= 7 GROUP BY h.half, h.b HAVING count(*) = 9),
    big AS (SELECT comp.half, c, count(*) AS n FROM comp LEFT JOIN solid ON solid.half = comp.half AND solid.b = comp.b GROUP BY comp.half, c HAVING count(*) >= 9 AND count(solid.b) > 0 QUALIFY row_number() OVER (PARTITION BY comp.half ORDER BY count(*) DESC, c) = 1),
    own AS (SELECT half, rule, field, unnest(mask) AS b FROM kept UNION ALL SELECT half, 'n26', 0, b FROM comp JOIN big USING (half, c))"""


@query("n24_n26_place_fields", f"{FIELDS} SELECT half, rule, field, count(*) AS n_bins, round(max(r), 4) AS peak, round(sum(bx * r) / sum(r), 4) AS cx, round(sum(by_ * r) / sum(r), 4) AS cy FROM own JOIN b USING (half, b) GROUP BY half, rule, field")
def place_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields by N24 with a share to match these maps, by N24 as in the reference, and the one field of N26."""
    rows, two = _maps(spark, sf_dir), ["half"]
    found = [
        kernels.place_fields(rows, two, 26, 11, share=0.95, smallest=0.02).withColumn("rule", F.lit("n24_steep")),
        kernels.place_fields(rows, two, 26, 11, share=0.2, smallest=0.04).withColumn("rule", F.lit("n24")),
        kernels.place_fields(rows, two, 26, 11, rule=kernels.largest_field).withColumn("rule", F.lit("n26")),
    ]
    return rounded(found[0].unionByName(found[1]).unionByName(found[2]), "peak", "cx", "cy", digits=4)


@query("n28_n29_speed_modulation")
def speed_modulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With nulls of rolled rates (N28), and of rolled counts that are smoothed anew (N29)."""
    units = _units(spark, sf_dir)
    rates, counts = (kernels.speed_modulation(units, ["unit"], 4.0, margin=0.5, width=10.0, counts=c).withColumn("null", F.lit(n)) for n, c in (("rates", False), ("counts", True)))
    found = rates.unionByName(counts)
    return rounded(found, *[c for c in found.columns if c not in ("unit", "modulated", "null", "n_null")], digits=4)


#: Positions and spikes in hours; counts in steps of 24, reflected at both ends by 6 and averaged over 3, forth and back.
GRIDDED = f"""WITH {TRACK}, {SPIKES}, f AS (SELECT unit, row_number() OVER w - 1 AS i, x, y, ts / {HOUR}.0::DOUBLE AS t FROM track WINDOW w AS (PARTITION BY unit ORDER BY ts, frame)), q AS (SELECT unit, ts / {HOUR}.0::DOUBLE AS t FROM spikes),
    b AS (SELECT unit, min(t) AS t0, max(t) AS t1, count(*) AS m FROM f GROUP BY unit HAVING unit IN (SELECT unit FROM q)), n AS (SELECT b.*, CAST(floor((t1 - t0) / 24 + 1e-9) + 1 AS BIGINT) AS len, (SELECT count(*) FROM q WHERE q.unit = b.unit) AS fired FROM b),
    c AS (SELECT n.unit, CAST(floor((q.t - t0) / 24) AS BIGINT) AS j, count(*) AS c FROM n JOIN q ON q.unit = n.unit WHERE q.t >= t0 AND (q.t < t0 + (len - 1) * 24 OR q.t = t0 + (len - 1) * 24) GROUP BY ALL),
    r AS (SELECT g.unit, g.j, coalesce(c, 0) * (1000 / 24.0::DOUBLE) AS v FROM (SELECT unit, unnest(range(len)) AS j FROM n) g LEFT JOIN c ON c.unit = g.unit AND c.j = g.j), p AS (SELECT unit, len, CASE WHEN len > 6 THEN 6 ELSE 0 END AS pad FROM n),
    z AS (SELECT o.unit, o.k, CASE WHEN k < pad THEN 2 * a.v - x.v WHEN k >= pad + len THEN 2 * e.v - x.v ELSE x.v END AS v FROM (SELECT *, unnest(range(len + 2 * pad)) AS k FROM p) o JOIN r x ON x.unit = o.unit AND x.j = CASE WHEN k < pad THEN pad - k WHEN k >= pad + len THEN 2 * (len - 1) - (k - pad) ELSE k - pad END JOIN r a ON a.unit = o.unit AND a.j = 0 JOIN r e ON e.unit = o.unit AND e.j = len - 1),
    f1 AS (SELECT z.unit, z.k, sum(o.v) / 3 AS v FROM z, (SELECT unnest([0, 1, 2]) AS d) JOIN z o ON o.unit = z.unit AND o.k = greatest(0, z.k - d) GROUP BY z.unit, z.k),
    f2 AS (SELECT a.unit, a.k, sum(o.v) / 3 AS v FROM (SELECT f1.*, len + 2 * pad - 1 AS last FROM f1 JOIN p USING (unit)) a, (SELECT unnest([0, 1, 2]) AS d) JOIN f1 o ON o.unit = a.unit AND o.k = least(last, a.k + d) GROUP BY a.unit, a.k),
    rate AS (SELECT p.unit, r.j AS i, CASE WHEN pad > 0 THEN f2.v ELSE r.v END AS v FROM p JOIN r ON r.unit = p.unit LEFT JOIN f2 ON f2.unit = p.unit AND f2.k = r.j + pad),
    step AS (SELECT unit, i, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) * (1000 / 24.0::DOUBLE) AS s FROM f WINDOW w AS (PARTITION BY unit ORDER BY i)), speed AS (SELECT unit, i, coalesce(s, lag(s) OVER (PARTITION BY unit ORDER BY i)) AS s FROM step),
    v AS (SELECT speed.unit, s, rate.v, CAST(floor((s - 100) / 200) AS BIGINT) AS bin FROM speed JOIN rate ON rate.unit = speed.unit AND rate.i = speed.i JOIN n ON n.unit = speed.unit WHERE speed.i < fired AND n.m >= 2 AND s > 100 AND s < 3000),
    whole AS (SELECT unit, corr(s, v) AS raw_r, count(*) AS c FROM v GROUP BY unit HAVING count(*) >= 2 AND stddev_pop(s) > 0 AND stddev_pop(v) > 1e-12), bins AS (SELECT v.unit, 100 + (bin + 0.5) * 200.0::DOUBLE AS x, avg(v) AS y FROM v JOIN whole ON whole.unit = v.unit GROUP BY v.unit, bin, c HAVING count(*) >= 0.01 * c),
    fit AS (SELECT unit, count(*) AS n, CASE WHEN count(*) > 2 THEN regr_slope(y, x) END AS slope, CASE WHEN count(*) > 2 THEN regr_intercept(y, x) END AS intercept, CASE WHEN count(*) > 2 AND stddev_pop(y) > 1e-12 THEN corr(x, y) END AS r FROM bins GROUP BY unit)"""


def _lines_sql(mode: str, x: str, weight: str) -> str:
    """The line of the bins' mean rates on their middles, by weighted sums, and Spearman's rho; bins of 10 from 1 to 90."""
    return f"""{mode}_v AS (SELECT unit, CAST(least(8, floor(({x} - 1) / 10)) AS BIGINT) AS b, rate FROM smooth WHERE {x} > 1 AND {x} < 90),
    {mode}_b AS (SELECT unit, 1 + (b + 0.5) * 10.0::DOUBLE AS x, avg(rate) AS y, {weight}::DOUBLE AS w FROM {mode}_v v GROUP BY unit, b HAVING count(*) >= 0.002 * (SELECT count(*) FROM {mode}_v o WHERE o.unit = v.unit)),
    {mode}_s AS (SELECT unit, count(*) AS n, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy, sum(w * y * y) AS yy, count(DISTINCT y) AS kinds FROM {mode}_b GROUP BY unit HAVING count(*) >= 3),
    {mode}_r AS (SELECT unit, rank() OVER (PARTITION BY unit ORDER BY x) AS a, rank() OVER (PARTITION BY unit ORDER BY round(y, 9)) + (count(*) OVER (PARTITION BY unit, round(y, 9)) - 1) / 2.0 AS b FROM {mode}_b),
    {mode}_q AS (SELECT unit, n, (w * xy - x * y) / (w * xx - x * x) AS slope, (y - (w * xy - x * y) / (w * xx - x * x) * x) / w AS intercept, CASE WHEN kinds > 1 THEN (w * xy - x * y) / sqrt((w * xx - x * x) * (w * yy - y * y)) END AS r FROM {mode}_s)"""


#: Frames with the spikes nearest to them, within 48 hours; a Gaussian of 1.2 frames over five on either side, for rates and,
#: in the first mode, for speeds.
LINES = f"""WITH {SPIKES}, {TRACK}, d AS (SELECT s.unit, s.spike, t.frame, abs(s.ts - t.ts) AS d, t.ts AS tt FROM spikes s JOIN track t ON s.unit = t.unit), near AS (SELECT unit, spike, arg_min(frame, struct_pack(d := d, t := tt)) AS frame FROM d GROUP BY unit, spike HAVING min(d) <= {48 * HOUR}),
    c AS (SELECT unit, frame, count(*) AS n FROM near GROUP BY unit, frame), f AS (SELECT t.unit, row_number() OVER (PARTITION BY t.unit ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY t.unit) AS len, x, coalesce(c.n, 0) * 4.0::DOUBLE AS rate FROM track t LEFT JOIN c ON c.unit = t.unit AND c.frame = t.frame WHERE t.unit IN (SELECT unit FROM near)),
    bell AS (SELECT k, exp(-k * k / 2.88::DOUBLE) / (SELECT sum(exp(-z * z / 2.88::DOUBLE)) FROM (SELECT unnest(range(-5, 6)) AS z)) AS w FROM (SELECT unnest(range(-5, 6)) AS k)),
    smooth AS (SELECT f.unit, f.i, any_value(f.x) AS x, sum(w * o.x) AS sx, sum(w * o.rate) AS rate FROM f, bell JOIN f o ON o.unit = f.unit AND o.i = greatest(0, least(f.len - 1, f.i + k)) GROUP BY f.unit, f.i),
    {_lines_sql("rates", "sx", "count(*)")}, {_lines_sql("counts", "x", "1")}"""


def _line_of(mode: str) -> str:
    return f"""SELECT u.unit, '{mode}' AS mode, round(slope, 5) AS slope, round(intercept, 5) AS intercept, round(q.r, 5) AS r, round(({_p_sql('q.r', 'q.n')})::DOUBLE, 5) AS p, round(CASE WHEN q.r IS NOT NULL THEN (SELECT corr(a, b) FROM {mode}_r o WHERE o.unit = u.unit) END, 5) AS rho
    FROM (SELECT DISTINCT unit FROM f) u LEFT JOIN {mode}_q q ON q.unit = u.unit"""


@query("n28_n29_speed_lines", f"{LINES} {_line_of('rates')} UNION ALL {_line_of('counts')}")
def speed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of both modes isn't drawn at random."""
    units = _units(spark, sf_dir)
    found = [kernels.speed_modulation(units, ["unit"], 4.0, draws=0, width=10.0, counts=c).withColumn("mode", F.lit(n)) for n, c in (("rates", False), ("counts", True))]
    found = found[0].unionByName(found[1]).select("unit", "mode", "slope", "intercept", "r", "p", "rho")
    return rounded(found, "slope", "intercept", "r", "p", "rho", digits=5)


@query("n30_gridded_speed", f"{GRIDDED} SELECT n.unit, round(raw_r, 4) AS raw_r, fit.n AS n_bins, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(r, 4) AS r, round(({_p_sql('r', 'fit.n')})::DOUBLE, 4) AS p FROM n LEFT JOIN whole ON whole.unit = n.unit LEFT JOIN fit ON fit.unit = n.unit")
def gridded_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours stand for milliseconds, with a step of 24 and speeds to match."""
    frames = track(spark, sf_dir).groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("ts", "frame", "x", "y"))).alias("f"))
    frames = frames.select("unit", F.col("f.x").alias("x"), F.col("f.y").alias("y"), F.transform("f.ts", lambda t: t / HOUR).alias("t"))
    fired = spikes(spark, sf_dir).groupBy("unit").agg(F.array_sort(F.collect_list(F.col("ts") / HOUR)).alias("spikes"))
    found = kernels.gridded_speed(frames.join(fired, "unit"), ["unit"], 1000 / 24, low=100.0, high=3000.0, width=200.0)
    values = ["raw_r", "slope", "intercept", "r", "p"]
    return rounded(rounded(found, *values, digits=10), *values, digits=4)  # first back to the halves that the fit's last bits have moved


@query(
    "w6_w8_smoothed_traces",
    f"""WITH RECURSIVE {TRACE}, n AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n, sum(v) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS ahead FROM trace),
    walk(channel, i, y) AS (SELECT channel, i, [v] FROM n WHERE i = 0 UNION ALL SELECT w.channel, n.i, list_append(w.y, CASE WHEN n.i < 7 OR n.i >= n.n - 7 THEN n.v ELSE (list_sum(w.y[n.i - 6 : n.i]) + n.ahead) / 15 END) FROM walk w JOIN n ON w.channel = n.channel AND n.i = w.i + 1),
    bell AS (SELECT k, exp(-k * k / 8.0::DOUBLE) / (SELECT sum(exp(-x * x / 8.0::DOUBLE)) FROM (SELECT unnest(range(-8, 9)) AS x)) AS w FROM (SELECT unnest(range(-8, 9)) AS k)),
    t AS (SELECT unnest(range(-5, 6)) AS t), q AS (SELECT t, 1.0::DOUBLE AS p0, t::DOUBLE AS p1, t * t - 10.0::DOUBLE AS p2, t * t * t - 17.8::DOUBLE * t AS p3 FROM t), z AS (SELECT sum(p0 * p0) AS z0, sum(p1 * p1) AS z1, sum(p2 * p2) AS z2, sum(p3 * p3) AS z3 FROM q),
    fit AS (SELECT a.t AS a, b.t AS b, a.p0 * b.p0 / z0 + a.p1 * b.p1 / z1 + a.p2 * b.p2 / z2 + a.p3 * b.p3 / z3 AS w FROM q a, q b, z),
    place AS (SELECT channel, i, greatest(5, least(n - 6, i)) AS middle FROM n)
    SELECT channel, 'in_place' AS method, CAST(i AS INT) AS i, round(y[i + 1], 6) AS v FROM walk
    UNION ALL SELECT n.channel, 'gaussian', CAST(n.i AS INT), round(sum(w * o.v), 6) FROM n, bell JOIN trace o ON o.channel = n.channel AND o.i = greatest(0, least(n.n - 1, n.i + k)) GROUP BY n.channel, n.i
    UNION ALL SELECT p.channel, 'polynomial', CAST(p.i AS INT), round(greatest(0, sum(w * o.v)), 6) FROM place p JOIN fit ON a = p.i - p.middle JOIN trace o ON o.channel = p.channel AND o.i = p.middle + b GROUP BY p.channel, p.i""",
)
def smoothed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace(spark, sf_dir)
    out = [kernels.smoothed(rows, "channel", "i", "v", m, w).select("channel", F.lit(m).alias("method"), F.col("i").cast("int").alias("i"), "v") for m, w in (("in_place", 15), ("gaussian", 2.0), ("polynomial", 11))]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]), "v")


#: Counts of lags by hour; their spectrum, standardised; and, of the counts in the band of 4 to 12 Hz (an hour is 10 ms), the
#: turns of the analytic signal from one to the next, which is a sum over the half spectrum.
FIRING = f"""WITH {SPIKES}, h AS (SELECT a.unit, CAST(floor((b.ts - a.ts) / {HOUR}.0) AS BIGINT) + 48 AS i, CAST(count(*) AS DOUBLE) AS n FROM spikes a JOIN spikes b ON a.unit = b.unit AND abs(b.ts - a.ts) <= {48 * HOUR} AND a.ts <> b.ts GROUP BY ALL),
    g AS (SELECT u.unit AS channel, u.i, coalesce(n, 0) AS c FROM (SELECT unit, unnest(range(96)) AS i FROM (SELECT DISTINCT unit FROM h) t(unit)) u LEFT JOIN h ON h.unit = u.unit AND h.i = u.i), x AS (SELECT channel, i, c - avg(c) OVER (PARTITION BY channel) AS v FROM g),
    ok AS (SELECT channel FROM x GROUP BY channel HAVING stddev_pop(v) > 0), p AS (SELECT channel, k, sum(v * cos(2 * pi() * (i * k % 96) / 96)) ^ 2 + sum(v * sin(2 * pi() * (i * k % 96) / 96)) ^ 2 AS p FROM x JOIN ok USING (channel), (SELECT unnest(range(1, 49)) AS k) GROUP BY channel, k),
    z AS (SELECT channel, k, k / 0.96::DOUBLE AS f, (p - avg(p) OVER c) / CASE WHEN stddev_pop(p) OVER c = 0 THEN 1 ELSE stddev_pop(p) OVER c END AS z FROM p WINDOW c AS (PARTITION BY channel)),
    best AS (SELECT channel, arg_max(f, struct_pack(z := z, k := -k)) FILTER (f BETWEEN 4 AND 12) AS tf, max(z) FILTER (f BETWEEN 4 AND 12) AS tz, arg_max(f, struct_pack(z := z, k := -k)) FILTER (f BETWEEN 2 AND 4) AS df, max(z) FILTER (f BETWEEN 2 AND 4) AS dz FROM z GROUP BY channel),
    {_zero_phase_sql("y", "x", _butterworth_sql(4, 12, 100), 100)}, s AS (SELECT channel, k, sum(v * cos(2 * pi() * (i * k % 96) / 96)) AS re, -sum(v * sin(2 * pi() * (i * k % 96) / 96)) AS im FROM y, (SELECT unnest(range(49)) AS k) GROUP BY channel, k),
    a AS (SELECT channel, t, atan2(sum(h * (re * sin(2 * pi() * (k * t % 96) / 96) + im * cos(2 * pi() * (k * t % 96) / 96))), sum(h * (re * cos(2 * pi() * (k * t % 96) / 96) - im * sin(2 * pi() * (k * t % 96) / 96)))) AS a FROM (SELECT *, CASE WHEN k IN (0, 48) THEN 1 ELSE 2 END AS h FROM s), (SELECT unnest(range(96)) AS t) GROUP BY channel, t),
    d AS (SELECT channel, a - lag(a) OVER (PARTITION BY channel ORDER BY t) AS d FROM a), w AS (SELECT channel, (d - 2 * pi() * floor((d + pi()) / (2 * pi()))) * 100 / (2 * pi()) AS f FROM d WHERE d IS NOT NULL),
    inside AS (SELECT channel, f, CAST(round_even(f, 0) AS BIGINT) AS hz FROM w JOIN ok USING (channel) WHERE f BETWEEN 4 AND 12), mean AS (SELECT channel, avg(f) AS mean FROM inside GROUP BY channel), mode AS (SELECT channel, arg_max(hz, struct_pack(n := n, h := -hz)) AS hz FROM (SELECT channel, hz, count(*) AS n FROM inside GROUP BY channel, hz) GROUP BY channel)"""


@query("n20_intrinsic_firing", f"{FIRING} SELECT u.channel AS unit, round(tf, 4) AS theta_freq, round(tz, 4) AS theta_z, round(df, 4) AS delta_freq, round(dz, 4) AS delta_z, round(mean, 4) AS mean_freq, round(hz::DOUBLE, 4) AS mode_freq FROM (SELECT DISTINCT channel FROM g) u LEFT JOIN best USING (channel) LEFT JOIN mean USING (channel) LEFT JOIN mode USING (channel)")
def intrinsic_firing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelograms of clicks within 48 hours in bins of an hour, an hour standing for 10 ms."""
    pairs = joins.band_pairs(spikes(spark, sf_dir), "unit", "ts", 48 * HOUR, [])
    bins = pairs.groupBy("unit", F.floor(F.col("lag") / HOUR).alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    full = bins.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    counts = F.transform(F.sequence(F.lit(-48).cast("long"), F.lit(47).cast("long")), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)))
    found = kernels.intrinsic_firing(full.select("unit", counts.alias("counts")), "unit", 0.01)
    return rounded(found, *found.columns[1:], digits=4)


#: The first component is what repeated squaring of the correlations leaves, scaled each time; then its largest column.
COMPONENT = """WITH RECURSIVE w AS (SELECT vec_id // 500 AS file, row_number() OVER (PARTITION BY vec_id // 500 ORDER BY vec_id) - 1 AS k, unnest(range(32)) AS i, unnest(embedding[1:32])::DOUBLE AS v FROM embeddings),
    size AS (SELECT file, k, sqrt(sum(v * v)) AS norm FROM w GROUP BY file, k), u AS (SELECT file, k, i, v / greatest(norm, 1e-300) AS v FROM w JOIN size USING (file, k)),
    z AS (SELECT file, k, i, (v - avg(v) OVER c) / CASE WHEN stddev_pop(v) OVER c > 0 THEN stddev_pop(v) OVER c ELSE 1 END AS z FROM u WINDOW c AS (PARTITION BY file, i)),
    c AS (SELECT a.file, a.i, b.i AS j, avg(a.z * b.z) AS c FROM z a JOIN z b ON a.file = b.file AND a.k = b.k GROUP BY a.file, a.i, b.i), m AS (SELECT file, list(c ORDER BY i, j) AS m FROM c GROUP BY file),
    power(file, m, step) AS (SELECT file, m, 0 FROM m UNION ALL SELECT file, list_transform(q, lambda x: x / list_max(list_transform(q, lambda y: abs(y)))), step + 1 FROM (SELECT file, step,
      list_transform(range(1024), lambda e: list_sum(list_transform(range(32), lambda l: m[(e // 32) * 32 + l + 1] * m[l * 32 + e % 32 + 1]))) AS q FROM power WHERE step < 16)),
    cols AS (SELECT file, j, [m[i * 32 + j + 1] for i in range(32)] AS v FROM (SELECT file, m, unnest(range(32)) AS j FROM power WHERE step = 16)), col AS (SELECT file, arg_max(v, list_sum([x * x for x in v])) AS v FROM cols GROUP BY file),
    first AS (SELECT file, [x / sqrt(list_sum([y * y for y in v])) * CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END for x in v] AS v FROM col)"""


@query("n21_wave_features", f"{COMPONENT} SELECT z.file, CAST(z.k AS INT) AS k, round(any_value(norm) / sqrt(32), 4) AS energy, round(sum(z.z * v[z.i + 1]), 4) AS pc1 FROM z JOIN size ON z.file = size.file AND z.k = size.k JOIN first ON z.file = first.file GROUP BY z.file, z.k")
def wave_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as waves, 500 to a file."""
    rows = read(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 500).alias("file")).agg(F.array_sort(F.collect_list(F.struct("vec_id", F.slice("embedding", 1, 32).cast("array<double>").alias("w")))).alias("r"))
    found = kernels.wave_features(rows.select("file", F.col("r.w").alias("waves")), "file")
    return rounded(found.select("file", F.posexplode(F.arrays_zip("energy", "pc1")).alias("k", "f")).select("file", "k", "f.energy", "f.pc1"), "energy", "pc1", digits=4)


@query("n25_iterative_fields")
def iterative_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's draws and rule, but for sessions of some 15 frames: 5 spikes, and a lower limit and margin."""
    found = kernels.iterative_fields(_units(spark, sf_dir), ["unit"], 8, 6, 1.0, margin=2.0, limit=0.1, more=5)
    return found.select("unit", "n_fields", F.array_join(F.col("sizes").cast("array<string>"), "; ").alias("sizes"), F.round(F.try_element_at("left", F.lit(-1)), 6).alias("left"))
