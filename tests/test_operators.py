"""Operators on hand-made rows with known answers, and metamorphic checks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikelake.operators import catalog, clusters, fields, joins, maps, ordering, spikes, windows
from spikelake.streaming import epochs


def test_nearest_ties_and_tolerance(spark):
    frames = spark.createDataFrame([(1, 0, 0), (1, 100_000, 1), (2, 0, 2)], "u int, ts long, frame int")
    fired = spark.createDataFrame([(1, 50_000, 1), (1, 150_000, 2), (1, 150_001, 3), (2, -50_000, 4), (3, 5, 5)], "u int, ts long, s int")
    got = {r.s: r.hit.frame if r.hit else None for r in joins.nearest(fired, frames, "u", "ts", "frame", 50_000).collect()}
    assert got == {1: 0, 2: 1, 3: None, 4: 2, 5: None}  # the earlier of a tie; the tolerance is included
    back = {r.s: r.hit.frame if r.hit else None for r in joins.backward(fired, frames, "u", "ts", "frame").collect()}
    assert back == {1: 0, 2: 1, 3: 1, 4: None, 5: None}
    ahead = {r.s: r.hit.frame if r.hit else None for r in joins.forward(fired, frames, "u", "ts", "frame").collect()}
    assert ahead == {1: 1, 2: None, 3: None, 4: 2, 5: None}


def test_interval_of_frames(spark):
    frames = spark.createDataFrame([(1, 0, 0), (1, 10, 1), (1, 20, 2), (2, 5, 0)], "u int, ts long, frame int")
    fired = spark.createDataFrame([(1, t, t) for t in (-3, 0, 9, 10, 25, 40)] + [(2, 5, 99)], "u int, ts long, s int")
    got = {r.s: r.i for r in joins.interval_of(fired, frames, "u", "ts", "frame", 8).collect()}
    assert got == {-3: 0, 0: 0, 9: 0, 10: 1, 25: 1, 40: None, 99: None}


def test_intervals_and_complex_index(spark):
    times, amps = [0, 1, 3, 6, 16, 36, 57], [9, 8, 7, 6, 5, 4, 3]
    rows = spikes.intervals(spark.createDataFrame([(1, float(t), a) for t, a in zip(times, amps)], "unit int, ts double, amp int"), "unit", "ts", "amp")
    assert spikes.violations(rows, "unit", 2).first().isi_violations == pytest.approx(100 / 6)
    assert spikes.complex_index(rows, "unit", "amp", 3, 20).first().csi == pytest.approx(50)
    assert {r.bin: r.n for r in spikes.interval_histogram(rows, "unit", 5, 20).collect()} == {0: 3, 2: 1, 3: 1}


def test_islands_and_merging(spark):
    up = [1, 0, 0, 1, 1, 0, 1, 0, 0, 0, 0, 1, 1, 0, 1]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(up)], "c int, i long, v int")
    spans = windows.islands(rows, "c", "i", F.col("v") > 0)
    assert sorted((r.start, r.stop) for r in spans.collect()) == [(2, 4), (5, 6), (10, 12)]
    assert sorted((r.start, r.stop) for r in windows.merged(spans, "c", 2).collect()) == [(2, 6), (10, 12)]


def test_outliers_gaps_and_p_values(spark):
    rows = spark.createDataFrame([(1, i, 50.0 if i == 7 else 0.0) for i in range(20)], "c int, i int, v double")
    flagged = windows.hampel(rows, "c", "i", "v")
    assert [r.i for r in flagged.filter("outlier").collect()] == [7]
    fixed = windows.interpolated(flagged.withColumn("v", F.when(~F.col("outlier"), F.col("v"))), "c", "i", "v")
    assert fixed.filter("v <> 0 OR v IS NULL").count() == 0
    p = spark.createDataFrame([(i, v) for i, v in enumerate([0.01, 0.02, 0.03, 0.04, None, 0.9])], "i int, p double")
    got = [r.p_adj for r in windows.adjusted_p(p, "p").orderBy("i").collect()]
    assert got[4] is None and got[:4] == pytest.approx([0.05] * 4) and got[5] == 0.9
    four = windows.adjusted_p(p.filter("i < 4"), "p").collect()
    assert [r.p_adj for r in four] == pytest.approx([0.04] * 4)


def test_chi_squared_and_l_ratio(spark):
    d = spark.createDataFrame([("f", 1, 1, True, 1, 2, 0.5), ("f", 1, 2, False, 1, 2, 4.0)], "file string, cluster int, k int, own boolean, nc long, n long, d2 double")
    assert clusters.l_ratio(d, 2).first().l_ratio == pytest.approx(2.718281828**-2)
    assert clusters.isolation(d, "k").first().iso == 4.0
    assert clusters.isolation(d.withColumn("nc", F.lit(2)), "k").first().iso is None


def test_mahalanobis_in_eight_dimensions(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 8)) @ rng.standard_normal((8, 8))
    names = [f"f{i}" for i in range(8)]
    rows = [("ab"[i % 2], i // 2 % 3, i, *map(float, v)) for i, v in enumerate(x)]
    points = spark.createDataFrame(rows, "file string, label int, k int, " + ", ".join(f"{n} double" for n in names))
    for r in clusters.distances(points, "file", "label", "k", names).collect():
        own = np.array([v[3:] for v in rows if v[0] == r.file and v[1] == r.cluster])
        d = x[r.k] - own.mean(0)
        assert r.d2 == pytest.approx(d @ np.linalg.inv(np.cov(own.T) + np.eye(8) * 1e-10) @ d, rel=1e-8)
        assert r.nc == len(own) and r.n == 60 and r.own == (rows[r.k][1] == r.cluster)


def test_information_ignores_the_scale_and_rolls_come_round(spark):
    bins = spark.createDataFrame([(i, 0, float(i % 3 + 1), True, float(i)) for i in range(9)], "bx int, by_ int, occ double, valid boolean, smooth double")
    a, b = maps.information(bins, []).first(), maps.information(bins.withColumn("smooth", F.col("smooth") * 7), []).first()
    assert a.sir == pytest.approx(b.sir) and a.sparsity == pytest.approx(b.sparsity) and b.peak_fr == 7 * a.peak_fr
    rows = spark.createDataFrame([(1, i, i * 10) for i in range(5)], "c int, i long, v int")
    assert windows.rolled(rows, "c", "i", "v", 5, "w").filter("v <> w").count() == 0


def test_global_places(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    assert [r.place for r in ordering.placed(rows, ["k"], "place").orderBy("k").collect()] == list(range(1, 1001))


@pytest.fixture()
def many_small_ranges(spark):
    """Ranges are sampled and joined by size as on large tables."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_global_places_of_many_ranges(spark, many_small_ranges):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"), F.repeat(F.lit("wide"), (F.col("id") % 50).cast("int")).alias("more")).repartition(7)
    got = ordering.placed(rows, ["k"], "place").orderBy("k").collect()
    assert [r.place for r in got] == list(range(1, 20_001))
    sizes = rows.withColumn("size", (F.col("k") % 50).cast("double"))
    got = catalog.depth_sequence(sizes, "k", "size", [(50, 40), (10, 20)]).select("range_no", "k", "size", "place").collect()
    want = sorted((no, way * r.size, way * r.k) for r in sizes.collect() for no, low, high, way in ((1, 40, 50, -1), (2, 10, 20, 1)) if low <= r.size <= high)
    assert [(r.range_no, (-1 if r.range_no == 1 else 1) * r["size"], (-1 if r.range_no == 1 else 1) * r.k) for r in sorted(got, key=lambda r: r.place)] == want
    assert sorted(r.place for r in got) == list(range(1, len(want) + 1))


def test_adjusted_p_of_many_ranges(spark, many_small_ranges):
    rows = spark.range(20_000).select("id", F.repeat(F.lit("wide"), (F.col("id") % 50).cast("int")).alias("more"), F.pow((F.col("id") * 7919 % 20_011) / 20_011, F.lit(2.0)).alias("p")).repartition(7)
    got = windows.adjusted_p(rows, "p").orderBy("p").collect()
    least, want = 1.0, []
    for rank in range(len(got), 0, -1):
        want.append(least := min(least, got[rank - 1].p * len(got) / rank))
    assert len(got) == 20_000 and [r.p_adj for r in got] == pytest.approx(want[::-1])


def test_streaming_epochs_match_batch(spark, tmp_path):
    rows = spark.range(200).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("id") * 37 % 900)).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, f in (("t", lambda df: epochs.tumbling(df, "ts", "2 minutes", ["k"], "v")), ("b", lambda df: epochs.bursts(df, "ts", "40 seconds", ["k"], "v"))):
        run = f(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "t" else "append").trigger(availableNow=True).start()
        run.awaitTermination(120)
        want = sorted(map(tuple, f(spark.read.parquet(str(tmp_path / "in"))).collect()))
        got = sorted(map(tuple, spark.table(name).collect()))
        assert got == want if name == "t" else set(got) <= set(want)


def test_student_p_is_the_incomplete_beta(spark):
    from spikelake.functions.columns import student_p
    from spikelake.functions.stats import correlation_p

    rows = [(float(r), n) for n in (3, 4, 5, 8, 13, 40, 101) for r in (0.0, 0.1, -0.5, 0.93)]
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") ** 2))
    got = spark.createDataFrame(rows, "r double, n long").select("r", "n", student_p(t, F.col("n") - 2).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(correlation_p(r.r, r.n), abs=1e-9), r


def test_fits_with_p(spark):
    rows = [(1, float(x), 2.0 * x + (x % 3), 1.0 + x % 2) for x in range(9)] + [(2, float(x), 3.0 * x, 1.0) for x in range(4)]
    docs = spark.createDataFrame(rows, "k int, x double, y double, w double")
    line, even = ({r.k: r for r in f.collect()} for f in (fields.fit_line(docs, ["k"], "x", "y"), fields.fit_weighted(docs.withColumn("w", F.lit(2.0)), ["k"], "x", "y", "w")))
    assert line[1].p == pytest.approx(even[1].p) and 0 < line[1].p < 1e-4 and line[2].p < 1e-12 and even[1].slope == pytest.approx(line[1].slope)


def test_calmest_epochs_keep_apart(spark):
    rows = [(1, e, 1.0 + abs(e - 7) / 10, 1.0) for e in range(20)] + [(2, e, float(e), 1.0) for e in range(1, 4)]
    got = fields.calmest(spark.createDataFrame(rows, "c int, e int, p double, l double"), "c", "e", "p", "l").collect()
    assert sorted((r.c, r.rank, r.e) for r in got) == [(1, 1, 7), (1, 2, 2), (2, 1, 1), (2, 2, 2)]


def test_phases_between_reference_peaks(spark):
    peaks = spark.createDataFrame([(0, float(t)) for t in (0, 10, 20, 100)] + [(1, float(t)) for t in (-1, 5, 12, 60, 100)], "c int, t double")
    got = {r.t: r.phase for r in fields.phases(peaks, "c", "t", 0, 15.0).collect()}
    assert got == pytest.approx({5.0: np.pi, 12.0: 0.4 * np.pi, 60.0: np.pi})


def test_adjusted_p_is_the_plain_one(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice([None, 0.01, 0.5, 0.03, 1.0, rng.random() ** 3])) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, p double").repartition(5)

    def plain(own):
        known = sorted((r for r in own if r[2] is not None), key=lambda r: r[2])
        out, least = {r[1]: None for r in own}, 1.0
        for rank in range(len(known), 0, -1):
            least = min(least, known[rank - 1][2] * len(known) / rank)
            out[known[rank - 1][1]] = least
        return out

    assert {r.k: r.p_adj for r in windows.adjusted_p(df, "p").collect()} == pytest.approx(plain(rows))
    grouped = {}
    for g in ("a", "b", None):
        grouped |= plain([r for r in rows if r[0] == g])
    found = windows.adjusted_p(df, "p", ["g"])
    assert found.columns == ["g", "k", "p", "p_adj"] and {r.k: r.p_adj for r in found.collect()} == pytest.approx(grouped)
    assert windows.adjusted_p(df.limit(0), "p").count() == 0


def test_depth_sequence_and_pairs(spark):
    channels = spark.createDataFrame([(k, d) for k, d in enumerate([10.0, 30.0, 20.0, 20.0, 40.0, None])], "id int, depth double")
    got = catalog.depth_sequence(channels, "id", "depth", [(30, 20), (20, 40), (99, 90)]).orderBy("place").collect()
    assert [(r.range_no, r.id, r.place) for r in got] == [(1, 1, 1), (1, 3, 2), (1, 2, 3), (2, 2, 4), (2, 3, 5), (2, 1, 6), (2, 4, 7)]
    assert catalog.pairs(channels, "id", ["depth"]).count() == 15
    with pytest.raises(ValueError, match="at most"):
        catalog.pairs(channels, "id", ["depth"], most=5)
