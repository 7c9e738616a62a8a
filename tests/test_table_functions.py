"""Calls from SQL give the rows of the DataFrame operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikelake.operators import kernels, table_functions
from spikelake.operators.ripples import ripples


@pytest.fixture(scope="module")
def sql(spark):
    table_functions.register(spark)
    return spark.sql


def trace(spark):
    rng, rows = np.random.default_rng(1), []
    for c, events in (("x", [700, 1500]), ("y", [400]), (None, [900])):
        x = rng.standard_normal(2000) * 0.05
        for at in events:
            k = np.arange(-60, 61)
            x[at - 60 : at + 61] += np.exp(-(k**2) / 300) * np.sin(2 * np.pi * 160 * k / 1000) * 3
        rows += [(c, i, float(v), "more") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "channel string, i long, v double, other string").repartition(5)


def test_ripples(spark, sql):
    df = trace(spark)
    df.createOrReplaceTempView("trace")
    call = "SELECT * FROM find_ripples(TABLE(trace), key => 'channel', at => 'i', value => 'v', fs => 1000.0{})"
    for text, options in (("", {}), (", onset => 1.5, longest => 0.3", {"onset": 1.5, "longest": 0.3})):
        got = sql(call.format(text))
        assert got.columns == ["channel", "start_time", "end_time", "peak_time", "peak_normed_power", "duration_ms"]
        got = sorted(map(tuple, got.filter("channel IS NOT NULL").collect()))
        want = sorted(map(tuple, ripples(df.filter("channel IS NOT NULL"), "channel", "i", "v", 1000.0, **options).collect()))
        assert len(got) == 3 and [r[0] for r in got] == [r[0] for r in want] and np.allclose([r[1:] for r in got], [r[1:] for r in want])
    assert sql(call.format("")).filter("channel IS NULL").count() == 1
    joined = sql("SELECT channel, count(*) AS n FROM find_ripples(TABLE(SELECT upper(channel) AS channel, i AS t, v AS lfp FROM trace WHERE channel = 'x'), key => 'channel', at => 't', value => 'lfp', fs => 1000.0) GROUP BY channel")
    assert [tuple(r) for r in joined.collect()] == [("X", 2)]
    for wrong, said in (("value => 'nothing', fs => 1000.0", "must name a column"), ("value => 'v', fs => 1000.0, tide => 2.0", "bounds are")):
        with pytest.raises(Exception, match=said):
            sql(f"SELECT * FROM find_ripples(TABLE(trace), key => 'channel', at => 'i', {wrong})").collect()


def test_place_fields(spark, sql):
    rng = np.random.default_rng(10)
    path = np.abs((np.arange(6000) // 15) % 62 - 31)
    fires = {1: ((np.abs(path - 8) < 2) & (rng.random(6000) < 0.8)) | ((np.abs(path - 24) < 2) & (rng.random(6000) < 0.5)), 2: rng.random(6000) < 0.05}
    frames = spark.createDataFrame([(u, i, int(path[i]), 0.1, int(f[i])) for u, f in fires.items() for i in range(6000)], "unit int, i long, bin long, occ double, n int").repartition(4)
    frames.createOrReplaceTempView("frames")
    got = sql("SELECT * FROM detect_place_fields(TABLE(frames), key => 'unit', at => 'i', bin => 'bin', seconds => 'occ', n => 'n', nx => 32, ny => 1, fps => 10.0, draws => 40)")
    assert dict(got.dtypes) == {"unit": "int", "field": "bigint", "n_bins": "bigint", "peak": "double", "left": "double"}
    units = spark.createDataFrame([(u, path.tolist(), [0.1] * 6000, np.flatnonzero(f).tolist()) for u, f in fires.items()], "unit int, bins array<long>, occ array<double>, spikes array<long>")
    want = kernels.iterative_fields(units, ["unit"], 32, 1, 10.0, draws=40)
    want = want.select("unit", F.posexplode(F.arrays_zip("sizes", "peaks", "left")).alias("field", "x")).select("unit", "field", "x.sizes", "x.peaks", "x.left")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 2
