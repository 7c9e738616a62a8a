"""The online normalisation gives what the batch gives, also after a restart."""

import datetime
import random

import numpy as np
import pytest

from spikelake.streaming import normalise

SCHEMA = "channel string, ts timestamp, v double"
BASELINE = (datetime.datetime(2024, 1, 1, 0, 10), datetime.datetime(2024, 1, 1, 0, 40))


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, normalise.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def rows():
    rng = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    out = [(c, start + datetime.timedelta(seconds=20 * i), rng.gauss(k, 2 + k)) for k, c in enumerate("abc") for i in range(300)]
    out += [("flat", start + datetime.timedelta(seconds=60 * i), 5.0) for i in range(100)]
    out += [("late starter", start + datetime.timedelta(minutes=50, seconds=i), float(i)) for i in range(30)]
    return out + [("b", start + datetime.timedelta(minutes=15), None)]


def run(spark, folder, sd):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = normalise.normalised(source, "channel", "ts", "v", BASELINE, sd, late="10 minutes")
    query = found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
    assert query.awaitTermination(240) and query.exception() is None


@pytest.mark.parametrize("sd", [None, 3.0])
def test_stream_is_the_batch_after_a_restart(rocks, tmp_path, sd):
    spark, table = rocks, rows()
    rng = random.Random(2)
    chunks = {}
    for r in table:  # in order of time but for some minutes
        chunks.setdefault(min(4, int((r[1] - datetime.datetime(2024, 1, 1)).total_seconds() + rng.uniform(0, 240)) // 1200), []).append(r)
    for k, part in sorted(chunks.items()):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k in (1, 4):  # stops with a part of the baseline held, and begins again from its checkpoint
            run(spark, tmp_path, sd)
    last = [("a", datetime.datetime(2024, 1, 1, 9), 0.0)]
    spark.createDataFrame(last, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(spark, tmp_path, sd)
    key = lambda r: (r.channel, r.ts, str(r.v))
    got = sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=key)
    want = sorted(normalise.normalised(spark.createDataFrame(table + last, SCHEMA), "channel", "ts", "v", BASELINE, sd).collect(), key=key)
    assert [key(r) for r in got] == [key(r) for r in want] and len(got) > 900
    for a, b in zip(got, want):
        assert (a.nss is None) == (b.nss is None) and (a.nss is None or a.nss == pytest.approx(b.nss, rel=1e-9, abs=1e-9)), (a, b)
    assert all(r.nss is None for r in got if r.channel == "late starter") and all(r.nss == 0 for r in got if r.channel == "flat")


def test_moments_of_parts_are_those_of_all():
    x = np.random.default_rng(3).standard_normal(100) * 5 + 1e6
    state = (0, 0.0, 0.0)
    for part in np.split(x, [0, 1, 30, 31, 99]):
        state = normalise.merged(state, part)
    assert state[0] == 100 and state[1] == pytest.approx(x.mean()) and state[2] / 100 == pytest.approx(x.var())
