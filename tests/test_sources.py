"""Record files with known bytes."""

import numpy as np
import pytest

from spikelake.sources import records as R
from spikelake.sources import tables as T

TEXT = b"######## test\r\n-ADBitVolts 3.05e-8 3.05e-8\r\n-SamplingFrequency 32000\r\n".ljust(R.HEADER, b"\0")


def spikes(cells, start=0):
    rows = np.zeros(len(cells), R.LAYOUTS["ntt"])
    rows["ts"], rows["cell_number"] = np.arange(len(cells)) * 1000 + start, cells
    rows["wave"] = np.arange(len(cells) * 128).reshape(-1, 32, 4) % 30_000
    return rows


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "TT1.ntt").write_bytes(TEXT + spikes([0, 1, 1, 2, 2, 2]).tobytes() + b"cut")
    (tmp_path / "a" / "TT2.ntt").write_bytes(TEXT + spikes([5, 5], 500).tobytes())
    return tmp_path


def test_spikes(spark, folder):
    df = R.scan(spark, str(folder / "a"), "ntt")
    assert df.count() == 8 and df.filter("cell_number <> 0").count() == 7
    first = df.filter("path LIKE '%TT1%' AND record = 1").first()
    assert first.wave == spikes([0, 1])["wave"][1].reshape(-1).tolist() and len(first.params) == 8
    assert sorted(r.ts for r in df.filter("ts >= 1000 AND ts <= 1500").select("ts").collect()) == [1000, 1500]
    assert R.scan(spark, str(folder / "a" / "TT1.ntt"), fields=["ts"]).columns == ["ts"]
    assert {r.path.split("/")[-1]: r.n for r in R.spike_counts(spark, str(folder)).collect()} == {"TT1.ntt": 6, "TT2.ntt": 2}


def test_header_and_errors(folder, tmp_path):
    fields = R.header(str(folder / "a" / "TT1.ntt"))
    assert R.volts(fields) == R.volts(fields, "strict") == 3.05e-8 and R.volts(fields, "const") == R.FIXED_VOLTS and R.volts({}) == R.VOLTS
    with pytest.raises(ValueError):
        R.volts({}, "strict")
    with pytest.raises(ValueError):
        R.kind_of("x.csv")


def test_round_trip_and_concatenation(spark, folder, tmp_path):
    df = R.scan(spark, str(folder / "a"), "ntt")
    kept = df.filter("cell_number > 0 AND path LIKE '%TT1%'").coalesce(1)
    kept.write.format("records").option("type", "ntt").option("path", str(tmp_path / "out")).option("header_from", str(folder / "a" / "TT1.ntt")).mode("append").save()
    written = next((tmp_path / "out").glob("*.ntt"))
    assert written.read_bytes() == TEXT + spikes([0, 1, 1, 2, 2, 2])[1:].tobytes()
    both = R.concatenated(df).orderBy("record").collect()
    assert [r.cell_number for r in both] == [1, 2, 1, 2, 1, 1, 1, 1] and [r.ts for r in both] == sorted(r.ts for r in both)


def test_traces_and_events(spark, tmp_path):
    blocks = np.zeros(3, R.LAYOUTS["ncs"])
    blocks["n_valid"], blocks["samples"] = [512, 512, 100], np.arange(1536).reshape(3, 512)
    (tmp_path / "x.ncs").write_bytes(TEXT + blocks.tobytes())
    df = R.scan(spark, str(tmp_path / "x.ncs"))
    assert R.trace(df).count() == 1536 and R.trace(df, honour_valid=True).count() == 1124
    assert R.trace(df, 0.5).orderBy("i").tail(1)[0].v == 767.5
    events = np.zeros(2, R.LAYOUTS["nev"])
    events["ts"], events["label"] = [10, 20], [b"start", b"stop"]
    (tmp_path / "e.nev").write_bytes(TEXT + events.tobytes())
    assert [(r.ts, r.label) for r in R.scan(spark, str(tmp_path / "e.nev")).orderBy("ts").select("ts", "label").collect()] == [(10, "start"), (20, "stop")]
    (tmp_path / "empty.ntt").write_bytes(TEXT)
    assert R.scan(spark, str(tmp_path / "empty.ntt")).count() == 0


def test_tracking_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text("time,x,y,x_cm,y_cm\n1,2,3,0.2,0.3\n2,oops,3,0.4,0.5\n3,inf,1,nan,2\n")
    assert [tuple(r) for r in R.track(spark, str(tmp_path / "t.csv")).collect()] == [(1.0, 2.0, 3.0)]
    assert [tuple(r) for r in R.track(spark, str(tmp_path / "t.csv"), True).collect()] == [(1.0, 0.2, 0.3), (2.0, 0.4, 0.5)]


def test_tables(spark, tmp_path):
    from spikelake.sources import tables

    rows = spark.createDataFrame([("full", 1, [1, 2], "a/b/TT1.ntt", True), ("first", 2, [], "a/c/TT2.ntt", False)], "segment string, unit int, ids array<int>, path string, chosen boolean")
    tables.write_parts(rows, str(tmp_path / "p"), ["segment"])
    assert spark.read.parquet(str(tmp_path / "p")).filter("segment = 'full'").count() == 1
    tables.write_csv(rows, str(tmp_path / "c"))
    assert sorted(r.ids for r in tables.read_text_csv(spark, str(tmp_path / "c")).collect()) == ["", "1; 2"]
    tables.write_list(rows, "path", str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 2
    assert [tuple(r) for r in tables.manifest(rows, "chosen", "path", "out").collect()] == [("a/b/TT1.ntt", "out/b/TT1.ntt")]


def test_coordinates_and_conversion(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "c.csv").write_text("1,2.5,3,9\n2,x,4,9\n3,4,5,9\n")
    (tmp_path / "in" / "deep" / "ä.csv").write_bytes("name,n\nm\u00fcller,007\n,\n".encode("latin-1"))
    assert [tuple(r) for r in R.coordinates(spark, str(tmp_path / "in" / "c.csv")).orderBy("ts").collect()] == [(1.0, 2.5, 3.0), (3.0, 4.0, 5.0)]
    done = T.converted(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert len(done) == 2
    rows = spark.read.parquet(str(tmp_path / "out" / "deep" / "ä.parquet")).collect()
    assert [tuple(r) for r in rows] == [("m\u00fcller", "007"), ("", "")]


def test_one_ordered_file_is_written_once(spark, folder, tmp_path):
    rng = np.random.default_rng(1)
    times = {}
    for name, n in (("TT3.ntt", 700), ("TT4.ntt", 300)):
        rows = spikes(np.ones(n, int))
        rows["ts"] = np.sort(rng.integers(0, 5000, n))
        times[name] = rows["ts"]
        (folder / "b").mkdir(exist_ok=True)
        (folder / "b" / name).write_bytes(TEXT + rows.tobytes())
    out = tmp_path / "joined"
    first = R.write_concatenated(spark, str(folder), str(out))
    assert first == {str(out / "a" / "a.ntt"): True, str(out / "b" / "b.ntt"): True}
    made = np.frombuffer((out / "b" / "b.ntt").read_bytes()[R.HEADER :], R.LAYOUTS["ntt"])
    assert (out / "b" / "b.ntt").read_bytes()[: R.HEADER] == TEXT
    assert made["ts"].tolist() == sorted(np.concatenate(list(times.values())).tolist()) and sorted(made["cell_number"].tolist()) == [1] * 700 + [2] * 300
    before = {p: p.stat().st_mtime_ns for p in out.rglob("*")}
    assert R.write_concatenated(spark, str(folder), str(out)) == dict.fromkeys(first, False)
    assert {p: p.stat().st_mtime_ns for p in out.rglob("*")} == before
    one = R.scan(spark, str(out / "b" / "b.ntt"))
    with pytest.raises(ValueError, match="without gaps"):  # records read are numbered from 0
        R.write_ordered(one, str(out / "c.ntt"), "ntt")
    assert not any(p.name.startswith(".") or p.name == "c.ntt" for p in out.rglob("*"))
    assert R.write_ordered(one.withColumn("record", one.record + 1), str(out / "b" / "b.ntt"), "ntt", str(folder / "b" / "TT3.ntt"), again=True)
    assert np.frombuffer((out / "b" / "b.ntt").read_bytes()[R.HEADER :], R.LAYOUTS["ntt"]).tobytes() == made.tobytes()


def test_uris_and_bisection(spark, folder):
    rows = spikes(np.arange(1000))
    rows["ts"] = np.repeat(np.arange(250) * 10, 4)
    path = folder / "TT9.ntt"
    path.write_bytes(TEXT + rows.tobytes())
    for low, high in ((0, 2490), (15, 15), (20, 20), (-5, 3), (2491, 9999), (1000, 999)):
        a, b = R._first_at(str(path), "ntt", 1000, low), R._first_at(str(path), "ntt", 1000, high, True)
        assert (a, b) == (np.searchsorted(rows["ts"], max(low, 0)), np.searchsorted(rows["ts"], high, "right"))
        got = R.scan(spark, path.as_uri()).filter(f"ts >= {low} AND ts <= {high}").count()
        assert got == ((rows["ts"] >= low) & (rows["ts"] <= high)).sum()
    assert R.scan(spark, folder.as_uri(), "ntt").select("path").distinct().count() == 3
    assert R.header(path.as_uri()) == R.header(str(path)) and R.records(path.as_uri(), "ntt") == 1000


def test_cached_tables_are_made_once(spark, tmp_path):
    from spikelake.sources.cache import cached

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text("a\n1\n2\n")
    calls = []

    def make(k=1):
        calls.append(k)
        return spark.read.option("header", "true").csv(f"{tmp_path}/in").selectExpr(f"cast(a AS INT) * {k} AS a")

    run = lambda k=1: sorted(r.a for r in cached(spark, lambda: make(k), f"{tmp_path}/kept", [f"{tmp_path}/in"], {"k": k}).collect())
    files = lambda: sorted((str(p), p.stat().st_mtime_ns) for p in (tmp_path / "kept").rglob("*"))
    assert run() == [1, 2] and calls == [1]
    before = files()
    assert run() == [1, 2] and calls == [1] and files() == before
    assert run(3) == [3, 6] and calls == [1, 3]
    (tmp_path / "in" / "y.csv").write_text("a\n7\n")
    assert run() == [1, 2, 7] and calls == [1, 3, 1]

    def broken():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        cached(spark, broken, f"{tmp_path}/kept", [f"{tmp_path}/in"], {"k": 9})
    assert len([p for p in (tmp_path / "kept").iterdir()]) == 3
    with pytest.raises(Exception, match="nowhere"):
        cached(spark, make, f"{tmp_path}/kept", [f"{tmp_path}/nowhere"])
