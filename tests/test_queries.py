"""Each query with SQL gives the rows that DuckDB gives; the others give rows. Small data, whole tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from spikelake.plans import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the star-schema tables aren't here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = pd.Series(["null" if pd.isna(v) else float(v) if not isinstance(v, (str, bool)) else v for v in df[c]], dtype=object)
    return df.sort_values(list(df.columns), key=lambda s: s.map(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = _sorted(got), _sorted(want)
    assert len(got) == len(want)
    for c in got.columns:
        for a, b in zip(got[c], want[c]):
            assert a == b or a == pytest.approx(b, rel=1e-9, abs=1e-9), (c, a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    first, again = QUERIES[name](spark, FOLDER).toPandas(), QUERIES[name](spark, FOLDER).toPandas()
    assert len(first) and sorted(map(str, first.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))


def test_unit_labels_of_units_without_spread(spark, tmp_path):
    """One spike, equal amplitudes and none at all divide by zero, as the SQL does."""
    rows = [(1, 5.0), (2, 0.0), (3, 7.0), (3, 7.0), (4, 0.0), (4, 0.0), (5, 1.0), (5, 9.0), (6, -3.0), (7, None)]
    rows = [(i, u, v, "click", '{"k": 1}') for i, (u, v) in enumerate(rows)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double, event_type string, props string")
    events.selectExpr("*", "timestamp_micros(1700000000000000 + event_id) AS ts").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    own = duckdb.connect()
    own.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got, want = QUERIES["p15_p17_p18_unit_labels"](spark, str(tmp_path)).toPandas(), own.sql(ORACLES["p15_p17_p18_unit_labels"]).df()
    assert _sorted(got).to_dict("list") == _sorted(want).to_dict("list") and len(got) == 7


def test_halves_of_gridded_speed_round_up(spark, monkeypatch):
    from spikelake.operators import kernels

    found = spark.createDataFrame([(1, -0.21874999999999994, 5, 0.031249999999999996, 3.90624999999999, 0.09374999999999999, 0.5)], "unit long, raw_r double, n_bins long, slope double, intercept double, r double, p double")
    monkeypatch.setattr(kernels, "gridded_speed", lambda *a, **k: found)
    assert tuple(QUERIES["n30_gridded_speed"](spark, FOLDER).first()) == (1, -0.2188, 5, 0.0313, 3.9063, 0.0938, 0.5)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_shuffles_have_the_operators_draws(spark, monkeypatch):
    from spikelake.operators import kernels

    asked = []
    for name in ("shuffled_information", "cluster_null", "speed_modulation"):
        real = getattr(kernels, name)
        monkeypatch.setattr(kernels, name, lambda *a, real=real, name=name, **k: asked.append((name, "draws" in k, k.get("counts", False))) or real(*a, **k))
    for name in ("n22_shuffled_information", "n23_cluster_null", "n28_n29_speed_modulation"):
        QUERIES[name](spark, FOLDER)
    assert asked == [("shuffled_information", False, False), ("cluster_null", False, False), ("speed_modulation", False, False), ("speed_modulation", False, True)]
