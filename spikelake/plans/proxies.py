"""Spikes, tracks, traces, grids, clusters and spectra out of the star-schema tables, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
HOUR = 3_600_000_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def _micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, spike, ts (microseconds), amp, cluster."""
    rows = read(spark, sf_dir, "events").filter("event_type = 'click'")
    return rows.select(F.col("user_id").alias("unit"), F.col("event_id").alias("spike"), _micros().alias("ts"), F.col("value").alias("amp"), F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(8)).alias("cluster"))


SPIKES = "spikes AS (SELECT user_id AS unit, event_id AS spike, epoch_us(ts) AS ts, value AS amp, CAST(json_extract_string(props, '$.k') AS INT) % 8 AS cluster FROM events WHERE event_type = 'click')"


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, frame, ts, x (0 to 79), y (0 to 59)."""
    rows = read(spark, sf_dir, "events").filter("event_type = 'view'")
    return rows.select(F.col("user_id").alias("unit"), F.col("event_id").alias("frame"), _micros().alias("ts"), ((F.col("event_id") * 37) % 80).cast("double").alias("x"), ((F.col("event_id") * 53) % 60).cast("double").alias("y"))


TRACK = "track AS (SELECT user_id AS unit, event_id AS frame, epoch_us(ts) AS ts, CAST((event_id * 37) % 80 AS DOUBLE) AS x, CAST((event_id * 53) % 60 AS DOUBLE) AS y FROM events WHERE event_type = 'view')"


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel, i (from 0), ts, v: all events of a user in time."""
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return rows.select(F.col("user_id").alias("channel"), i.cast("long").alias("i"), _micros().alias("ts"), F.col("value").alias("v"))


TRACE = "trace AS (SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) AS ts, value AS v FROM events)"


def grid(spark: SparkSession, sf_dir: str, keys: list[str] | None = None, least: float = 20.0) -> DataFrame:
    """bx, by_, occ (a second for each line item), n (returned ones), valid, rate."""
    keys = keys or []
    rows = read(spark, sf_dir, "lineitem")
    names = {"half": F.when(F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp"), 1).otherwise(2)}
    rows = rows.select(*[names[k].alias(k) for k in keys], F.floor(F.col("l_quantity") / 2).alias("bx"), F.round(F.col("l_discount") * 100).cast("long").alias("by_"), (F.col("l_returnflag") == "R").alias("hit"))
    occ = rows.groupBy(*keys, "bx", "by_").agg(F.count(F.lit(1)).cast("double").alias("occ"), F.sum(F.col("hit").cast("long")).alias("n"))
    valid = F.col("occ") >= least
    return occ.withColumns({"valid": valid, "rate": F.when(valid, F.col("n") / F.col("occ")).otherwise(0.0)})


def grid_sql(keys: str = "", least: float = 20.0) -> str:
    names = "CASE WHEN l_shipdate < TIMESTAMP '1995-06-17' THEN 1 ELSE 2 END AS half, " if keys else ""
    group = keys + ", " if keys else ""
    return (
        f"cells AS (SELECT {names}CAST(floor(l_quantity / 2) AS BIGINT) AS bx, CAST(round(l_discount * 100) AS BIGINT) AS by_, l_returnflag = 'R' AS hit FROM lineitem), "
        f"grid AS (SELECT {group}bx, by_, CAST(count(*) AS DOUBLE) AS occ, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS n, count(*) >= {least} AS valid, "
        f"CASE WHEN count(*) >= {least} THEN sum(CASE WHEN hit THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) ELSE 0.0 END AS rate FROM cells GROUP BY {group}bx, by_)"
    )


SMOOTH = "smooth AS (SELECT g.bx, g.by_, g.occ, g.rate, sum(o.rate * (2 - abs(g.bx - o.bx)) * (2 - abs(g.by_ - o.by_))) / sum((2 - abs(g.bx - o.bx)) * (2 - abs(g.by_ - o.by_))) AS s FROM grid g JOIN grid o ON abs(g.bx - o.bx) <= 1 AND abs(g.by_ - o.by_) <= 1 AND o.valid WHERE g.valid GROUP BY ALL)"


FEATURES = [f"f{i}" for i in range(8)]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file (of three), label, vec_id, f0 to f7: eight features of each vector."""
    file = F.when(F.col("label") < 4, "a").when(F.col("label") < 8, "b").otherwise("c").alias("file")
    return read(spark, sf_dir, "embeddings").select(file, F.col("label").cast("long").alias("label"), "vec_id", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)])


POINTS = f"points AS (SELECT CASE WHEN label < 4 THEN 'a' WHEN label < 8 THEN 'b' ELSE 'c' END AS file, CAST(label AS BIGINT) AS label, vec_id, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS {f}' for i, f in enumerate(FEATURES))} FROM embeddings)"


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, vec_id, wave: the first 32 values of each vector, as doubles."""
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id", F.slice("embedding", 1, 32).cast("array<double>").alias("wave"))


WAVES = "waves AS (SELECT CAST(label AS BIGINT) AS label, vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS wave FROM embeddings), samples AS (SELECT label, vec_id, unnest(range(32)) AS i, unnest(wave) AS v FROM waves)"


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, freq (1 to 12), power."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_suppkey").alias("file"), F.month("l_shipdate").alias("freq")).agg((F.sum(F.col("l_quantity")) + 1).alias("power"))


SPECTRA = "spectra AS (SELECT l_suppkey AS file, CAST(month(l_shipdate) AS INT) AS freq, sum(l_quantity) + 1 AS power FROM lineitem GROUP BY ALL)"
