"""Files and tables: pairing, names, labels, and set operations on lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import placed


def trimmed(rows: DataFrame, events: DataFrame, by: str, ts: str, tolerance: float) -> DataFrame:
    """Rows from the one nearest to the key's start event to the one nearest to its stop event, both included; a key
    is dropped where either is further than the tolerance. events: by, start, stop."""
    joined = rows.join(events, by)
    near = joined.groupBy(by).agg(*[F.min_by(ts, F.struct(F.abs(F.col(ts) - F.col(c)), F.col(ts))).alias(f"__{c}") for c in ("start", "stop")], F.first("start").alias("__a"), F.first("stop").alias("__b"))
    near = near.filter((F.abs(F.col("__start") - F.col("__a")) <= tolerance) & (F.abs(F.col("__stop") - F.col("__b")) <= tolerance))
    return rows.join(near.select(by, "__start", "__stop"), by).filter(F.col(ts).between(F.col("__start"), F.col("__stop"))).drop("__start", "__stop")


def halves(rows: DataFrame, by: str, order: str) -> DataFrame:
    """half: 1 for the first n div 2 rows of a key, else 2."""
    i, n = F.row_number().over(Window.partitionBy(by).orderBy(order)), F.count(F.lit(1)).over(Window.partitionBy(by))
    return rows.withColumn("half", F.when(i <= F.floor(n / 2), 1).otherwise(2))


def time_halves(rows: DataFrame, by: str, ts: str) -> DataFrame:
    """half by the middle of the key's time; a row exactly there is in neither."""
    w = Window.partitionBy(by)
    middle = (F.min(ts).over(w) + F.max(ts).over(w)) / 2
    return rows.withColumn("half", F.when(F.col(ts) < middle, 1).when(F.col(ts) > middle, 2))


def scaled(rows: DataFrame, by: str, x: str, y: str, size: float) -> DataFrame:
    """x_cm and y_cm: both axes by the wider one's span over the arena's size, from the smallest value; null without a span."""
    w = Window.partitionBy(by)
    span = F.greatest(F.max(x).over(w) - F.min(x).over(w), F.max(y).over(w) - F.min(y).over(w))
    unit = F.when(span > 0, span / size)
    return rows.withColumns({"x_cm": (F.col(x) - F.min(x).over(w)) / unit, "y_cm": (F.col(y) - F.min(y).over(w)) / unit})


def single_pairs(tracks: DataFrame, units: DataFrame, folder: str) -> DataFrame:
    """Units with the track of their folder, where it holds exactly one."""
    one = tracks.groupBy(folder).agg(F.count(F.lit(1)).alias("__n"), F.min("track").alias("track")).filter("__n = 1").drop("__n")
    return units.join(one, folder)


def companion(files: DataFrame, others: DataFrame, folder: str, name: str) -> DataFrame:
    """Files with the alphabetically first other of their folder, or null."""
    return files.join(others.groupBy(folder).agg(F.min(name).alias("companion")), folder, "left")


def natural_name(name: Column, width: int = 12) -> Column:
    """The name with each run of digits padded by zeros, so that it sorts naturally."""
    pieces = F.regexp_extract_all(name, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, width, "0")).otherwise(p)), "")


def unique_names(rows: DataFrame, name: str, order: str, longest: int = 31) -> DataFrame:
    """sheet: the name without forbidden characters, cut, and numbered from the second of its kind on."""
    clean = F.substring(F.regexp_replace(name, r"[\[\]:*?/\\]", "_"), 1, longest)
    rows = rows.withColumn("__clean", clean)
    n = F.row_number().over(Window.partitionBy("__clean").orderBy(order))
    rows = rows.withColumn("__n", n)
    tail = F.concat(F.lit("_"), F.col("__n").cast("string"))
    return rows.withColumn("sheet", F.when(F.col("__n") == 1, F.col("__clean")).otherwise(F.concat(F.substring(F.col("__clean"), F.lit(1), longest - F.length(tail)), tail))).drop("__clean", "__n")


def pairs(rows: DataFrame, key: str, keep: list[str], most: int = 2_000) -> DataFrame:
    """Unordered pairs of a small table's rows (groups, animals), the smaller key first; more than `most` rows are refused, for
    the pairs are their square."""
    n = rows.count()
    if n > most:
        raise ValueError(f"{n} rows make {n * (n - 1) // 2} pairs; at most {most} rows are paired")
    a = rows.select(F.lit(0).alias("__all"), *[F.col(c).alias(f"{c}_1") for c in [key, *keep]])
    b = rows.select(F.lit(0).alias("__all"), *[F.col(c).alias(f"{c}_2") for c in [key, *keep]])
    return a.join(b, "__all").filter(F.col(f"{key}_1") < F.col(f"{key}_2")).drop("__all")


def depth_sequence(channels: DataFrame, key: str, depth: str, ranges: list[tuple[float, float]], name: str = "place") -> DataFrame:
    """channels with range_no (from 1) and place: those whose depth lies in each range (start, end), both included, one range
    after the other, the channel nearest to the range's start first. Equal depths go by key, backwards in a range that goes
    down; a channel in several ranges stands in each."""
    rows = placed(channels, [depth, key], "__r")
    spans = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(min(r))).alias("low"), F.lit(float(max(r))).alias("high"), F.lit(r[0] > r[1]).alias("down")) for n, r in enumerate(ranges, 1)])
    rows = rows.withColumn("__s", F.explode(spans)).filter(F.col(depth).between(F.col("__s.low"), F.col("__s.high")))
    rows = rows.withColumns({"range_no": F.col("__s.n"), "__o": F.when(F.col("__s.down"), -F.col("__r")).otherwise(F.col("__r"))})
    return placed(rows.drop("__s", "__r"), ["range_no", "__o"], name).drop("__o")


def trial_grid(files: DataFrame, subject: str, trial: str, trials: list[str], value: Column) -> DataFrame:
    """A row for each subject and a column for each trial, with the value of its files; null where there is none."""
    return files.groupBy(subject).pivot(trial, trials).agg(value)


def missing(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """What is expected and isn't found."""
    return expected.join(found.select(*keys).distinct(), keys, "left_anti")


def emptiness(rows: DataFrame, folder: str, empty: Column, limit: float = 0.5) -> DataFrame:
    """Folders of which more than the limit is empty."""
    return rows.groupBy(folder).agg(F.avg(F.when(empty, 1.0).otherwise(0.0)).alias("share")).filter(F.col("share") > limit)


def channel_of(path: Column) -> tuple[Column, Column]:
    """The numbers of CSC<n> and of its ch<m>; null without."""
    part = lambda i: F.nullif(F.regexp_extract(path, r"CSC(\d+)(?:ch(\d+))?", i), F.lit("")).cast("int")
    return part(1), part(2)


def tetrode_of(name: Column) -> Column:
    """TT<n> at the start of a name, in capitals; null without."""
    return F.nullif(F.upper(F.regexp_extract(name, r"^([Tt][Tt]\d+)", 1)), F.lit(""))
