"""Tables to files: results by segment or unit, plain tables, lists, text-faithful reads, manifests."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parts(rows: DataFrame, path: str, by: list[str], mode: str = "error") -> None:
    """One folder for each value of the keys, such as a segment, or a session and unit."""
    rows.write.partitionBy(*by).mode(mode).parquet(path)


def write_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    """With a header; arrays as text joined by '; '."""
    flat = [F.array_join(F.col(c).cast("array<string>"), "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.option("header", "true").mode(mode).csv(path)


def write_list(rows: DataFrame, column: str, path: str, mode: str = "error") -> None:
    """One value a line, such as the files whose fits are poor."""
    rows.select(F.col(column).cast("string")).write.mode(mode).text(path)


def read_text_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """All cells as the text that stands there; empty ones stay empty."""
    return spark.read.option("header", "true").option("inferSchema", "false").option("nullValue", "\0").option("emptyValue", "").option("encoding", encoding).csv(path).na.fill("")


def latin1_files(spark: SparkSession, folder: str) -> tuple[list[str], list[str]]:
    """The CSV files below a folder that are UTF-8, and those that aren't."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(folder)
    found = files.select("path", F.is_valid_utf8(F.col("content").cast("string")).alias("good")).orderBy("path").collect()  # a row for each file
    return [r.path for r in found if r.good], [r.path for r in found if not r.good]


def converted(spark: SparkSession, folder: str, out: str, mode: str = "error", at_once: int = 8) -> list[tuple[str, str]]:
    """Each CSV file below a folder as a Parquet table of the same name below `out`: all cells are the text that stands
    there, in UTF-8 or else Latin-1. Gives the pairs of source and target. Files have columns of their own, so each is a job;
    `at_once` of them run side by side."""
    good, other = latin1_files(spark, folder)
    root = unquote(urlparse(folder).path).rstrip("/")

    def one(file: tuple[str, str]) -> tuple[str, str]:
        path, encoding = file
        below = unquote(urlparse(path).path).removeprefix(root).lstrip("/")
        target = f"{out}/{below.removesuffix('.csv')}.parquet"
        read_text_csv(spark, path, encoding).write.mode(mode).parquet(target)
        return path, target

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(one, sorted([(p, "UTF-8") for p in good] + [(p, "ISO-8859-1") for p in other])))


def manifest(units: DataFrame, chosen: str, path: str, root: str) -> DataFrame:
    """source and target of the files of chosen units, the target below the root by the last two folders."""
    parts = F.split(F.col(path), "/")
    target = F.concat_ws("/", F.lit(root), F.element_at(parts, -2), F.element_at(parts, -1))
    return units.filter(F.col(chosen)).select(F.col(path).alias("source"), target.alias("target"))
