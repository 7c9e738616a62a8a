"""Shared pieces of the corpus operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text bytes that a Python worker turns into arrays at a time.
SLICE_BYTES = 4_000_000
#: Keys of more than this part of all rows count as hot.
HOT = 1_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of the cluster.

    spark.cleaner.referenceTracking.cleanCheckpoints lets Spark remove it once it is out of use.
    """
    _folder(df.sparkSession)
    return df.checkpoint()


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application; one of its own only where all tasks run on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextmanager
def tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a table to the shared folder and reads it again; what it wrote goes when the block ends.

    For texts that are read more than once, and in loops: the planner takes the sizes of files as they are, while it
    multiplies those of joins, over checkpoints too.
    """
    folder, paths = _folder(spark), []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(f"{folder}/{uuid.uuid4()}")
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def joined(rows: DataFrame, values: DataFrame, on: list[str], count: str) -> DataFrame:
    """rows with the columns of `values`, null where it has none; no key, however hot, lands in one task.

    values has one row a key; its column `count`, which is left out, tells how many of the rows have the key. Keys of
    more than a HOT-th of all rows, which are fewer than HOT, are broadcast, and their rows dealt out over all tasks;
    so are rows with a null key, which find nothing.
    """
    total = values.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT > F.lit(total)
    names = [c for c in values.columns if c not in on and c != count]
    often = values.filter(hot).select(*on, *[F.col(c).alias(f"_hot_{c}") for c in names], F.lit(True).alias("_hot"))
    zero = F.pmod(F.xxhash64(count), F.lit(1))  # a literal would be folded, and leave the join its other keys alone
    rest = values.filter(~hot).select(*on, *names, zero.alias("_part"))
    lone = F.col("_hot").isNull()
    for c in on:
        lone = lone & F.col(c).isNotNull()
    part = F.when(lone, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*[c for c in rows.columns if c not in on]), F.lit(4093)) + 1)
    found = rows.join(F.broadcast(often), on, "left").withColumn("_part", part).join(rest, [*on, "_part"], "left")
    return found.select(*rows.columns, *[F.coalesce(f"_hot_{c}", c).alias(c) for c in names])


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on hands its rows to Python in batches of SLICE_BYTES or so, unless it has a limit of its own.

    By default a batch holds up to 64 MB of text, several times over in the JVM and in each worker, though no more than a
    slice of it is worked on at a time.
    """
    key, unset = "spark.sql.execution.arrow.maxBytesPerBatch", "64m"
    if df.sparkSession.conf.get(key, unset) == unset:
        df.sparkSession.conf.set(key, str(SLICE_BYTES))
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has a column of, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone; a text that is all ASCII can take the faster lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in record batches whose texts have SLICE_BYTES or so; a longer text comes alone."""
    for batch in batches:
        sizes = np.nan_to_num(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
        groups = (np.cumsum(sizes) // SLICE_BYTES).astype(int)
        edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def apart(spans: list[tuple], length: int) -> list[tuple]:
    """Of spans that end in start and end, in order of preference, those that overlap none before them."""
    taken, out = bytearray(length), []
    for s in spans:
        a, b = s[-2:]
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\1" * (b - a)
            out.append(s)
    return out


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit SipHash of each word."""
    if not words:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix(hashes[:n])
    for k in range(1, width):
        out = mix(out ^ hashes[k : n + k])
    return out
