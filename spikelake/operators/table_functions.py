"""Detectors as table functions, to be called from SQL on any table.

    register(spark)
    SELECT * FROM find_ripples(TABLE(trace), key => 'channel', at => 'i', value => 'v', fs => 1000.0)
    SELECT * FROM detect_place_fields(TABLE(frames), key => 'unit', at => 'i', bin => 'bin', seconds => 'occ', n => 'n', nx => 32, ny => 1, fps => 30.0)

They are polymorphic: columns are named in the call, and the key keeps its type. The call's own analysis asks Spark to deal
the table out by the key and to sort each part by `at`, so it needs no PARTITION BY. A function takes one key at a time and
holds it whole, like the detectors that it stands for; for traces that don't fit in a task's memory use the DataFrame operators,
which give the same rows. Rows whose value is null don't count; a null key is a key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from . import kernels
from .ripples import ripples_of


def _analyzed(table: AnalyzeArgument, named: dict[str, AnalyzeArgument], fields: list[tuple[str, T.DataType]], numbers: list[str]) -> AnalyzeResult:
    """The key's column and the fields, after the names of columns and the numbers have been checked."""
    if not table.isTable:
        raise ValueError("the first argument must be a TABLE")
    kinds = {f.name: f.dataType for f in table.dataType.fields}
    for name, argument in named.items():
        if name in numbers:
            if not argument.isConstantExpression or argument.value is None:
                raise ValueError(f"{name} must be a constant")
        elif argument.value not in kinds:
            raise ValueError(f"{name} must name a column of the table, one of {', '.join(kinds)}")
    key, at = named["key"].value, named["at"].value
    schema = T.StructType([T.StructField(key, kinds[key])] + [T.StructField(n, t) for n, t in fields])
    return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn(at)])


class FindRipples:
    """start_time, end_time, peak_time, peak_normed_power and duration_ms of the ripples of each key's trace, as `ripples`."""

    DOUBLES = ("start_time", "end_time", "peak_time", "peak_normed_power", "duration_ms")

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, value: AnalyzeArgument, fs: AnalyzeArgument, **bounds: AnalyzeArgument) -> AnalyzeResult:
        known = {"low", "high", "onset", "peak", "gap", "shortest", "longest"}
        if set(bounds) - known:
            raise ValueError(f"bounds are {', '.join(sorted(known))}")
        return _analyzed(table, {"key": key, "at": at, "value": value, "fs": fs, **bounds}, [(n, T.DoubleType()) for n in FindRipples.DOUBLES], ["fs", *bounds])

    def __init__(self):
        self.samples: list[float] = []
        self.call: tuple | None = None

    def eval(self, row: Row, key: str, at: str, value: str, fs: float, **bounds: float) -> None:
        self.call = (row[key], float(fs), {k: float(v) for k, v in bounds.items()})
        if row[value] is not None:
            self.samples.append(float(row[value]))

    def terminate(self) -> Iterator[tuple]:
        if self.samples:
            key, fs, bounds = self.call
            for r in ripples_of(np.array(self.samples), fs, **bounds):
                yield (key, *r)


class DetectPlaceFields:
    """field (from 0), n_bins, peak and the information left of each field of each key, as `kernels.iterative_fields`.

    A row is a frame: its bin (x * ny + y), the seconds spent and the number of spikes fired in it.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, bin: AnalyzeArgument, seconds: AnalyzeArgument, n: AnalyzeArgument, nx: AnalyzeArgument, ny: AnalyzeArgument, fps: AnalyzeArgument, **rule: AnalyzeArgument) -> AnalyzeResult:
        known = {"draws", "margin", "least", "limit", "share", "smallest", "more", "sparse"}
        if set(rule) - known:
            raise ValueError(f"rules are {', '.join(sorted(known))}")
        fields = [("field", T.LongType()), ("n_bins", T.LongType()), ("peak", T.DoubleType()), ("left", T.DoubleType())]
        return _analyzed(table, {"key": key, "at": at, "bin": bin, "seconds": seconds, "n": n, "nx": nx, "ny": ny, "fps": fps, **rule}, fields, ["nx", "ny", "fps", *rule])

    def __init__(self):
        self.frames: list[tuple] = []
        self.call: tuple | None = None

    def eval(self, row: Row, key: str, at: str, bin: str, seconds: str, n: str, nx: int, ny: int, fps: float, **rule: float) -> None:
        self.call = (row[key], int(nx), int(ny), float(fps), {k: int(v) if k in ("draws", "more") else float(v) for k, v in rule.items()})
        if row[bin] is not None:
            self.frames.append((row[bin], row[seconds] or 0.0, int(row[n] or 0)))

    def terminate(self) -> Iterator[tuple]:
        if self.frames:
            key, nx, ny, fps, rule = self.call
            bins, seconds, n = (np.array(c) for c in zip(*self.frames))
            spikes = np.repeat(np.arange(len(n)), n.astype(int))
            for k, found in enumerate(kernels.suppressed_fields(zlib.crc32(repr((key,)).encode()), bins, seconds, spikes, nx, ny, fps, **rule)):
                yield (key, k, *found)


def register(spark: SparkSession) -> None:
    """find_ripples and detect_place_fields in the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("find_ripples", udtf(FindRipples))
    spark.udtf.register("detect_place_fields", udtf(DetectPlaceFields))
