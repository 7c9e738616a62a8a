"""Binary record files: spikes (ntt, nst, nse), continuous traces (ncs) and events (nev), as Spark data sources.

    spark.dataSource.register(RecordSource)
    spark.read.format("records").option("path", folder_or_file).option("type", "ntt").load()
    df.write.format("records").option("path", folder).option("header_from", file).mode("append").save()

A file is a 16 KiB text header and records of one size. Reading splits each file into ranges of records, and
a filter on `ts` narrows a range by bisection, as records are in time order. A truncated last record is left
out. Writing makes one file for each task, records in the order of `record`; `write_ordered` makes one file of all. The
columns that a query drops are dropped after the read; `scan` with `fields` doesn't decode them at all.

Paths are local ones, or URIs of the stores that Arrow knows (file, hdfs, s3, gs); driver and executors must reach them.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

HEADER = 16_384
RANGE = 100_000
VOLTS, FIXED_VOLTS = 1.95e-7, 3.0517578125e-6


def _spike(channels: int) -> np.dtype:
    return np.dtype([("ts", "<u8"), ("sc_number", "<u4"), ("cell_number", "<u4"), ("params", "<u4", 8), ("wave", "<i2", (32, channels))])


#: Layouts of the file types.
LAYOUTS = {
    "ntt": _spike(4),
    "nst": _spike(2),
    "nse": _spike(1),
    "ncs": np.dtype([("ts", "<u8"), ("channel", "<u4"), ("sample_freq", "<u4"), ("n_valid", "<u4"), ("samples", "<i2", 512)]),
    "nev": np.dtype([("nstx", "<i2"), ("npkt_id", "<i2"), ("npkt_data_size", "<i2"), ("ts", "<u8"), ("nevent_id", "<i2"), ("nttl", "<i2"), ("ncrc", "<i2"), ("ndummy1", "<i2"), ("ndummy2", "<i2"), ("dnExtra", "<i4", 8), ("label", "S128")]),
}
KINDS = {"u8": "bigint", "u4": "bigint", "i2": "int", "i4": "int"}


def schema(kind: str) -> str:
    """path, record, and the fields of a record; arrays are flat, a wave sample-major."""
    out = ["path string", "record bigint"]
    for name in LAYOUTS[kind].names:
        base, shape = LAYOUTS[kind][name].base, LAYOUTS[kind][name].shape
        t = "string" if base.kind == "S" else KINDS[base.str[1:]]
        out.append(f"{name} array<{t}>" if shape else f"{name} {t}")
    return ", ".join(out)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (pafs.LocalFileSystem(), path)


def _uri(path: str, within: str) -> str:
    """A path within the store of another, told as that one is."""
    return f"{re.match(r'[a-z][a-z0-9+.-]*:(//(?=/))?', path)[0]}{within}" if re.match(r"[a-z][a-z0-9+.-]*:", path) else within


def header(path: str) -> dict[str, str]:
    """The `-Name value` lines of a header."""
    store, at = _store(path)
    with store.open_input_file(at) as f:
        text = f.read(HEADER).decode("latin-1")
    return {m[1]: m[2].strip() for m in re.finditer(r"^-(\w+)[ \t]+(.*)$", text.replace("\0", ""), re.M)}


def volts(fields: dict[str, str], mode: str = "header") -> float:
    """Volts for a count: the header's first number between 0 and 1, else a default (header); its last word, or an
    error (strict); a fixed value (const)."""
    line = fields.get("ADBitVolts")
    if mode == "const":
        return FIXED_VOLTS
    if mode == "strict":
        if not line:
            raise ValueError("the header has no ADBitVolts")
        return float(line.split()[-1])
    for word in (line or "").split():
        try:
            if 0 < (v := float(word)) < 1:
                return v
        except ValueError:
            continue
    return VOLTS


def kind_of(path: str) -> str:
    kind = Path(path).suffix[1:].lower()
    if kind not in LAYOUTS:
        raise ValueError(f"{path}: unknown type of file")
    return kind


def records(path: str, kind: str) -> int:
    store, at = _store(path)
    return max(0, store.get_file_info(at).size - HEADER) // LAYOUTS[kind].itemsize


def _files(path: str, kind: str) -> list[tuple[str, int]]:
    """The file, or the files of a type below the folder, and the records of each."""
    store, at = _store(path)
    top = store.get_file_info(at)
    if top.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [top] if top.type == pafs.FileType.File else [f for f in store.get_file_info(pafs.FileSelector(at, recursive=True)) if f.type == pafs.FileType.File and f.path.endswith(f".{kind}")]
    return sorted((_uri(path, f.path), max(0, f.size - HEADER) // LAYOUTS[kind].itemsize) for f in found)


def _first_at(path: str, kind: str, n: int, time: int, after: bool = False) -> int:
    """The number of the first record at a time or later, or after it: a bisection that reads one time in each step."""
    layout, low, high = LAYOUTS[kind], 0, n
    store, at = _store(path)
    with store.open_input_file(at) as f:
        while low < high:
            middle = (low + high) // 2
            f.seek(HEADER + middle * layout.itemsize + layout.fields["ts"][1])
            here = int.from_bytes(f.read(8), "little")
            if here < time or after and here == time:
                low = middle + 1
            else:
                high = middle
    return low


def _columns(rows: np.ndarray, path: str, first: int, names: Sequence[str]) -> pa.RecordBatch:
    arrays = []
    for name in names:
        if name == "path":
            arrays.append(pa.array([path] * len(rows), pa.string()))
        elif name == "record":
            arrays.append(pa.array(np.arange(first, first + len(rows))))
        else:
            values = rows[name]
            if values.dtype.kind == "S":
                arrays.append(pa.array([v.split(b"\0")[0].decode("latin-1") for v in values.tolist()], pa.string()))
                continue
            values = values.astype(np.int64 if values.dtype.str[1:] in ("u8", "u4") else np.int32)
            if values.ndim == 1:
                arrays.append(pa.array(values))
            else:
                width = int(np.prod(values.shape[1:]))
                arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), pa.array(values.reshape(-1))))
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


@dataclass
class Part(InputPartition):
    path: str
    first: int
    count: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.names = options["path"], names
        self.kind = options.get("type") or kind_of(self.path)
        self.low, self.high = -1, 1 << 62

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("ts",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, int(f.value))
                else:
                    self.high = min(self.high, int(f.value))
            yield f  # Spark still tests each row

    def partitions(self):
        parts = []
        for path, n in _files(self.path, self.kind):
            a = _first_at(path, self.kind, n, self.low) if self.low > 0 else 0
            b = _first_at(path, self.kind, n, self.high, True) if self.high < 1 << 62 else n
            parts += [Part(path, i, min(RANGE, b - i)) for i in range(a, b, RANGE)]
        return parts or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        layout = LAYOUTS[self.kind]
        if not part.count:
            return
        store, at = _store(part.path)
        with store.open_input_file(at) as f:
            f.seek(HEADER + part.first * layout.itemsize)
            for a in range(part.first, part.first + part.count, 4096):
                n = min(4096, part.first + part.count - a)
                yield _columns(np.frombuffer(f.read(n * layout.itemsize), layout, n), part.path, a, self.names)


def _packed(batch: pa.RecordBatch, layout: np.dtype) -> np.ndarray:
    """The rows as records."""
    rows = np.zeros(batch.num_rows, layout)
    for name in layout.names:
        column = batch.column(name)
        if layout[name].base.kind == "S":
            rows[name] = [(v or "").encode("latin-1") for v in column.to_pylist()]
        elif layout[name].shape:
            rows[name] = np.array(column.to_pylist(), np.int64).reshape(batch.num_rows, *layout[name].shape)
        else:
            rows[name] = column.to_numpy(zero_copy_only=False)
    return rows


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.kind = options["path"], options["type"]
        self.header = Path(options["header_from"]).open("rb").read(HEADER) if "header_from" in options else b"######## records\r\n".ljust(HEADER, b"\0")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        layout = LAYOUTS[self.kind]
        found, order = [], []
        for batch in batches:
            found.append(_packed(batch, layout))
            order.append(batch.column("record").to_numpy())
        if not found:
            return _Written("")
        rows = np.concatenate(found)[np.argsort(np.concatenate(order), kind="stable")]
        os.makedirs(self.folder, exist_ok=True)
        path = f"{self.folder}/.{uuid.uuid4()}.{self.kind}"
        with open(path, "wb") as f:
            f.write(self.header)
            f.write(rows.tobytes())
        return _Written(path)

    def commit(self, messages) -> None:
        for m in messages:
            if m and m.path:
                os.rename(m.path, str(Path(m.path).with_name(f"part-{Path(m.path).name[1:]}")))

    def abort(self, messages) -> None:
        for m in messages:
            if m and m.path:
                Path(m.path).unlink(missing_ok=True)


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        kind = self.options.get("type") or kind_of(self.options["path"])
        names = self.options.get("fields")
        fields = schema(kind).split(", ")
        return ", ".join(f for f in fields if not names or f.split()[0] in names.split(","))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def scan(spark: SparkSession, path: str, kind: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """The records of a file, or of all files of a type below a folder."""
    spark.dataSource.register(RecordSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("records").option("path", path)
    for key, value in (("type", kind), ("fields", ",".join(fields) if fields else None)):
        reader = reader.option(key, value) if value else reader
    return reader.load()


def concatenated(files: DataFrame, order: str = "path") -> DataFrame:
    """Records of several cluster files as one: cell_number counts the files from 1, records are renumbered in time, by
    ranges of it rather than in one task."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ..operators.ordering import placed

    numbers = files.select(order).distinct().withColumn("cell", F.row_number().over(Window.orderBy(order)))  # a row for each file
    rows = files.join(F.broadcast(numbers), order).withColumn("cell_number", F.col("cell").cast("bigint")).drop("cell")
    return placed(rows.withColumnRenamed("record", "__old"), ["ts", order, "__old"], "record").select(*files.columns)


def write_ordered(rows: DataFrame, path: str, kind: str, header_from: str | None = None, again: bool = False) -> bool:
    """One file of all rows in the order of `record`, which numbers them from 1 without gaps (as `concatenated` does); whether
    it was written: a file that is there stays as it is, unless `again`.

    The rows are dealt out by ranges of their number; each task writes its own to the bytes that they will have in the whole
    file, so no task holds more than its range, and one that is repeated writes the same. The file has another name until all
    is there, and is renamed then; whatever goes wrong leaves no file. Its folder is one that driver and executors share.
    """
    target = Path(path)
    if target.exists() and not again:
        return False
    layout = LAYOUTS[kind]
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.{uuid.uuid4()}")
    head = b"######## records\r\n".ljust(HEADER, b"\0")
    if header_from:
        store, at = _store(header_from)
        with store.open_input_file(at) as f:
            head = f.read(HEADER)
    part.write_bytes(head)
    name = str(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, n = None, 0, 0
        with open(name, "r+b") as f:
            for batch in batches:
                places = batch.column("record").to_numpy()
                if not len(places):
                    continue
                data = _packed(batch, layout)
                for a, b in zip(*(x.tolist() for x in _stretches(places))):
                    f.seek(HEADER + (int(places[a]) - 1) * layout.itemsize)
                    f.write(data[a:b].tobytes())
                low, high, n = min(places[0], low or places[0]), max(high, places[-1]), n + len(places)
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([int(low or 0)]), pa.array([int(high)]), pa.array([n])], names=["low", "high", "n"])

    try:
        dealt = rows.select("record", *layout.names).repartitionByRange("record").sortWithinPartitions("record")
        done = [r for r in dealt.mapInArrow(run, "low long, high long, n long").collect() if r.n]  # a row for each task
        if done and (min(r.low for r in done) != 1 or sum(r.n for r in done) != max(r.high for r in done) or any(r.high - r.low + 1 != r.n for r in done)):
            raise ValueError("records must be numbered from 1 without gaps")
        os.replace(part, target)
    finally:
        part.unlink(missing_ok=True)
    return True


def _stretches(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive numbers begin and end."""
    edge = np.flatnonzero(np.diff(places) != 1) + 1
    return np.concatenate([[0], edge]), np.concatenate([edge, [len(places)]])


def write_concatenated(spark: SparkSession, folder: str, out: str, kind: str = "ntt") -> dict[str, bool]:
    """For each folder below `folder` that holds files of the type one file of all their records in time, numbered by
    file, at the same place below `out`; which of them were written, the others being there already.

    The driver goes over folders, each with jobs of its own; what is there costs none.
    """
    top, done = Path(folder), {}
    for place in sorted({p.parent for p in top.rglob(f"*.{kind}") if not p.is_relative_to(out)}):
        target = Path(out) / place.relative_to(top) / f"{place.name}.{kind}"
        if not target.exists():
            files = sorted(place.glob(f"*.{kind}"))
            rows = concatenated(scan(spark, str(place), kind).filter(_beside(place)))
            done[str(target)] = write_ordered(rows, str(target), kind, str(files[0]))
        else:
            done[str(target)] = False
    return done


def _beside(place: Path):
    """Files in this folder itself."""
    from pyspark.sql import functions as F

    return F.substring_index("path", "/", -1) == F.expr(f"substring(path, {len(str(place)) + 2})")


def spike_counts(spark: SparkSession, folder: str, kind: str = "ntt") -> DataFrame:
    """path and n, from the sizes of the files alone."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.floor(F.greatest(F.col("length") - HEADER, F.lit(0)) / LAYOUTS[kind].itemsize).alias("n"))


def track(spark: SparkSession, path: str, centimetres: bool = False) -> DataFrame:
    """ts, x, y of a tracking table: by its header names, or by place (1st, 4th, 5th column); cells that aren't finite numbers drop their row."""
    from pyspark.sql import functions as F

    rows = spark.read.option("header", "true").csv(path)
    names = [rows.columns[i] for i in (0, 3, 4)] if centimetres else ["time", "x", "y"]
    rows = rows.select(*[F.col(f"`{c}`").try_cast("double").alias(k) for c, k in zip(names, ("ts", "x", "y"))])
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return rows.filter(finite("ts") & finite("x") & finite("y"))


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """ts, x, y of a sheet without header: its first three columns, by place; cells that aren't numbers drop their row."""
    from pyspark.sql import functions as F

    rows = spark.read.option("header", "false").csv(path)
    rows = rows.select(*[F.col(f"`{c}`").try_cast("double").alias(k) for c, k in zip(rows.columns, ("ts", "x", "y"))])
    return rows.dropna()


def trace(blocks: DataFrame, scale: float = 1.0, honour_valid: bool = False) -> DataFrame:
    """path, i (from 0, gapless), v: the samples of continuous records, all of them or the valid ones."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    taken = F.slice("samples", 1, F.col("n_valid").cast("int")) if honour_valid else F.col("samples")
    w = Window.partitionBy("path").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.select("path", "record", taken.alias("s")).withColumn("before", F.coalesce(F.sum(F.size("s")).over(w), F.lit(0)))
    rows = rows.select("path", "before", F.posexplode("s").alias("k", "raw"))
    return rows.select("path", (F.col("before") + F.col("k")).alias("i"), (F.col("raw") * scale).alias("v"))
