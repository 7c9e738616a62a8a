"""Product codes of vectors: integer codebooks trained in rounds, nearest entries by exponion search.

A component x becomes floor(256 * x); a vector is cut into equal consecutive parts, each with a codebook of its own that
starts as that part of the vectors with the smallest ids. A round assigns every part to its nearest entry and replaces
each entry by the floored mean of its parts; an entry without parts stays. All distances are exact integers.

The search starts at the entry of the round before (the first round: at entry 0). With c that entry, an entry b that is as
near to x as c or nearer has |b - c| <= |x - b| + |x - c| <= 2 |x - c|: so the other entries are scanned in the order of
their distance from c, while 4 * |x - c|^2 reaches them. Of equally near entries the one of lower index wins.

Rows with a null vector, or one that holds a null, NaN or infinity, are dropped. A null id comes after all others; rows of
one id are told apart by their components; rows that agree in both are rows of their own. With fewer rows than
entries the codebooks are that small; an empty table gives an empty table and empty codebooks. Vectors of another length
than the first one's, of a length that the number of parts doesn't divide, or so large that a squared distance isn't a
64-bit integer, raise a ValueError. Only the named columns are read, so others can't clash. There are no texts to be long;
long vectors make long parts.

Only the codebooks pass the driver: parts * entries rows of sums, whatever the size of the table. The vectors are written
to the shared folder as integers with their codes, so that each round begins where the one before ended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, joined, tables

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
CODED = "id long, label string, ints array<int>, code binary, error long"


def integers(vectors: DataFrame, vec_id: str, vector: str, label: str | None) -> DataFrame:
    """id, label as a key that is never null, and the floored components of the rows that are kept."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    key = F.coalesce(F.concat(F.lit("l"), F.col(label).cast("string")), F.lit("n")) if label else F.lit("n")
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    rows = vectors.filter(F.col(vector).isNotNull() & ~bad)
    return rows.select(F.col(vec_id).cast("long").alias("id"), key.alias("label"), whole.alias("ints"))


def nearest(x: np.ndarray, book: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry and its squared distance, from the entry to start at."""
    apart = ((book[:, None] - book) ** 2).sum(2)
    order = np.argsort(apart, axis=1, kind="stable")
    apart = np.take_along_axis(apart, order, 1)
    best, least = start.copy(), ((x - book[start]) ** 2).sum(1)
    live, at, reach = np.arange(len(x)), start, 4 * least
    for j in range(len(book)):
        within = apart[at, j] <= reach
        live, at, reach = live[within], at[within], reach[within]
        if not len(live):
            break
        entry = order[at, j]
        found = ((x[live] - book[entry]) ** 2).sum(1)
        better = (found < least[live]) | ((found == least[live]) & (entry < best[live]))
        best[live[better]], least[live[better]] = entry[better], found[better]
    return best, least


def _matrix(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """The components of a batch, by row, part and place."""
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != parts * width).any():
        raise ValueError(f"vectors must all have {parts * width} components, a multiple of {parts}")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, width)
    peak = int(np.abs(x).max(initial=0))
    if 16 * width * peak * peak >= 1 << 63:
        raise ValueError(f"components must be smaller: {peak} / {SCALE} makes distances beyond 64 bits")
    return x


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows with the code and the summed squared distance of each, from the code that they have, if any."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("ints"), parts, width)
            codes = np.zeros((len(x), parts), np.int64)
            if "code" in batch.schema.names and len(x):
                codes[:] = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(codes.shape)
            error = np.zeros(len(x), np.int64)
            for p in range(parts):
                codes[:, p], d = nearest(x[:, p], books[p], codes[:, p])
                error += d
            code = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "ints")), code, pa.array(error)], names=["id", "label", "ints", "code", "error"])

    return rows.mapInArrow(run, CODED)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry at the floored mean of the parts that have its code."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = _matrix(batch.column("ints"), parts, width)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(x), parts)
            cells = codes.astype(np.int64) + np.arange(parts) * entries
            np.add.at(sums, cells, x)
            np.add.at(counts, cells, 1)
        used = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(sums[used].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), lists], names=["cell", "n", "sums"])

    found = rows.select("ints", "code").mapInArrow(run, "cell int, n long, sums array<long>")
    found = found.select("cell", "n", F.posexplode("sums").alias("pos", "x")).groupBy("cell", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    books = books.copy()
    flat = books.reshape(parts * entries, width)
    for r in found.collect():  # parts * entries * width rows at most
        flat[r["cell"], r["pos"]] = r["x"] // r["n"]
    return books


def compressed(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """id, label (as a key), code (an index for each part, a byte each), error and label_error of each row; the codebooks."""
    with tables(vectors.sparkSession) as keep:
        rows = keep(integers(vectors, vec_id, vector, label))
        first = [r["ints"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()]
        if not 0 < entries <= 256:
            raise ValueError("an index must fit in a byte")
        if len({len(v) for v in first}) > 1 or first and len(first[0]) % parts:
            raise ValueError(f"vectors must all have the same number of components, a multiple of {parts}")
        width = len(first[0]) // parts if first else 0
        books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
        for _ in range(rounds):
            rows = keep(assigned(rows, books))
            books = moved(rows, books)
        rows = cut(assigned(rows, books).drop("ints"))
    sums = cut(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    return joined(rows, sums, ["label"], "n"), books


def digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and place, in decimal, with commas between."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
