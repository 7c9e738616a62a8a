"""Tables that are made once for the same inputs, and found again."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str) -> tuple[object, object]:
    """A path and the file system that holds it, of whatever kind Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, inputs: list[str], parameters: dict | None = None) -> str:
    """A hash of the names, sizes and times of all files below the inputs, and of the parameters; a missing input is an error.

    The driver lists files, a line for each; it reads none.
    """
    digest = hashlib.sha256(json.dumps(parameters or {}, sort_keys=True, default=str).encode())
    for path in inputs:
        place, store = _path(spark, path)
        root = store.getFileStatus(place).getPath().toString()
        found, files = [], store.listFiles(place, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString().removeprefix(root), f.getLen(), f.getModificationTime()))
        digest.update(json.dumps([path, sorted(found)]).encode())
    return digest.hexdigest()


def cached(spark: SparkSession, make: Callable[[], DataFrame], folder: str, inputs: list[str], parameters: dict | None = None) -> DataFrame:
    """The table that `make` gives, read from `folder`, where it stands under the fingerprint of its inputs.

    If it is there, nothing is made or written, and `make` isn't called. Else it is written beside and renamed when whole, so
    that a run that breaks off leaves nothing that would be taken for the table; of two that run at once one wins. Changed
    inputs or parameters give another table; older ones stay until someone removes them.
    """
    target, store = _path(spark, f"{folder}/{fingerprint(spark, inputs, parameters)}")
    if not store.exists(target):
        part, _ = _path(spark, f"{folder}/.{uuid.uuid4()}")
        try:
            make().write.parquet(part.toString())
            store.mkdirs(target.getParent())
            if not store.exists(target) and not store.rename(part, target) and not store.exists(target):
                raise OSError(f"{part.toString()} can't be renamed")
        finally:
            store.delete(part, True)
    return spark.read.parquet(target.toString())
