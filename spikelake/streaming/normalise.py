"""Online normalisation: a channel's values less the mean of its baseline, over its deviation, as they arrive.

The whole-trace form can't be told before the trace ends; with a baseline of event time it can, once the watermark has
passed it. A stream keeps for each channel the running count, mean and squares of the baseline, and holds what has come
until a timer tells that no more of it can come; from then on values go out as they come in.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import fields

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(state: tuple[int, float, float], values: np.ndarray) -> tuple[int, float, float]:
    """Count, mean and squared distance from it, with more values."""
    n, mean, rest = state
    k = len(values)
    if not k:
        return state
    m, r = float(values.mean()), float(((values - values.mean()) ** 2).sum())
    return n + k, mean + (m - mean) * k / (n + k), rest + r + (m - mean) ** 2 * n * k / (n + k)


class Normaliser(StatefulProcessor):
    """State by channel: the baseline's moments and whether it is over, and the rows held until then."""

    def __init__(self, start: int, stop: int, sd: float | None):
        self.start, self.stop, self.sd = start, stop, sd

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.moments = handle.getValueState("moments", T.StructType([T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("rest", T.DoubleType()), T.StructField("over", T.BooleanType())]))
        self.held = handle.getListState("held", T.StructType([T.StructField("at", T.LongType()), T.StructField("v", T.DoubleType())]))

    def _out(self, key: tuple, at: np.ndarray, v: np.ndarray, state: tuple) -> pd.DataFrame:
        n, mean, rest, _ = state
        sd = self.sd if self.sd is not None else (rest / n) ** 0.5 if n else np.nan
        nss = (v - mean) / (sd or 1.0) if n else np.full(len(v), np.nan)
        return pd.DataFrame({"key": [key[0]] * len(v), "at": at, "v": v, "nss": nss})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.moments.get() if self.moments.exists() else None
        if state is None:
            state = (0, 0.0, 0.0, False)
            self.handle.registerTimer(self.stop // 1000 + 1)
        for part in rows:
            at, v = part["at"].to_numpy(np.int64), part["v"].to_numpy(np.float64)
            if state[3]:
                yield self._out(key, at, v, state)
                continue
            own = (at >= self.start) & (at <= self.stop) & ~np.isnan(v)
            state = (*merged(state[:3], v[own]), False)
            self.held.appendList(list(zip(at.tolist(), v.tolist())))
        self.moments.update(state)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, mean, rest, over = self.moments.get()
        if over:
            return
        rows = list(self.held.get())
        state = (n, mean, rest, True)
        self.moments.update(state)
        self.held.clear()
        yield self._out(key, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64), state)

    def close(self) -> None:
        pass


def normalised(rows: DataFrame, key: str, ts: str, value: str, baseline: tuple[datetime.datetime, datetime.datetime], sd: float | None = None, late: str = "1 hour") -> DataFrame:
    """key, ts, value and nss: the value less the mean of the baseline (both ends included), over its population deviation, or
    over `sd`; a deviation of 0 counts as 1, and a channel without a baseline has no nss.

    On a stream rows later than the watermark are dropped, as is what of the baseline comes so late; without such rows it
    gives what a batch gives, in any order of arrival and after restarts. It needs the RocksDB state store (PROVIDER).
    """
    session = rows.sparkSession
    start, stop = (int(session.range(1).select(F.unix_micros(F.lit(t).cast("timestamp"))).first()[0]) for t in baseline)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    if not rows.isStreaming:
        return fields.unity(rows.select(key, ts, value), [key], value, (at >= start) & (at <= stop), sd)
    if session.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    kinds = dict(rows.dtypes)
    given = rows.withWatermark(ts, late).select(F.col(key).alias("key"), F.col(ts), at.alias("at"), F.col(value).cast("double").alias("v"))
    found = given.groupBy("key").transformWithStateInPandas(Normaliser(start, stop, sd), f"key {kinds[key]}, at long, v double, nss double", "Append", "EventTime")
    return found.select(F.col("key").alias(key), F.timestamp_micros("at").cast(kinds[ts]).alias(ts), F.col("v").cast(kinds[value]).alias(value), F.nanvl("nss", F.lit(None).cast("double")).alias("nss"))
