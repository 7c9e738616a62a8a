"""Joins by time: nearest, backward and forward as-of, bands, intervals and epochs.

As-of joins sort the union of both sides once for each key and carry the last and next row of the right side
over it, so nothing is paired. Range joins get an equal key first: a time bucket as wide as the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _carried(left: DataFrame, right: DataFrame, by: str, ts: str, order: str) -> DataFrame:
    """The rows of left with `before` and `after`: the right rows (ts, order and the rest) around each.

    `before` may have the same time, and is the last in `order` of those that do; `after` is later.
    """
    fields = [ts, order, *[c for c in right.columns if c not in (by, ts, order)]]
    both = left.withColumn("__right", F.lit(None)).withColumn("__side", F.lit(1)).unionByName(
        right.select(by, ts, F.struct(*fields).alias("__right"), F.lit(0).alias("__side"), F.col(order).alias("__order")), allowMissingColumns=True
    )
    up = Window.partitionBy(by).orderBy(ts, "__side", "__order").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(by).orderBy(F.desc(ts), F.desc("__side"), F.desc("__order")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"before": F.last("__right", ignorenulls=True).over(up), "after": F.last("__right", ignorenulls=True).over(down)})
    return both.filter("__side = 1").select(*left.columns, "before", "after")


def nearest(left: DataFrame, right: DataFrame, by: str, ts: str, order: str, tolerance: float | None = None) -> DataFrame:
    """left with `hit`, the nearest right row, a tie going to the earlier one; null beyond the tolerance."""
    rows = _carried(left, right, by, ts, order)
    back, ahead = F.col(ts) - F.col(f"before.{ts}"), F.col(f"after.{ts}") - F.col(ts)
    hit = F.when(F.col("before").isNull() | (ahead < back), F.col("after")).otherwise(F.col("before"))
    rows = rows.withColumn("hit", hit).drop("before", "after")
    if tolerance is None:
        return rows
    return rows.withColumn("hit", F.when(F.abs(F.col(ts) - F.col(f"hit.{ts}")) <= tolerance, F.col("hit")))


def backward(left: DataFrame, right: DataFrame, by: str, ts: str, order: str) -> DataFrame:
    """left with `hit`, the last right row at or before it."""
    return _carried(left, right, by, ts, order).withColumn("hit", F.col("before")).drop("before", "after")


def forward(left: DataFrame, right: DataFrame, by: str, ts: str, order: str) -> DataFrame:
    """left with `hit`, the first right row at or after it."""
    rows = _carried(left, right, by, ts, order)
    same = F.col(f"before.{ts}") == F.col(ts)
    return rows.withColumn("hit", F.when(same, F.col("before")).otherwise(F.col("after"))).drop("before", "after")


def interval_of(spikes: DataFrame, frames: DataFrame, by: str, ts: str, order: str, tolerance: float) -> DataFrame:
    """spikes with `i`: the interval of two frames (0 to n - 2) they fall in, clipped to the first and last;
    null if the nearer of its bounds is further than the tolerance."""
    w = Window.partitionBy(by).orderBy(ts, order)
    numbered = frames.select(by, ts, order).withColumns({"i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(by)), "until": F.lead(ts).over(w), "prior": F.lag(ts).over(w)})
    rows = _carried(spikes, numbered, by, ts, order)
    i, n = F.coalesce(F.col("before.i"), F.lit(0)), F.coalesce(F.col("before.n"), F.col("after.n"))
    low = F.when(F.col("before").isNull(), F.col(f"after.{ts}")).when(i > n - 2, F.col("before.prior")).otherwise(F.col(f"before.{ts}"))
    high = F.when(F.col("before").isNull(), F.col("after.until")).when(i > n - 2, F.col(f"before.{ts}")).otherwise(F.col("before.until"))
    near = F.least(F.abs(F.col(ts) - low), F.abs(F.col(ts) - high)) <= tolerance
    return rows.withColumn("i", F.when(near & (n >= 2), F.least(i, n - 2))).drop("before", "after")


def band_pairs(rows: DataFrame, by: str, ts: str, width: float, keep: list[str]) -> DataFrame:
    """Ordered pairs of rows of a key with 0 < |lag| <= width: by, lag and, for both, the kept columns.

    Each row is placed in its own bucket and looked for in the bucket and its two neighbours.
    """
    bucket = F.floor(F.col(ts) / width)
    left = rows.select(by, F.col(ts).alias("__a"), *[F.col(c).alias(f"{c}_a") for c in keep], F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__bucket"))
    right = rows.select(by, F.col(ts).alias("__b"), *[F.col(c).alias(f"{c}_b") for c in keep], bucket.alias("__bucket"))
    lag = F.col("__b") - F.col("__a")
    pairs = left.join(right, [by, "__bucket"]).withColumn("lag", lag).filter((F.abs("lag") <= width) & (F.col("lag") != 0))
    return pairs.select(by, "lag", *[f"{c}_{s}" for c in keep for s in "ab"])


def inside(points: DataFrame, spans: DataFrame, by: str, ts: str, start: str, end: str, width: float, how: str = "left_semi", pad: float = 0) -> DataFrame:
    """Points within start - pad .. end + pad (both ends included) of a span: left_semi, left_anti or inner.

    Spans are spread over the buckets of `width` that they touch; points have one bucket each.
    """
    points = points.withColumn("__bucket", F.floor(F.col(ts) / width))
    buckets = F.sequence(F.floor((F.col(start) - pad) / width), F.floor((F.col(end) + pad) / width))
    spans = spans.withColumn("__bucket", F.explode(buckets))
    condition = (points[by] == spans[by]) & (points["__bucket"] == spans["__bucket"]) & (points[ts] >= spans[start] - pad) & (points[ts] <= spans[end] + pad)
    out = points.join(spans.drop() if how != "inner" else spans, condition, how)
    if how == "inner":
        return out.drop(spans[by]).drop("__bucket")
    return out.drop("__bucket")


def holding(spans: DataFrame, points: DataFrame, by: str, ts: str, start: str, end: str, width: float, how: str = "left_anti") -> DataFrame:
    """Spans that hold (left_semi) or don't hold (left_anti) a point of their key."""
    hits = inside(points.select(by, ts), spans.select(by, start, end), by, ts, start, end, width, "inner").select(by, start, end).distinct()
    return spans.join(hits, [by, start, end], how)


def epochs(rows: DataFrame, by: str, ts: str, duration: float, origin: Column | None = None) -> DataFrame:
    """rows with `epoch`, the number of the half-open interval of `duration` that holds them, from the key's first time."""
    first = origin if origin is not None else F.min(ts).over(Window.partitionBy(by))
    return rows.withColumn("epoch", F.floor((F.col(ts) - first) / duration))


def epoch_value(spans: DataFrame, rows: DataFrame, by: str, ts: str, value: str, duration: float) -> DataFrame:
    """spans (by, epoch, start) with the median value of the rows in each, or of an empty one the value nearest to
    its middle, the earlier of a tie."""
    medians = spans.select(by, "epoch", "start")
    width = F.lit(duration)
    left = medians.withColumn("__bucket", F.explode(F.array(F.floor(F.col("start") / width), F.floor(F.col("start") / width) + 1)))
    right = rows.select(by, F.col(ts).alias("__t"), F.col(value).alias("__v"), F.floor(F.col(ts) / width).alias("__bucket"))
    found = left.join(right, [by, "__bucket"]).filter((F.col("__t") >= F.col("start")) & (F.col("__t") < F.col("start") + width))
    found = found.groupBy(by, "epoch").agg(F.percentile("__v", F.lit(0.5)).alias("__median"))
    joined = medians.join(found, [by, "epoch"], "left").withColumn(ts, F.col("start") + width / 2)
    near = nearest(joined, rows.select(by, F.col(ts).cast("double").alias(ts), value).withColumn("__n", F.col(ts)), by, ts, "__n")
    return near.select(by, "epoch", "start", F.coalesce("__median", F.col(f"hit.{value}")).alias(value))
