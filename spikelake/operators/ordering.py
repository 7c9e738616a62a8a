"""Places in a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import kept


def dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with __p, the range of the order that each lies in, and __i, its place there from 0.

    They are written, since the bounds of ranges are sampled anew, and ranges joined by their size, in each plan that deals
    rows out: what two plans take from one range need not be the same.
    """
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    return kept(rows).select("*", F.shiftright("__m", 33).cast("int").alias("__p"), F.col("__m").bitwiseAND((1 << 33) - 1).alias("__i")).drop("__m")


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The place of each row, from 1: rows are dealt out by ranges, numbered within each, and offset by the counts before.

    The order should be total, for ties are numbered as they come.
    """
    found = dealt(rows, order)
    counts = found.groupBy("__p").agg((F.max("__i") + 1).alias("__n"))
    offset = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__p", offset.alias("__before"))  # a row for each partition
    return found.join(F.broadcast(counts), "__p").withColumn(name, (F.col("__i") + F.col("__before") + 1).cast("long")).drop("__p", "__i", "__before")
