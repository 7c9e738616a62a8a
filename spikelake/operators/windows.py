"""Window operators: differences, gap filling, outlier flags, islands, adjusted p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import dealt

MAD_SCALE = 1.4826


def differences(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """d_<column>: the next value less this one; the last row repeats the difference before it."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumns({f"d_{c}": F.coalesce(F.lead(c).over(w) - F.col(c), F.col(c) - F.lag(c).over(w)) for c in columns})


def speed(rows: DataFrame, by: str, ts: str, x: str, y: str, unit: float = 1e6) -> DataFrame:
    """speed: distance to the row before by time in seconds (`unit` ticks each); 0 in the first row."""
    w = Window.partitionBy(by).orderBy(ts)
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) / ((F.col(ts) - F.lag(ts).over(w)) / unit)
    return rows.withColumn("speed", F.coalesce(step, F.lit(0.0)))


def jump_flags(rows: DataFrame, by: str, order: str, x: str, y: str, ts: str, limit: float) -> DataFrame:
    """jump: a step faster than the limit leads to the row or away from it."""
    w = Window.partitionBy(by).orderBy(order)
    step = F.hypot(F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)) / (F.lead(ts).over(w) - F.col(ts))
    fast = F.coalesce(step > limit, F.lit(False))
    return rows.withColumn("__fast", fast).withColumn("jump", F.col("__fast") | F.coalesce(F.lag("__fast").over(w), F.lit(False))).drop("__fast")


def interpolated(rows: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """Nulls of a column filled in a straight line over row numbers, and at both ends by the nearest value."""
    w = Window.partitionBy(by).orderBy(order)
    rows = rows.withColumn("__i", F.row_number().over(w))
    known = F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("v"), F.col("__i").alias("i")))
    rows = rows.withColumn("__a", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__b", F.last(known, ignorenulls=True).over(Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)))
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col("__i") - F.col("__a.i")) / (F.col("__b.i") - F.col("__a.i"))
    return rows.withColumn(column, F.coalesce(F.col(column), line, F.col("__a.v"), F.col("__b.v"))).drop("__i", "__a", "__b")


def hampel(rows: DataFrame, by: str, order: str, column: str, half: int = 5, times: float = 3.0, least: float = 2.0) -> DataFrame:
    """outlier: further from the centred running median than max(times * 1.4826 * MAD, least)."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-half, half)
    rows = rows.withColumn("__m", F.percentile(column, F.lit(0.5)).over(w))
    rows = rows.withColumn("__d", F.abs(F.col(column) - F.col("__m")))
    mad = F.percentile("__d", F.lit(0.5)).over(w)
    return rows.withColumn("outlier", F.col("__d") > F.greatest(times * MAD_SCALE * mad, F.lit(least))).drop("__m", "__d")


def moving_average(rows: DataFrame, by: str, order: str, column: str, half: int, name: str) -> DataFrame:
    """The mean of 2 * half + 1 rows, the end values standing for what lies beyond the ends."""
    ends = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = Window.partitionBy(by).orderBy(order)
    place, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(by))
    total = F.sum(column).over(w.rowsBetween(-half, half))
    before, after = F.greatest(F.lit(0), half + 1 - place), F.greatest(F.lit(0), place + half - n)
    return rows.withColumn(name, (total + before * F.first(column).over(ends) + after * F.last(column).over(ends)) / (2 * half + 1))


def weighted(rows: DataFrame, by: str, order: str, column: str, weights: list[float], name: str) -> DataFrame:
    """A dot product of the rows around with symmetric weights, the end values repeated beyond the ends."""
    half = len(weights) // 2
    w = Window.partitionBy(by).orderBy(order)
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(column).over(ends), F.last(column).over(ends)
    at = lambda k: F.coalesce((F.lag if k < 0 else F.lead)(column, abs(k)).over(w), first if k < 0 else last)
    parts = [F.lit(float(x)) * at(k - half) for k, x in enumerate(weights)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return rows.withColumn(name, out)


def islands(rows: DataFrame, by: str, order: str, above: Column) -> DataFrame:
    """start and stop of each run above the threshold: the row before its rise, and its last row; runs that touch
    either end of the rows are dropped. `order` numbers the rows without gaps."""
    w = Window.partitionBy(by).orderBy(order)
    rows = rows.withColumn("__up", above).withColumn("__was", F.lag("__up").over(w)).withColumn("__will", F.lead("__up").over(w))
    rise = F.col("__up") & ~F.coalesce(F.col("__was"), F.lit(True))
    run = F.sum(F.when(F.col("__up") & ~F.coalesce(F.col("__was"), F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumns({"__run": run, "__rise": rise}).filter("__up")
    runs = runs.groupBy(by, "__run").agg((F.min(order) - 1).alias("start"), F.max(order).alias("stop"), F.max("__rise").alias("__from"), F.max(F.col("__will").isNull()).alias("__open"))
    return runs.filter("__from AND NOT __open").select(by, "start", "stop")


def merged(spans: DataFrame, by: str, gap: float) -> DataFrame:
    """Spans joined to those before them when they begin less than `gap` after these end."""
    w = Window.partitionBy(by).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") - reach < gap, 0).otherwise(1)
    spans = spans.withColumn("__new", new).withColumn("__group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy(by, "__group").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__group")


def sliding_mean(rows: DataFrame, by: str, order: str, column: str, k: int, good: str) -> DataFrame:
    """mean of the k rows from each on, and whether all are good; rows without k rows ahead are dropped."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(0, k - 1)
    rows = rows.withColumns({"mean": F.avg(column).over(w), "all_good": F.min(F.col(good).cast("int")).over(w) == 1, "__n": F.count(F.lit(1)).over(w)})
    return rows.filter(F.col("__n") == k).drop("__n")


def adjusted_p(rows: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """p_adj: Benjamini-Hochberg over the rows whose p isn't null (of each group).

    Rows are dealt out by ranges of p, and numbered within each; what ranges below and above add, a count and a least value
    for each range, is joined back. So neither all rows nor those of a large group meet in one task.
    """
    by = by or []
    known = dealt(rows.filter(F.col(p).isNotNull()), [*by, p]).withColumnRenamed("__p", "__part")
    own = Window.partitionBy("__part", *by)
    known = known.withColumn("__i", F.row_number().over(own.orderBy("__i")))
    parts = known.groupBy("__part", *by).agg(F.max("__i").alias("__n"))
    order = Window.partitionBy(*by).orderBy("__part")  # a row for each range
    before = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__part", *by, before.alias("__before"), F.sum("__n").over(Window.partitionBy(*by)).alias("__all"))
    ranked = _beside(known, parts, ["__part", *by])
    ranked = ranked.withColumn("__q", F.col(p) * F.col("__all") / (F.col("__i") + F.col("__before")))
    ranked = ranked.withColumn("__least", F.min("__q").over(own.orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, 0)))
    later = ranked.groupBy("__part", *by).agg(F.min("__q").alias("__q"))
    later = later.select("__part", *by, F.min("__q").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__later"))
    found = _beside(ranked, later, ["__part", *by])
    found = found.withColumn("p_adj", F.least("__least", "__later", F.lit(1.0))).drop("__part", "__i", "__before", "__all", "__q", "__least", "__later")
    return found.unionByName(rows.filter(F.col(p).isNull()).withColumn("p_adj", F.lit(None).cast("double")))


def _beside(rows: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of values, whose keys may be null."""
    values = values.select(*[F.col(c).alias(f"__of{c}") for c in on], *[c for c in values.columns if c not in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__of{c}"))
    return rows.join(values, same).drop(*(f"__of{c}" for c in on))


def rolled(rows: DataFrame, by: str, i: str, column: str, shift: int, name: str) -> DataFrame:
    """The value `shift` rows before, around the circle of the key's rows; i counts them from 0."""
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    moved = rows.join(n, by).select(by, F.pmod(F.col(i) + shift, F.col("__n")).alias(i), F.col(column).alias(name))
    return rows.join(moved, [by, i])
