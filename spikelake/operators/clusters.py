"""Cluster isolation: covariance, Mahalanobis distances, L-ratio, isolation distance and its null model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(terms: list[str]) -> str:
    return " + ".join(terms) or "0D"


def moments(points: DataFrame, by: list[str], features: list[str], ridge: float = 1e-10) -> DataFrame:
    """nc, the means m_i and the sample covariances a_i_j (i >= j) of the features of each cluster, with a ridge on the
    diagonal; d_i and l_i_j: the covariance matrix as L D L'. One select, in which each factor stands on those before it."""
    k = range(len(features))
    sums = [F.avg(c).alias(f"m_{i}") for i, c in enumerate(features)]
    sums += [(F.covar_samp(features[i], features[j]) + (ridge if i == j else 0.0)).alias(f"a_{i}_{j}") for i in k for j in range(i + 1)]
    factors = []
    for j in k:
        factors.append(f"a_{j}_{j} - ({_sum([f'l_{j}_{x} * l_{j}_{x} * d_{x}' for x in range(j)])}) AS d_{j}")
        factors += [f"try_divide(a_{i}_{j} - ({_sum([f'l_{i}_{x} * l_{j}_{x} * d_{x}' for x in range(j)])}), d_{j}) AS l_{i}_{j}" for i in range(j + 1, len(features))]
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("nc"), *sums).selectExpr("*", *factors)


def distances(points: DataFrame, file: str, by: str, key: str, features: list[str], ridge: float = 1e-10) -> DataFrame:
    """file, cluster, key, own, nc, n (points of the file) and d2: the squared Mahalanobis distance of every point from
    every cluster of its file, by any number of features.

    A file's points meet each of its clusters, whose noise is all other points; the covariance is solved once a cluster.
    """
    k = range(len(features))
    m = moments(points, [file, by], features, ridge).withColumnRenamed(by, "cluster")
    m = m.withColumn("n", F.sum("nc").over(Window.partitionBy(file)))
    rows = points.select(file, F.col(by).alias("__own"), key, *[F.col(c).alias(f"f_{i}") for i, c in enumerate(features)]).join(m, file)
    steps = [f"f_{i} - m_{i} - ({_sum([f'l_{i}_{j} * z_{j}' for j in range(i)])}) AS z_{i}" for i in k]
    d2 = _sum([f"try_divide(z_{i} * z_{i}, d_{i})" for i in k])
    return rows.selectExpr(f"`{file}`", "cluster", f"`{key}`", "__own = cluster AS own", "nc", "n", *steps, f"{d2} AS d2").select(file, "cluster", key, "own", "nc", "n", "d2")


def chi2_tail(d2: Column, df: int) -> Column:
    """The chance that chi-squared of an even number of degrees of freedom is larger: exp(-x/2) sum (x/2)^k / k!."""
    half = d2 / 2
    term = total = F.lit(1.0)
    for k in range(1, df // 2):
        term = term * half / k
        total = total + term
    return F.exp(-half) * total


def l_ratio(rows: DataFrame, df: int, file: str = "file") -> DataFrame:
    """l_ratio: the summed chance of the other points to lie as far out as they do, for each point of the cluster."""
    return rows.groupBy(file, "cluster").agg((F.sum(F.when(~F.col("own"), chi2_tail(F.col("d2"), df)).otherwise(0.0)) / F.first("nc")).alias("l_ratio"))


def isolation(rows: DataFrame, key: str, file: str = "file") -> DataFrame:
    """iso: the distance of the nc-th nearest other point; null if the cluster holds more than half of its file's points.

    Counts of points by ranges of d2, 64 to a doubling, tell in which range the nc-th lies; only that one is put in order.
    """
    band = F.when(F.col("d2") > 0, F.floor(F.log2("d2") * 64)).otherwise(F.lit(-(1 << 40)))
    other = ~F.col("own") & (2 * F.col("nc") <= F.col("n"))
    rows = rows.withColumn("__band", band)
    counts = rows.groupBy(file, "cluster", "nc", "__band").agg(F.count_if(other).alias("__c"))
    below = F.sum("__c").over(Window.partitionBy(file, "cluster").orderBy("__band").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")
    here = (F.col("__below") < F.col("nc")) & (F.col("nc") <= F.col("__below") + F.col("__c"))
    found = counts.withColumn("__below", below).groupBy(file, "cluster").agg(F.max(F.when(here, F.struct("__band", "__below"))).alias("__at"))
    where = found.filter("__at IS NOT NULL").select(file, "cluster", "__at.__band", "__at.__below")
    w = Window.partitionBy(file, "cluster").orderBy("d2", key)
    nth = rows.filter(other).join(where, [file, "cluster", "__band"]).withColumn("__r", F.row_number().over(w) + F.col("__below"))
    nth = nth.filter(F.col("__r") == F.col("nc")).select(file, "cluster", F.col("d2").alias("iso"))
    return found.select(file, "cluster").join(nth, [file, "cluster"], "left")


def pool(rows: DataFrame, key: str, times: int = 3, file: str = "file") -> DataFrame:
    """The `times` * nc nearest other points of each cluster."""
    w = Window.partitionBy(file, "cluster").orderBy("d2", key)
    return rows.filter("NOT own").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= times * F.col("nc"))


def label(l_ratio: Column, iso: Column) -> Column:
    return F.when((l_ratio < 0.2) & (iso > 10), "Good").otherwise("Poor")


def shuffle_label(p: Column, level: float = 0.05) -> Column:
    return F.when(p.isNull(), "N/A").when(p < level, "Yes").otherwise("No")
