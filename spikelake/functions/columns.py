"""Column expressions that hold under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's r over the pairs of which neither is null; null where either doesn't vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.covar_pop(x, y) / F.when(spread > 0, spread)


def divided(x: Column, y: Column) -> Column:
    """x / y of doubles, by zero too: infinite with the sign of x, or not a number for zero by zero."""
    beyond = F.when(x > 0, float("inf")).when(x < 0, float("-inf")).when(x.isNotNull(), float("nan"))
    return F.when(y == 0, beyond).otherwise(x / F.nullif(y, F.lit(0.0)))


def student_p(t: Column, df: Column) -> Column:
    """The two-sided p-value of Student's t with a whole number of degrees of freedom, by its finite series; its absolute
    error is that of doubles near 1. Null below one degree of freedom."""
    df = df.cast("long")
    odd = df % 2 == 1
    square = t * t / df
    cos2, sin = 1 / (1 + square), F.sqrt(square / (1 + square))
    terms = F.greatest(F.lit(0), F.floor((df - F.when(odd, 1).otherwise(0)) / 2)).cast("int")
    factor = lambda j: F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / F.greatest(F.lit(1), 2 * j))
    empty = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda a, j: F.struct((F.when(j == 0, 1.0).otherwise(a["term"] * factor(j) * cos2)).alias("term"), (a["sum"] + F.when(j == 0, 1.0).otherwise(a["term"] * factor(j) * cos2)).alias("sum"))
    index = F.when(terms > 0, F.sequence(F.lit(0), terms - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(index, empty, step, lambda a: a["sum"])
    angle = F.atan(F.sqrt(square))
    inside = F.when(odd, 2 / F.pi() * (angle + sin * F.sqrt(cos2) * total)).otherwise(sin * total)
    return F.when(df >= 1, F.greatest(F.lit(0.0), 1 - inside))
