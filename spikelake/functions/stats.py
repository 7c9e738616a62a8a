"""Distribution functions and fits in numpy, for the p-values that SQL lacks."""

from __future__ import annotations

import math

import numpy as np


def beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d, out = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1)), 0.0
    out = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or 1e-300)
            c = 1 + k / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def correlation_p(r: float, n: int) -> float:
    """The two-sided p-value of a correlation of n pairs."""
    if n < 3 or not math.isfinite(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return beta_tail(df / (df + t2), df / 2, 0.5)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """By Newton's method on the distribution function."""
    x = 0.0
    for _ in range(60):
        step = (1 - normal_tail(x) - p) / (math.exp(-x * x / 2) / math.sqrt(2 * math.pi))
        x -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-14:
            break
    return x


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and its p-value by Royston's approximation (1992, 1995), for 4 to 5000 values."""
    y = np.sort(np.asarray(x, float))
    n = len(y)
    if n < 4 or y[0] == y[-1]:
        return math.nan, math.nan
    m = np.array([normal_quantile((i + 1 - 0.375) / (n + 0.25)) for i in range(n)])
    mm, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(mm)
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, a[-1]], u)
    if n > 5:
        second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a = m / math.sqrt(phi)
        a[[1, -2]] = -second, second
    else:
        a = m / math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    a[[0, -1]] = -last, last
    w = float((a @ y) ** 2 / np.sum((y - y.mean()) ** 2))
    if w >= 1:  # by rounding
        return 1.0, 1.0
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if gamma - math.log1p(-w) <= 0:
            return w, 0.0
        z = (-math.log(gamma - math.log1p(-w)) - np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)) / math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        l = math.log(n)  # noqa: E741
        z = (math.log1p(-w) - np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], l)) / math.exp(np.polyval([0.0030302, -0.082676, -0.4803], l))
    return w, normal_tail(z)


def chi2_tail(x: np.ndarray, df: int) -> np.ndarray:
    """Of an even number of degrees of freedom."""
    half, term = np.asarray(x, float) / 2, 1.0
    total = np.ones_like(half)
    for k in range(1, df // 2):
        term = term * half / k
        total = total + term
    return np.exp(-half) * total
