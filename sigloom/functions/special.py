"""Special functions of small driver-side tables, and column forms that skip nulls on purpose."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST = -1.7976931348623157e308


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by the continued fraction of the nearer tail."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    total = d
    for m in range(1, 10_000):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + n * d or tiny)
            c = 1 + n / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def betainc_many(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``betainc`` of arrays: the continued fraction runs over all entries that have not settled."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    shape = a.shape
    a, b, x = a.ravel(), b.ravel(), x.ravel()
    far = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(far, b, a), np.where(far, a, b), np.where(far, 1 - x, x)
    inner = (x > 0) & (x < 1)
    out = np.where(x >= 1, 1.0, 0.0)
    at = np.flatnonzero(inner)
    a, b, x = a[at], b[at], x[at]
    gamma = np.frompyfunc(math.lgamma, 1, 1)
    front = np.exp((gamma(a + b) - gamma(a) - gamma(b)).astype(float) + a * np.log(x) + b * np.log1p(-x)) / a
    nonzero = lambda v: np.where(v == 0, 1e-300, v)
    c, d = np.ones(len(a)), 1 / nonzero(1 - (a + b) * x / (a + 1))
    total, live = d.copy(), np.arange(len(a))
    for m in range(1, 10_000):
        if not len(live):
            break
        p, q, y = a[live], b[live], x[live]
        for n in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d[live] = 1 / nonzero(1 + n * d[live])
            c[live] = nonzero(1 + n / c[live])
            total[live] *= c[live] * d[live]
        live = live[np.abs(c[live] * d[live] - 1) >= 1e-15]
    out[at] = front * total
    return np.where(far, 1 - out, out).reshape(shape)


def binomial_below(counts: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(Binomial(n, p) <= counts), where counts and n need not be whole."""
    return betainc_many(np.maximum(n - counts, 1e-3), counts + 1, 1 - p)


def normal_tail(z: float) -> float:
    """P(Z > z) of the standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def rounded(value: Column, digits: int = 4) -> Column:
    """For comparable output: rounded, without a negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def masked_log2(x: Column) -> Column:
    """log2 where it is finite, else 0."""
    return F.when((x > 0) & (x < F.lit(float("inf"))), F.log2(x)).otherwise(F.lit(0.0))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def log_sum_exp(a: Column) -> Column:
    """ln of the sum of exponentials of an array, shifted by its largest."""
    most = F.array_max(a)
    return most + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - most)))
