"""Scalar functions on columns, and on numbers where an argument is no column."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores are kept this far from 0 and 1 before a logarithm.
SCORE_EPS = 1e-6
#: Distances are ranked on a grid of this many steps a unit, so that equal ones tie exactly.
ORDER_GRID = 1e10

_INF = float("inf")


def expit(x):
    """Inverse logit that does not overflow on either side."""
    if isinstance(x, (Column, str)):
        c = F.col(x) if isinstance(x, str) else x
        return F.when(c >= 0, 1.0 / (1.0 + F.exp(-c))).otherwise(F.exp(c) / (1.0 + F.exp(c)))
    v = np.asarray(x, float)
    e = np.exp(-np.abs(v))
    out = np.where(v >= 0, 1.0, e) / (1.0 + e)
    return out if out.ndim else float(out)


def logit(p, eps: float = 0.0):
    """Log-odds. With eps > 0 scores are first kept within [eps, 1 - eps]; else 0 and 1 give the infinities."""
    if isinstance(p, (Column, str)):
        c = F.col(p) if isinstance(p, str) else p
        if eps > 0:
            c = clip(c, eps)
        # ln(0) is null in Spark
        return F.when(c <= 0, F.lit(-_INF)).when(c >= 1, F.lit(_INF)).otherwise(F.ln(c) - F.ln(1.0 - c))
    v = np.asarray(p, float)
    if eps > 0:
        v = np.clip(v, eps, 1 - eps)
    with np.errstate(divide="ignore"):
        out = np.log(v) - np.log1p(-v)
    return out if out.ndim else float(out)


def clip(c: Column, eps: float = SCORE_EPS) -> Column:
    return F.least(F.greatest(c, F.lit(eps)), F.lit(1 - eps))


def transform_score(c: Column, space: str) -> Column:
    """A propensity score on the scale that distances are measured on."""
    if space not in ("raw", "logit"):
        raise ValueError(f'gps_space must be "raw" or "logit", got {space!r}')
    return c if space == "raw" else logit(c, SCORE_EPS)


def order_key(c):
    """The grid point of a distance, halves to even."""
    if isinstance(c, (Column, str)):
        return F.rint((F.col(c) if isinstance(c, str) else c) * ORDER_GRID)
    return np.rint(np.asarray(c, float) * ORDER_GRID)


def log_ratio(p: Column, q: Column) -> Column:
    return F.ln(clip(p)) - F.ln(clip(q))


def squares(differences: list[Column]) -> Column:
    """Sum of squares, first to last."""
    return reduce(lambda a, b: a + b, [d * d for d in differences])


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(squares([x - y for x, y in zip(a, b, strict=True)]))


def array_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two equally long arrays, summed first to last."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def triangle(d_r1: Column, d_r2: Column, d_12: Column) -> Column:
    """A trio's perimeter; the order of the sum is part of its value."""
    return (d_r1 + d_r2) + d_12


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return out


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on its distribution function."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    upper = lambda t: 0.5 * _incomplete_beta(df / 2, 0.5, df / (df + t * t))
    low, high = 0.0, 1.0
    while upper(high) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if upper(mid) > 1 - p else (low, mid)
    return (low + high) / 2
