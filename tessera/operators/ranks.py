"""Ranks over all rows without a task that holds them: order statistics by brackets, running totals by ranges."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import materialize

#: Distinct values that are looked at one by one, and the error of a sketch that narrows a bracket.
HELD, SKETCH = 100_000, 1e-3
#: Rows of one range, and ranges that are broadcast.
RANGE_ROWS, MOST_BROADCAST = 1_000_000, 100_000


def order_statistics(values: DataFrame, ranks: Sequence[int], n: int) -> list[float]:
    """The values of these ranks (from 0) among the n rows of one column without nulls. A sketch brackets a rank, the
    rows below are counted, and the bracket is narrowed until it holds few distinct values or one only."""
    rows = values.toDF("x")
    return [_statistic(rows, k, n) for k in ranks] if n > HELD else _among(rows, list(ranks), 0)


def _among(rows: DataFrame, ranks: Sequence[int], below: int) -> list[float]:
    """Of so few rows that their counts by value fit the driver."""
    found = rows.groupBy("x").count().toPandas().sort_values("x")
    last = below + np.cumsum(found["count"].to_numpy())
    return found["x"].to_numpy(float)[np.searchsorted(last, ranks, side="right")].tolist()


def _statistic(rows: DataFrame, rank: int, n: int) -> float:
    inside, below, m = rows, 0, n
    while m > HELD:
        share = (rank - below) / m
        low, high = inside.approxQuantile("x", [max(share - 2 * SKETCH, 0.0), min(share + 2 * SKETCH, 1.0)], SKETCH)
        x = F.col("x")
        least, less, upto = inside.agg(F.min("x"), F.count_if(x < low), F.count_if(x <= high)).first()
        if not less <= rank - below < upto:  # beyond the sketch's bounds: the part beside it has fewer rows, too
            inside, below, m = (inside.where(x < low), below, less) if rank - below < less else (inside.where(x > high), below + upto, m - upto)
        elif low == high:
            return low
        elif upto - less == m:  # most rows share a value at an end
            at = inside.agg(F.count_if(x == low), F.count_if(x == high)).first()
            if rank - below < at[0]:
                return low
            if rank - below >= m - at[1]:
                return high
            inside, below, m = inside.where((x > low) & (x < high)), below + at[0], m - at[0] - at[1]
        else:
            inside, below, m = inside.where((x >= low) & (x <= high)), below + less, upto - less
    return _among(inside, [rank], below)[0]


def quantiles(values: DataFrame, shares: Sequence[float], n: int) -> list[float]:
    """Linearly interpolated quantiles of one column; NaN without rows."""
    if not n:
        return [math.nan] * len(shares)
    at = [q * (n - 1) for q in shares]
    ranks = sorted({k for a in at for k in (math.floor(a), math.ceil(a))})
    found = dict(zip(ranks, order_statistics(values, ranks, n), strict=True))
    low, high = ([found[f(a)] for a in at] for f in (math.floor, math.ceil))
    return [x if x == y else (math.ceil(a) - a) * x + (a - math.floor(a)) * y for a, x, y in zip(at, low, high, strict=True)]


def running_totals(rows: DataFrame, keys: Sequence[str], order: str, total: str, name: str) -> DataFrame:
    """rows with, as `name`, the sum of column `total` over the rows of the same keys that come before in the order
    (whose values differ). Rows are dealt over ranges of (keys, order), as many as their number asks for. Sums run within a
    range, and over the ranges' totals."""
    n = rows.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    dealt = rows.repartitionByRange(ranges, *keys, order) if ranges > 1 else rows.repartition(1)
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    before = lambda by, at, c: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if ranges == 1:
        return dealt.withColumn(name, before(keys, order, total)).drop("_part")
    sums = dealt.groupBy(*keys, "_part").agg(F.sum(total).alias("_sum"))
    sums = sums.withColumn("_lower", before(keys, "_part", "_sum")).drop("_sum")  # a row for each range of a key
    within = dealt.withColumn("_within", before([*keys, "_part"], order, total))
    met = within.join(F.broadcast(sums) if ranges <= MOST_BROADCAST else sums, [*keys, "_part"])
    return met.withColumn(name, F.col("_lower") + F.col("_within")).drop("_part", "_lower", "_within")
