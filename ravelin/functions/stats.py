"""Statistics as expressions, exact and with the stated null rules."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def total(c: Column | str) -> Column:
    """Sum; 0 over no values."""
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))


def mean0(c: Column | str) -> Column:
    """Average; 0 over no values."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def quantile(c: str | Column, *at: float) -> Column:
    """Exact quantiles with linear interpolation."""
    c = F.col(c) if isinstance(c, str) else c
    return F.percentile(c, F.array(*[F.lit(float(p)) for p in at]) if len(at) > 1 else F.lit(float(at[0])))


def adjusted_skewness(c: str) -> Column:
    """Sample skewness with the correction for small samples; null below three values."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def mid_rank(c: str, *by: str) -> Column:
    """Average rank of ties, from 1."""
    w = W.partitionBy(*by)
    return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(*by, c)) - 1) / 2


#: Ranges that a column is cut into for running sums.
RANGES = 64


def preceding(d: DataFrame, column: str, value: Column, alias: str, then: tuple = (), falling: bool = False) -> DataFrame:
    """Adds ``alias``: the sum of ``value`` over the rows before, in order of ``column`` and then of ``then`` (nulls last).

    The column is cut into ranges at approximate quantiles. Sums of ranges come first (RANGES + 2 rows, at most), then sums within
    a range, so no task sorts the whole table. Any cuts give the same result.
    """
    edges = d.agg(F.approx_percentile(column, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(1000)).alias("_edges"))
    at = F.size(F.filter("_edges", lambda e: e < F.col(column)))
    d = d.join(F.broadcast(edges)).withColumn("_range", F.when(F.col(column).isNull(), RANGES + 1).otherwise(-at if falling else at)).drop("_edges").withColumn("_value", value)
    sums = d.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    order = [F.desc_nulls_last(column) if falling else F.asc_nulls_last(column), *then]
    own = F.coalesce(F.sum("_value").over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("_own", own).join(F.broadcast(sums), "_range")
    return d.withColumn(alias, F.col("_own") + F.col("_before")).drop("_range", "_value", "_own", "_before")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, spearman): correlation of average ranks over rows where both are known.

    Ranks come from the counts of distinct values, so ties (however many) are summed before they are ordered.
    """
    d = df.select(x, y).na.drop()

    def ranks(c: str) -> DataFrame:
        n = preceding(d.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c, F.col("n"), "below")
        return n.select(F.col(c), (F.col("below") + (F.col("n") + 1) / 2).alias(f"_r_{c}"))

    return d.join(ranks(x), x).join(ranks(y), y).agg(F.count(F.lit(1)).alias("n"), F.corr(f"_r_{x}", f"_r_{y}").alias("spearman"))


def chi2_sf(x: float, k: int) -> float:
    """P(chi-square with k degrees > x), by the regularised incomplete gamma function."""
    if x <= 0 or k <= 0:
        return 1.0
    a, x = k / 2, x / 2
    if x < a + 1:
        term = total_ = 1 / a
        n = a
        while abs(term) > abs(total_) * 1e-15:
            n += 1
            term *= x / n
            total_ += term
        return max(0.0, 1 - total_ * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or 1e-300)
        c = (1 + num / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def f_sf(x: float, d1: int, d2: int) -> float:
    """P(F with d1, d2 degrees > x)."""
    return 1.0 if x <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def chi_square(table: np.ndarray) -> tuple[float, float, float]:
    """(statistic, p, Cramer's V) of a contingency table; the 2 x 2 case has the continuity correction."""
    table = table[table.sum(axis=1) > 0][:, table.sum(axis=0) > 0].astype(float)
    if min(table.shape) < 2:
        return 0.0, 1.0, 0.0
    n = table.sum()
    expected = np.outer(table.sum(axis=1), table.sum(axis=0)) / n
    off = np.abs(table - expected)
    plain = float((off**2 / expected).sum())
    if table.shape == (2, 2):
        off = np.maximum(0, off - np.minimum(0.5, off))
    stat = float((off**2 / expected).sum())
    dof = (table.shape[0] - 1) * (table.shape[1] - 1)
    return stat, chi2_sf(stat, dof), math.sqrt(plain / (n * (min(table.shape) - 1)))
