"""Power of two-proportion contrasts and of interactions; a handful of rows, computed with the normal distribution of the standard library."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_Z = NormalDist()
#: The noncentrality at which an interaction of 4 degrees of freedom has a power of 80% at 5%.
LAMBDA_80 = 11.94
MAX_TESTS = 100_000  # that are ranked in one task


def normal_cdf(x: Column) -> Column:
    def cdf(values: pd.Series) -> pd.Series:
        return values.map(_Z.cdf, na_action="ignore")

    return F.pandas_udf(cdf, "double")(x)


def bonferroni(alpha: float, tests: int) -> float:
    return alpha / tests


def two_proportion_power(p1: Column, p2: Column, n1: Column, n2: Column, alpha: float = 0.05) -> Column:
    """Power of the unpooled z test; null where both proportions have no variance."""
    spread = F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    return normal_cdf(F.try_divide(F.abs(p1 - p2), spread) - F.lit(_Z.inv_cdf(1 - alpha / 2)))


def required_n(p1: Column, p2: Column, ratio: float, power: float = 0.8, alpha: float = 0.05) -> Column:
    """Replies of the first group that give the power when the second has ``ratio`` times as many."""
    z = _Z.inv_cdf(1 - alpha / 2) + _Z.inv_cdf(power)
    return F.ceil(F.try_divide(F.lit(z * z) * (p1 * (1 - p1) + p2 * (1 - p2) / ratio), (p1 - p2) * (p1 - p2)))


def threads_needed(n_real: Column, real_per_thread: float) -> Column:
    return F.ceil(n_real / real_per_thread)


def interaction_threads(chi2: Column, df: int, threads: float, target: float = LAMBDA_80) -> Column:
    """Threads at which the noncentrality chi2 - df, seen on ``threads`` threads, reaches the target."""
    return F.ceil(F.try_divide(F.lit(threads * target), chi2 - df))


def contrasts(rows: DataFrame, scale: float = 1.0, alpha: float = 0.05) -> DataFrame:
    """Adds power to rows of p1, p2, n1, n2, with both n multiplied by ``scale``."""
    return rows.withColumn("power", two_proportion_power(F.col("p1"), F.col("p2"), F.col("n1") * scale, F.col("n2") * scale, alpha))


def benjamini_hochberg(rows: DataFrame, p: str = "p_value") -> DataFrame:
    """Adds the adjusted p-value; for tables of tests, which are small."""
    from pyspark.sql import Window

    if rows.limit(MAX_TESTS + 1).count() > MAX_TESTS:
        raise ValueError(f"more than {MAX_TESTS} tests")
    up, down = (Window.orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.col(p), F.col(p).desc()))
    m = F.count("*").over(Window.partitionBy())
    raw = rows.withColumn("_adj", F.col(p) * m / F.count("*").over(up))
    return raw.withColumn("p_adjusted", F.least(F.min("_adj").over(down), F.lit(1.0))).drop("_adj")


def option_cost(calls: Column, price: float = 0.0032) -> Column:
    return calls * price
