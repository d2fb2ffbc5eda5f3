"""Rates with Wilson intervals, and small statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Normal quantile of a two-sided 95 % interval (fixed value).
Z = 1.959963984540054


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper bound; an empty denominator raises an error, as an unknown rate is not zero."""
    total = F.when(n > 0, n.cast("double")).otherwise(F.raise_error(F.lit("a rate without observations")).cast("double"))
    p = successes / total
    middle = (p + z * z / (2 * total)) / (1 + z * z / total)
    half = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / (1 + z * z / total)
    low = F.when(p == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), middle - half))
    high = F.when(p == 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), middle + half))
    return low, high


def rate(successes: Column, n: Column) -> Column:
    """(num, den, value, lower, upper), or null where nothing was observed."""
    safe = F.when(n > 0, n)
    low, high = wilson(F.when(n > 0, successes).otherwise(0), F.coalesce(safe, F.lit(1)))
    return F.when(n > 0, F.struct(successes.cast("long").alias("num"), n.cast("long").alias("den"), (successes / n).alias("value"), low.alias("lower"), high.alias("upper")))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two rates' intervals meet."""
    return (a["lower"] <= b["upper"]) & (b["lower"] <= a["upper"])


def smallest_sample(spark: SparkSession, targets: list[float], z: float = Z) -> DataFrame:
    """(target, n): the least sample without a success whose upper bound, z^2 / (n + z^2), is at most the target."""

    def least(target: float) -> int:
        if not 0 < target <= 1:
            raise ValueError(f"a target lies above 0 and is at most 1: {target}")
        n = max(1, math.ceil(z * z * (1 - target) / target))
        while n > 1 and z * z / (n - 1 + z * z) <= target:
            n -= 1
        while z * z / (n + z * z) > target:
            n += 1
        return n

    return spark.createDataFrame([(float(t), least(t)) for t in targets], "target double, n long")
