"""Averages, deviations and scores that do not depend on the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from gridtally.schema import ENERGY, TOTAL


def average(total: Column, count: Column, to: T.DecimalType = ENERGY) -> Column:
    """``total / count`` rounded once, half up, to four decimals.

    Dividing the exact decimal sum keeps about 20 decimals, so no tie is lost as it
    is when an average is rounded twice. NULL for an empty group.
    """
    quotient = total.cast(TOTAL) / F.nullif(count, F.lit(0))
    return quotient.cast(to)


def mean_of(column: str) -> Column:
    """Aggregate: the mean of the non-NULL values of a decimal column."""
    return average(F.sum(column), F.count(column))


def sample_stddev(count: Column, total: Column, total_of_squares: Column) -> Column:
    """Sample standard deviation from a count, a sum and a sum of squares.

    n * sum(x^2) - sum(x)^2 is formed in decimals, exactly: nothing cancels, a
    household with equal readings gets 0.0, and a task that runs twice cannot change
    the result. The types hold 10^12 readings per household with a sum of squares of
    10^16; beyond that the cast raises. NULL for fewer than two readings.
    """
    n = count.cast("decimal(12,0)")
    sum_x = total.cast("decimal(18,4)")
    sum_xx = total_of_squares.cast("decimal(24,8)")
    spread = (n * sum_xx - sum_x * sum_x).cast("double")
    pairs = count.cast("double") * (count - F.lit(1)).cast("double")
    return F.when(count > 1, F.sqrt(spread / pairs))


def z_score(value: Column, mean: Column, stddev: Column) -> Column:
    """Distance from the mean in standard deviations; 0 where there is no deviation."""
    distance = F.abs(value - mean).cast("double")
    return F.when(stddev > 0, distance / stddev).otherwise(F.lit(0.0))
