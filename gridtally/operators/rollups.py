"""Consumption per hour, day, week, month and household.

All but the hourly rollup start from ``household_days``: the readings are summed per
household and day on the map side, then shuffled, and the rest works on a table that
is smaller by the number of readings per day. Every group is summed before it is
shuffled, so neither a household nor a day with a large share of all readings makes a
large task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridtally.functions.measures import average
from gridtally.functions.periods import hour_of, month_of, week_of
from gridtally.schema import DATASETS, ENERGY, HOUSEHOLD_DAY, HOUSEHOLD_DAY_STATE, TOTAL, conform


def household_days(readings: DataFrame) -> DataFrame:
    """Count, sum, sum of squares and bounds per household and day."""
    value = F.col("energy_kwh")
    return readings.groupBy("lclid", "day").agg(
        F.count("*").alias("reading_count"),
        F.sum(value).alias("total_kwh"),
        F.sum(value * value).alias("total_kwh_squared"),
        F.max(value).alias("max_kwh"),
        F.min(value).alias("min_kwh"),
    )


def household_day_state(readings: DataFrame) -> DataFrame:
    """What all rollups need of the readings of a household and day, in one pass.

    ``midnight`` is the day of the timestamp, which may differ from ``day``. ``hours``
    has a bit for each hour that the household was seen in; days have up to 25 hours
    where clocks are set back.
    """
    value = F.col("energy_kwh")
    state = _with_hours(readings).groupBy("lclid", "day", "midnight").agg(
        F.count("*").alias("reading_count"),
        F.sum(value).alias("total_kwh"),
        F.sum(value * value).alias("total_kwh_squared"),
        F.max(value).alias("max_kwh"),
        F.min(value).alias("min_kwh"),
        F.bit_or("hours").alias("hours"),
    )
    return conform(state, HOUSEHOLD_DAY_STATE)


def _with_hours(readings: DataFrame) -> DataFrame:
    """``readings`` with ``midnight`` and, as ``hours``, the bit of their hour."""
    position = F.expr("CAST((unix_seconds(timestamp) - unix_seconds(midnight)) DIV 3600 AS INT)")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), position)
    return readings.withColumn("midnight", F.date_trunc("day", "timestamp")).withColumn("hours", bit)


def one_row_a_day(state: DataFrame) -> bool:
    """Whether every time lies on its ``day``, so that a stored state has each household and day once."""
    return state.where(F.col("midnight") != F.col("day").cast("timestamp")).isEmpty()


def days_of(state: DataFrame, once: bool = False) -> DataFrame:
    """``household_days`` from their state; nothing is summed or shuffled if each stands there ``once``."""
    if once:
        return conform(state, HOUSEHOLD_DAY)
    days = state.groupBy("lclid", "day").agg(
        F.sum("reading_count").alias("reading_count"),
        F.sum("total_kwh").alias("total_kwh"),
        F.sum("total_kwh_squared").alias("total_kwh_squared"),
        F.max("max_kwh").alias("max_kwh"),
        F.min("min_kwh").alias("min_kwh"),
    )
    return conform(days, HOUSEHOLD_DAY)


def hour_sums(readings: DataFrame, *keys: Column) -> DataFrame:
    """Count, sum and bounds per hour, and per further ``keys`` in front of it.

    A row per group and map task is shuffled.
    """
    return readings.groupBy(*keys, hour_of(F.col("timestamp")).alias("hour")).agg(
        F.count("*").alias("reading_count"),
        F.sum("energy_kwh").cast(TOTAL).alias("total_kwh"),
        F.max("energy_kwh").cast(ENERGY).alias("max_kwh"),
        F.min("energy_kwh").cast(ENERGY).alias("min_kwh"),
    )


def hourly_rollup(readings: DataFrame) -> DataFrame:
    """Sums per hour, joined with the households per hour.

    Counting households in the same aggregation would shuffle a row per household
    and hour with all sums. Apart, the sums need one row per hour and map task, and
    the count one row per household and day.
    """
    return hourly_of(hour_sums(readings), _with_hours(readings))


def hourly_of(sums: DataFrame, seen: DataFrame, once: bool = False) -> DataFrame:
    """The hourly rollup from hour sums, also partial ones, and the hours of households."""
    merged = sums.groupBy("hour").agg(
        F.sum("total_kwh").alias("total_consumption"),
        average(F.sum("total_kwh"), F.sum("reading_count")).alias("avg_consumption"),
        F.max("max_kwh").alias("max_consumption"),
        F.min("min_kwh").alias("min_consumption"),
    )
    return conform(merged.join(households_per_hour(seen, once), "hour", "left"), DATASETS["hourly"])


def households_per_hour(seen: DataFrame, once: bool = False) -> DataFrame:
    """Number of distinct households in each hour, from the bits in ``hours``.

    ``seen`` has ``lclid, midnight, hours`` in any number of rows, or each household and
    midnight ``once``.
    """
    household_days = seen
    if not once:
        household_days = seen.groupBy("lclid", "midnight").agg(F.bit_or("hours").alias("hours"))
    counts = [F.sum(F.getbit("hours", F.lit(hour)).cast("bigint")) for hour in range(25)]
    days = household_days.groupBy("midnight").agg(F.array(*counts).alias("counts"))
    hours = days.select("midnight", F.posexplode("counts").alias("hour", "household_count"))
    start = F.timestamp_seconds(F.unix_seconds("midnight") + F.col("hour") * 3600)
    return hours.where("household_count > 0").select(start.alias("hour"), "household_count")


def daily_rollup(days: DataFrame) -> DataFrame:
    return _rollup(days, "daily", F.col("day"), F.count("*"))


def weekly_rollup(days: DataFrame) -> DataFrame:
    return _rollup(days, "weekly", week_of(F.col("day")), F.countDistinct("lclid"))


def monthly_rollup(days: DataFrame) -> DataFrame:
    return _rollup(days, "monthly", month_of(F.col("day")), F.countDistinct("lclid"))


def _rollup(days: DataFrame, dataset: str, period: Column, households: Column) -> DataFrame:
    """Roll household days up to ``period``, the first column of ``dataset``."""
    schema = DATASETS[dataset]
    rolled = days.groupBy(period.alias(schema.names[0])).agg(
        F.sum("total_kwh").alias("total_consumption"),
        average(F.sum("total_kwh"), F.sum("reading_count")).alias("avg_consumption"),
        F.max("max_kwh").alias("max_consumption"),
        F.min("min_kwh").alias("min_consumption"),
        households.alias("household_count"),
    )
    return conform(rolled, schema)


def household_stats(days: DataFrame) -> DataFrame:
    """Total per household, and average, largest and smallest single reading.

    The ``*_daily_*`` names are those of the warehouse table; the values are per
    reading. ``household_true_daily`` has the values per day.
    """
    stats = days.groupBy("lclid").agg(
        F.sum("total_kwh").alias("total_consumption"),
        average(F.sum("total_kwh"), F.sum("reading_count")).alias("avg_daily_consumption"),
        F.max("max_kwh").alias("max_daily_consumption"),
        F.min("min_kwh").alias("min_daily_consumption"),
        F.count("*").alias("days_count"),
    )
    return conform(stats, DATASETS["household_stats"])


def household_true_daily(days: DataFrame) -> DataFrame:
    """Total per household, and average, largest and smallest sum of a day."""
    day_total = F.col("total_kwh").cast(TOTAL)
    return days.groupBy("lclid").agg(
        F.sum("total_kwh").cast(TOTAL).alias("total_consumption"),
        average(F.sum("total_kwh"), F.count("*"), TOTAL).alias("avg_daily_consumption"),
        F.max(day_total).alias("max_daily_consumption"),
        F.min(day_total).alias("min_daily_consumption"),
        F.count("*").cast("int").alias("days_count"),
    )
