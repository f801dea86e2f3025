"""Report queries on the rollups, each for a period of days (both ends included)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from gridtally.functions.measures import mean_of
from gridtally.functions.periods import day_in, time_in
from gridtally.schema import ENERGY, TOTAL, WEEKDAYS

MEASURES = ("total_consumption", "avg_consumption", "max_consumption", "min_consumption")

Day = dt.date | None


def overview(daily: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """One row for the period; zeros where it has no days.

    ``total_households`` adds up the households of each day (household-days), and
    ``avg_consumption`` is the unweighted mean of the daily averages.
    """
    totals = daily.where(day_in(F.col("day"), start, end)).agg(
        F.sum("household_count").alias("total_households"),
        F.sum("total_consumption").cast(TOTAL).alias("total_energy"),
        mean_of("avg_consumption").alias("avg_consumption"),
        F.max("max_consumption").alias("peak_consumption"),
    )
    return totals.select(
        F.coalesce("total_households", F.lit(0)).cast("bigint").alias("total_households"),
        F.coalesce("total_energy", F.lit(0)).cast(TOTAL).alias("total_energy"),
        F.coalesce("avg_consumption", F.lit(0)).cast(ENERGY).alias("avg_consumption"),
        F.coalesce("peak_consumption", F.lit(0)).cast(ENERGY).alias("peak_consumption"),
    )


def daily_series(daily: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """The days in order, with totals and the min-avg-max band."""
    days = daily.where(day_in(F.col("day"), start, end))
    return days.select("day", *MEASURES, "household_count").orderBy("day")


def hourly_series(
    hourly: DataFrame, start: Day = None, end: Day = None, max_hours: int | None = None
) -> DataFrame:
    """The hours in order, or the first ``max_hours`` of them."""
    hours = hourly.where(time_in(F.col("hour"), start, end)).select("hour", *MEASURES)
    ordered = hours.orderBy("hour")
    return ordered if max_hours is None else ordered.limit(max_hours)


def hour_of_day_profile(
    hourly: DataFrame, start: Day = None, end: Day = None, max_hours: int | None = None
) -> DataFrame:
    """Mean of the hourly averages for each hour of the day."""
    hours = hourly_series(hourly, start, end, max_hours)
    profile = hours.groupBy(F.hour("hour").alias("hour_of_day"))
    return profile.agg(mean_of("avg_consumption").alias("avg_consumption")).orderBy("hour_of_day")


def day_hour_heatmap(
    hourly: DataFrame, start: Day = None, end: Day = None, max_hours: int | None = None
) -> DataFrame:
    """One row per day, one column per hour ``h00`` to ``h23``; NULL for absent hours."""
    hours = hourly_series(hourly, start, end, max_hours)
    columns = [f"h{hour:02d}" for hour in range(24)]
    cells = hours.select(
        F.to_date("hour").alias("day"),
        F.date_format("hour", "'h'HH").alias("hour_of_day"),
        "avg_consumption",
    )
    grid = cells.groupBy("day").pivot("hour_of_day", columns).agg(F.avg("avg_consumption"))
    return grid.select("day", *[F.col(c).cast(ENERGY).alias(c) for c in columns]).orderBy("day")


def weekday_profile(daily: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """Mean of the daily averages for all seven weekdays, Monday first.

    Weekdays that the period does not contain have NULL.
    """
    spark = daily.sparkSession
    names = F.array(*[F.lit(name) for name in WEEKDAYS])
    week = spark.range(len(WEEKDAYS)).select(
        F.col("id").cast("int").alias("weekday"),
        F.element_at(names, (F.col("id") + 1).cast("int")).alias("day_of_week"),
    )
    days = daily.where(day_in(F.col("day"), start, end))
    means = days.groupBy(F.weekday("day").alias("weekday")).agg(
        mean_of("avg_consumption").alias("avg_consumption")
    )
    # The aggregated side has at most seven rows.
    return (
        week.join(F.broadcast(means), "weekday", "left")
        .select((F.col("weekday") + 1).alias("weekday_number"), "day_of_week", "avg_consumption")
        .orderBy("weekday_number")
    )


def latest_days(daily: DataFrame, n: int = 10) -> DataFrame:
    return daily.orderBy(F.desc("day")).limit(n)


def top_households(stats: DataFrame, n: int = 50) -> DataFrame:
    """The households with the largest totals, ties by name."""
    return stats.orderBy(F.desc("total_consumption"), "lclid").limit(n)


def household_histogram(stats: DataFrame, bins: int = 20, top_n: int | None = None) -> DataFrame:
    """Number of households per bin of ``avg_daily_consumption``.

    The bins have equal width from the smallest to the largest value; empty bins are
    left out. With ``top_n`` only the households with the largest totals count.
    """
    chosen = stats if top_n is None else top_households(stats, top_n)
    value, low, high = F.col("avg_daily_consumption"), F.col("bounds.low"), F.col("bounds.high")
    values = chosen.groupBy(value).agg(F.count("*").alias("household_count"))
    bounds = values.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")))
    # Exact in decimals; the largest value would open one bin too many.
    offset = F.when(high > low, F.floor((value - low) * bins / (high - low))).otherwise(F.lit(0))

    def edge(number: Column) -> Column:
        return (low + (high - low) * number / F.lit(bins)).cast(ENERGY)

    return (
        values.withColumn("bounds", bounds.scalar())
        .groupBy(F.least(offset + 1, F.lit(bins)).cast("int").alias("bin"), "bounds")
        .agg(F.sum("household_count").alias("household_count"))
        .select(
            "bin",
            edge(F.col("bin") - 1).alias("bin_start"),
            edge(F.col("bin")).alias("bin_end"),
            "household_count",
        )
        .orderBy("bin")
    )


def anomaly_series(anomalies: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """The anomalies of the period in order of time."""
    return anomalies.where(time_in(F.col("timestamp"), start, end)).orderBy("timestamp", "lclid")
