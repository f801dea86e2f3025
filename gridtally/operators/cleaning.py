"""Filters and de-duplication of readings."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from gridtally.schema import COMPACT_ENERGY, COMPACT_LIMIT, MAX_PLAUSIBLE_KWH, READING_KEY


def is_plausible(max_kwh: float = MAX_PLAUSIBLE_KWH) -> Column:
    """Consumption of at least 0 and at most ``max_kwh``, whatever the interval."""
    return F.col("energy_kwh").between(F.lit(Decimal(0)), F.lit(Decimal(str(max_kwh))))


def is_identified() -> Column:
    """Household, day and value are known. The timestamp may be missing."""
    return F.col("lclid").isNotNull() & F.col("day").isNotNull() & F.col("energy_kwh").isNotNull()


def is_complete() -> Column:
    return is_identified() & F.col("timestamp").isNotNull()


def identified(readings: DataFrame) -> DataFrame:
    return readings.where(is_identified())


def clean_readings(readings: DataFrame, max_kwh: float = MAX_PLAUSIBLE_KWH) -> DataFrame:
    """Complete, plausible readings.

    The filter is on the stored columns and reaches the scan. What passes it is
    bounded by ``max_kwh``, so the value then fits the compact type.
    """
    kept = readings.where(is_complete() & is_plausible(max_kwh))
    value = F.col("energy_kwh")
    if max_kwh <= COMPACT_LIMIT:
        value = value.cast(COMPACT_ENERGY)
    return kept.select("lclid", "day", value.alias("energy_kwh"), "timestamp")


def deduplicate(readings: DataFrame, max_kwh: float = MAX_PLAUSIBLE_KWH) -> DataFrame:
    """One reading per household, day and timestamp; missing timestamps are equal.

    The survivor is the smallest plausible value, or the smallest of all if none is
    plausible. It is the same in every run, and cleaning may come before or after.
    Copies meet in the partial aggregation, so a key with very many of them costs
    one row per map task.
    """
    value = F.col("energy_kwh")
    smallest_plausible = F.min(F.when(is_plausible(max_kwh), value))
    survivor = F.coalesce(smallest_plausible, F.min(value))
    return (
        readings.groupBy(*READING_KEY)
        .agg(survivor.alias("energy_kwh"))
        .select("lclid", "day", "energy_kwh", "timestamp")
    )


def households(readings: DataFrame) -> DataFrame:
    """The distinct households."""
    return readings.select("lclid").distinct()


def run_profile(readings: DataFrame, max_kwh: float = MAX_PLAUSIBLE_KWH) -> DataFrame:
    """Row counts of a run, before and after cleaning, and households, in one pass."""
    return readings.agg(
        F.count("*").alias("reading_count"),
        F.count_if(is_complete() & is_plausible(max_kwh)).alias("clean_count"),
        F.countDistinct("lclid").cast("int").alias("household_count"),
    )


def intake_counts(max_kwh: float = MAX_PLAUSIBLE_KWH) -> list[Column]:
    """Rows read, those with household, day and value, and those plausible too."""
    return [
        F.count("*").alias("read"),
        F.count_if(is_identified()).alias("identified"),
        F.count_if(is_identified() & is_plausible(max_kwh)).alias("plausible"),
    ]
