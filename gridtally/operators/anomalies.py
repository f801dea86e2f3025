"""Readings more than three standard deviations from the mean of their household."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from gridtally.functions.measures import average, sample_stddev, z_score
from gridtally.operators.household_join import join_households
from gridtally.schema import ANOMALY_THRESHOLD, ANOMALY_TYPE, DATASETS, conform


def household_baseline(days: DataFrame) -> DataFrame:
    """Mean and sample deviation per household, and its largest and smallest reading.

    ``mean_consumption`` is for scores, ``avg_consumption`` is the mean as reported.
    """
    count = F.sum("reading_count")
    total = F.sum("total_kwh")
    return days.groupBy("lclid").agg(
        count.alias("reading_count"),
        average(total, count, T.DecimalType(14, 8)).alias("mean_consumption"),
        average(total, count).alias("avg_consumption"),
        sample_stddev(count, total, F.sum("total_kwh_squared")).alias("stddev_consumption"),
        F.max("max_kwh").alias("max_kwh"),
        F.min("min_kwh").alias("min_kwh"),
    )


def scored_readings(
    readings: DataFrame, baseline: DataFrame, threshold: float, **join_options
) -> DataFrame:
    """``lclid, timestamp, energy_kwh, z_score`` of readings whose score exceeds ``threshold``.

    ``baseline`` must be a stored table (see ``materialize``): it is read several
    times, first to find out how to join it. The score grows with the distance from
    the mean, so a household has such a reading exactly if its largest or its smallest
    one is one; all other households drop out before the join.
    """
    wanted = F.greatest(score_of(F.col("max_kwh")), score_of(F.col("min_kwh"))) > threshold
    scored = join_households(
        readings.select("lclid", "timestamp", "energy_kwh"),
        baseline,
        wanted=wanted,
        columns=["mean_consumption", "stddev_consumption"],
        **join_options,
    ).withColumn("z_score", score_of(F.col("energy_kwh")))
    return scored.where(F.col("z_score") > threshold).select("lclid", "timestamp", "energy_kwh", "z_score")


def score_of(value: Column) -> Column:
    """The z-score of a value by the baseline columns beside it."""
    return z_score(value, F.col("mean_consumption"), F.col("stddev_consumption"))


def detect_anomalies(
    readings: DataFrame,
    baseline: DataFrame,
    threshold: float = ANOMALY_THRESHOLD,
    **join_options,
) -> DataFrame:
    """Readings whose z-score exceeds ``threshold``; see ``scored_readings``."""
    outliers = scored_readings(readings, baseline, threshold, **join_options)
    return conform(outliers.withColumn("anomaly_type", F.lit(ANOMALY_TYPE)), DATASETS["anomalies"])


def anomaly_top_households(anomalies: DataFrame, n: int = 10) -> DataFrame:
    """The households with the most anomalies, ties by name."""
    counts = anomalies.groupBy("lclid").agg(F.count("*").alias("anomaly_count"))
    return counts.orderBy(F.desc("anomaly_count"), "lclid").limit(n)
