"""Stored partial sums of the raw table, kept up to date month by month.

The state of a month of readings is four small tables: sums per household and day with
the hours seen, sums per hour, readings that may be outliers, and the bounds of all
other readings per household. All six datasets follow from the states of all months. A
run reads only months whose files changed since the states were committed, however the
readings got there and whatever run died in between.

Outliers depend on the whole history of a household, so a new day may change the score
of any old reading. What is stored per month are the readings that scored more than
CANDIDATE_SCORE when the month was read; all others lie within known bounds. As long as
no bound is an outlier by the present baseline, no reading within them is one. A month
in which some household's baseline has moved further is read again.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridtally.functions.periods import month_of
from gridtally.operators.anomalies import household_baseline, score_of, scored_readings
from gridtally.operators.cleaning import clean_readings
from gridtally.operators.rollups import days_of, hour_sums, household_day_state, one_row_a_day
from gridtally.schema import (
    ANOMALY_THRESHOLD,
    CANDIDATE,
    ENERGY,
    HOUR_SUM,
    HOUSEHOLD_DAY_STATE,
    MAX_PLAUSIBLE_KWH,
    REACH,
)
from gridtally.session import bounded_scans, materialize, shuffles_removed, stored_size
from gridtally.sources import snapshots
from gridtally.sources.tables import raw_months, read_raw

# Readings above this score are stored; those up to it are only bounded.
CANDIDATE_SCORE = 2.0
# States that another version of this module wrote are not used.
LAYOUT = 1
_TABLES = {"days": HOUSEHOLD_DAY_STATE, "hours": HOUR_SUM, "candidates": CANDIDATE, "reach": REACH}


@dataclass(frozen=True)
class States:
    """The states of all months, and which months were read to bring them up to date.

    ``days`` are the household days, ``seen`` their state, ``once`` whether that has each once.
    """

    days: DataFrame
    seen: DataFrame
    once: bool
    hours: DataFrame
    candidates: DataFrame
    baseline: DataFrame
    read: list[dt.date]
    rescored: list[dt.date]


def merged_days(state: DataFrame, folder: str | None = None) -> tuple[DataFrame, bool]:
    """The household days of a stored state, and whether it has each once.

    Where times lie on other days they are summed once, and stored for all that read them.
    """
    once = one_row_a_day(state)
    days = days_of(state, once)
    return (days if once else materialize(days, "merged_days", folder)), once


def _write(spark: SparkSession, path: str, name: str, rows: DataFrame) -> str:
    """A folder per month below a new one; ``rows`` has ``month``."""
    own = snapshots.new_data(name)
    with shuffles_removed(spark):
        rows.hint("rebalance", "month").write.partitionBy("month").parquet(f"{path}/{own}")
    return own


def _read(spark: SparkSession, path: str, months: dict[str, dict], name: str) -> DataFrame:
    """One of the tables, of all months; a month without rows has no folder."""
    found = [f"{path}/{month[name]}" for month in months.values() if month.get(name)]
    if not found:
        return spark.createDataFrame([], _TABLES[name])
    return spark.read.schema(_TABLES[name]).parquet(*found)


def _placed(spark: SparkSession, path: str, own: str, months: list[str]) -> dict[str, str]:
    """Where each month of a written table lies."""
    written = set(snapshots.Folder(spark, path).names(own))
    return {month: f"{own}/month={month}" for month in months if f"month={month}" in written}


def _reach(days: DataFrame, baseline: DataFrame) -> DataFrame:
    """REACH: the bounds of the readings that are no candidates, per household and month."""
    bounds = days.groupBy("lclid", month_of(F.col("day")).alias("in_month")).agg(
        F.max("max_kwh").alias("max_kwh"), F.min("min_kwh").alias("min_kwh")
    )
    known = baseline.select("lclid", "mean_consumption", "stddev_consumption")
    # Scores are doubles; a ten-thousandth of a kWh is more than their error.
    way = F.col("stddev_consumption") * CANDIDATE_SCORE + 0.0001
    mean = F.col("mean_consumption").cast("double")
    scattered = F.col("stddev_consumption") > 0
    low, high = F.col("min_kwh").cast("double"), F.col("max_kwh").cast("double")
    return bounds.join(known, "lclid").select(
        "lclid",
        "in_month",
        F.when(scattered, F.greatest(low, mean - way)).otherwise(low).alias("low"),
        F.when(scattered, F.least(high, mean + way)).otherwise(high).alias("high"),
    )


def _moved(reach: DataFrame, baseline: DataFrame, threshold: float) -> list[str]:
    """Months in which a reading that is no candidate may be an outlier by now."""
    outside = F.greatest(score_of(F.col("low")), score_of(F.col("high"))) > threshold
    known = baseline.select("lclid", "mean_consumption", "stddev_consumption")
    moved = reach.where("low <= high").join(known, "lclid").where(outside)
    # A month per row, of which there are few.
    months = moved.agg(F.sort_array(F.collect_set("in_month")).alias("months")).first()["months"]
    return [month.isoformat() for month in months]


def _month(column: Column) -> Column:
    return month_of(column).alias("month")


def refresh(
    spark: SparkSession,
    warehouse: str,
    path: str,
    max_kwh: float = MAX_PLAUSIBLE_KWH,
    threshold: float = ANOMALY_THRESHOLD,
) -> States:
    """Bring the states at ``path`` up to date with the raw table of ``warehouse``.

    Readings of a changed month are scanned three times: for its sums per household and
    day, its sums per hour and its candidates. Everything becomes visible with one commit;
    a run that dies leaves the states as they were.
    """
    number, content = snapshots.latest(spark, path)
    rules = {"max_kwh": max_kwh, "threshold": threshold, "layout": LAYOUT}
    months: dict[str, dict] = content.get("months", {}) if content.get("rules") == rules else {}
    files = {month.isoformat(): size for month, size in raw_months(spark, warehouse).items()}
    changed = sorted(m for m in files if m not in months or months[m]["files"] != files[m])
    months = {m: dict(known) for m, known in months.items() if m in files}
    written: list[str] = []

    def store(name: str, rows: DataFrame, of: list[str]) -> None:
        written.append(_write(spark, path, name, rows))
        places = _placed(spark, path, written[-1], of)
        for month in of:
            months[month][name] = places.get(month)

    def raw_readings(of: list[str]) -> DataFrame:
        return read_raw(spark, warehouse, months=[dt.date.fromisoformat(month) for month in of])

    try:
        if changed:
            for month in changed:
                months[month] = {"files": files[month]}
            raw = raw_readings(changed)
            fresh = clean_readings(raw, max_kwh)
            fresh_days = household_day_state(fresh)
            with bounded_scans(spark, raw.count(), sum(files[month][1] for month in changed)):
                store("days", fresh_days.withColumn("month", _month(F.col("day"))), changed)
                # An hour may have readings in several months, by their day.
                store("hours", hour_sums(fresh, _month(F.col("day"))), changed)
        state = _read(spark, path, months, "days")
        with bounded_scans(spark, *stored_size(state)):
            days, once = merged_days(state)
            baseline = materialize(household_baseline(days), "household_baseline")
        known = {m: own for m, own in months.items() if m not in changed}
        moved = _moved(_read(spark, path, known, "reach"), baseline, threshold) if known else []
        stale = sorted({*changed, *moved})
        if stale:
            rows = fresh if stale == changed else clean_readings(raw_readings(stale), max_kwh)
            scored = scored_readings(rows.withColumn("timestamp", F.struct("timestamp", "day")), baseline, CANDIDATE_SCORE)
            found = scored.select("lclid", "timestamp.timestamp", "energy_kwh", _month(F.col("timestamp.day")))
            store("candidates", found.withColumn("energy_kwh", F.col("energy_kwh").cast(ENERGY)), stale)
            own = _read(spark, path, {m: months[m] for m in stale}, "days")
            reach = _reach(own, baseline)
            with bounded_scans(spark, *stored_size(own)):
                store("reach", reach.withColumn("month", F.col("in_month")), stale)
        if changed or stale or not number or content.get("rules") != rules or set(content["months"]) != set(months):
            named = [place for own in months.values() for key, place in own.items() if key != "files" and place]
            # Folders are named whole as well, so that they go when no month lies in them.
            tops = sorted({place.rsplit("/", 1)[0] for place in named})
            snapshots.commit(spark, path, number, {"rules": rules, "months": months, "folders": tops})
    except BaseException:
        for own in written:
            snapshots.Folder(spark, path).remove(own)
        raise
    return States(
        days=days,
        seen=state,
        once=once,
        hours=_read(spark, path, months, "hours"),
        candidates=_read(spark, path, months, "candidates"),
        baseline=baseline,
        read=[dt.date.fromisoformat(m) for m in changed],
        rescored=[dt.date.fromisoformat(m) for m in stale],
    )
