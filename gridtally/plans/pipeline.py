"""From reading files to warehouse tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from gridtally.operators.anomalies import detect_anomalies, household_baseline
from gridtally.operators.cleaning import (
    clean_readings,
    deduplicate,
    identified,
    intake_counts,
)
from gridtally.operators.rollups import (
    daily_rollup,
    hour_sums,
    hourly_of,
    household_day_state,
    household_stats,
    monthly_rollup,
    weekly_rollup,
)
from gridtally.plans.states import merged_days, refresh
from gridtally.schema import DATASETS, MAX_PLAUSIBLE_KWH
from gridtally.session import bounded_scans, materialize, require_utc, stored_size
from gridtally.sources.csv_readings import readings_of, rejected_of, scan_layouts
from gridtally.sources.jdbc import write_jdbc_dataset
from gridtally.sources.tables import (
    append_readings,
    append_rejected,
    load_dataset,
    read_dataset,
    read_raw,
    read_table,
    run_together,
    write_dataset,
)


def ingest(
    spark: SparkSession,
    source: str,
    warehouse: str,
    *globs: str,
    max_kwh: float = MAX_PLAUSIBLE_KWH,
) -> dict[str, int]:
    """Read the files of ``source`` and add the readings that are new.

    Returns the rows read, those of them with household, day and value, those that
    are plausible too, and the readings added. They are counted while reading. If some
    rows lack one of the three, a second scan stores them, with their file and what they
    lack, in the table of rejected readings.
    """
    require_utc(spark)
    seen = Observation()
    scans = scan_layouts(spark, source, *globs)
    readings = readings_of(scans).observe(seen, *intake_counts(max_kwh))
    added = append_readings(deduplicate(identified(readings), max_kwh), warehouse)
    counts = seen.get
    if counts["read"] > counts["identified"]:
        append_rejected(rejected_of(scans), warehouse)
    return {**counts, "added": added}


def transform(
    readings: DataFrame, max_kwh: float = MAX_PLAUSIBLE_KWH, folder: str | None = None
) -> dict[str, DataFrame]:
    """The six datasets of the readings.

    The state per household and day, and the baseline per household, are stored on
    the way, in ``folder`` or else in the shared folder; five of the datasets start from
    them. Readings are scanned three times: for that state, for the sums of each hour,
    and for the outliers; only sums are shuffled.
    """
    require_utc(readings.sparkSession)
    clean = clean_readings(readings, max_kwh)
    state = materialize(household_day_state(clean), "household_days", folder)
    days, once = merged_days(state, folder)
    baseline = materialize(household_baseline(days), "household_baseline", folder)
    return datasets_of(days, state, once, hour_sums(clean), clean, baseline)


def datasets_of(
    days: DataFrame, seen: DataFrame, once: bool, hours: DataFrame, readings: DataFrame, baseline: DataFrame
) -> dict[str, DataFrame]:
    """The six datasets from household days and their state, hour sums, and readings with all outliers."""
    return {
        "hourly": hourly_of(hours, seen, once),
        "daily": daily_rollup(days),
        "weekly": weekly_rollup(days),
        "monthly": monthly_rollup(days),
        "household_stats": household_stats(days),
        "anomalies": detect_anomalies(readings, baseline),
    }


def processed_folder(warehouse: str) -> str:
    """Where the datasets wait to be loaded."""
    return f"{warehouse.rstrip('/')}/processed"


def transform_stored(
    spark: SparkSession, warehouse: str, max_kwh: float = MAX_PLAUSIBLE_KWH
) -> dict[str, int]:
    """Compute the datasets of the raw table and store them.

    Only months that changed since the last run are read (see ``plans.states``); the
    datasets are merged from the stored sums of all months. Returns the clean readings and
    households of the raw table, the outliers, and how many months were read.
    """
    require_utc(spark)
    processed = processed_folder(warehouse)
    states = refresh(spark, warehouse, f"{processed}/states", max_kwh)
    datasets = datasets_of(
        states.days, states.seen, states.once, states.hours, states.candidates, states.baseline
    )
    found = Observation()
    datasets["anomalies"] = datasets["anomalies"].observe(found, F.count("*").alias("anomalies"))
    with bounded_scans(spark, *stored_size(states.seen)):
        run_together(
            spark, [partial(write_dataset, df, processed, name) for name, df in datasets.items()]
        )
    clean = states.baseline.agg(
        F.coalesce(F.sum("reading_count"), F.lit(0)).alias("clean"), F.count("*").alias("households")
    ).first()
    months = len({*states.read, *states.rescored})
    return {**clean.asDict(), **found.get, "months_read": months}


def load(spark: SparkSession, processed: str, warehouse: str) -> None:
    """Replace all six warehouse tables by the stored datasets."""
    run_together(
        spark, [partial(load_dataset, spark, processed, name, warehouse) for name in DATASETS]
    )


def load_jdbc(spark: SparkSession, processed: str, url: str, **properties: str) -> None:
    """The same into a database, one table after the other."""
    for name in DATASETS:
        write_jdbc_dataset(read_dataset(spark, processed, name), name, url, **properties)


def run_pipeline(
    spark: SparkSession,
    source: str,
    warehouse: str,
    *globs: str,
    max_kwh: float = MAX_PLAUSIBLE_KWH,
) -> DataFrame:
    """Ingest, transform and load; returns the row count of each table."""
    ingest(spark, source, warehouse, *globs, max_kwh=max_kwh)
    transform_stored(spark, warehouse, max_kwh)
    load(spark, processed_folder(warehouse), warehouse)
    return table_counts(spark, warehouse)


def table_counts(spark: SparkSession, warehouse: str) -> DataFrame:
    """Rows per table; answered from file footers, without reading the data."""
    counts = read_raw(spark, warehouse).agg(F.count("*").alias("row_count"))
    tables = counts.select(F.lit("raw").alias("dataset"), "row_count")
    for name in DATASETS:
        rows = read_table(spark, warehouse, name).agg(F.count("*").alias("row_count"))
        tables = tables.unionByName(rows.select(F.lit(name).alias("dataset"), "row_count"))
    return tables
