"""The registered queries: every operator over the whole of a given table.

``events`` and ``lineitem`` stand in for reading tables; see the adapters.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridtally.operators import anomalies, cleaning, reports, rollups
from gridtally.plans.pipeline import ingest, load, processed_folder, run_pipeline, transform_stored
from gridtally.schema import ENERGY, HALF_HOUR_HEADER, READING, READING_HEADER, conform
from gridtally.session import materialize, new_folder
from gridtally.sources import tables
from gridtally.sources.csv_readings import read_csv_readings
from gridtally.streaming.incremental import ingest_new_files

# The period that the reports show by default; all events lie within it.
START, END = dt.date(2024, 1, 1), dt.date(2024, 1, 31)
# Periods that leave days out, and one without any.
TEN_DAYS = dt.date(2024, 1, 6), dt.date(2024, 1, 15)
THREE_DAYS = dt.date(2024, 1, 9), dt.date(2024, 1, 11)
NO_DAYS = dt.date(2023, 1, 1), dt.date(2023, 12, 31)
# The first delivery of the years ends within them.
YEARS_UNTIL = dt.date(1996, 6, 15)
# Events exceed the default limit; outliers need the higher one.
WIDE_LIMIT = 1000.0


# --- adapters ---------------------------------------------------------------


def _readings(rows: DataFrame, household: Column, time: Column, energy: Column) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.session.timeZone", "UTC")
    timestamp = time.cast("timestamp")
    readings = rows.select(
        household.cast("string").alias("lclid"),
        F.to_date(timestamp).alias("day"),
        energy.cast(ENERGY).alias("energy_kwh"),
        timestamp.alias("timestamp"),
    )
    return conform(readings, READING)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of readings with many hours per day."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _readings(rows, F.col("user_id"), F.col("ts"), F.col("value"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven years of readings, all at midnight, some keys several times."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _readings(rows, F.col("l_suppkey"), F.col("l_shipdate"), F.col("l_quantity"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, with gaps, negative values and several readings per key.

    The minute of an event decides what is wrong with it; cutting the timestamp to
    the hour then makes the duplicates.
    """
    minute = F.minute("timestamp")
    value = F.col("energy_kwh")
    return events(spark, sf_dir).select(
        F.when(minute != 5, F.col("lclid")).alias("lclid"),
        F.when(minute != 15, F.col("day")).alias("day"),
        F.when(minute != 25, F.when(minute.isin(35, 36), -value).otherwise(value)).alias("energy_kwh"),
        F.when(minute != 45, F.date_trunc("hour", "timestamp")).alias("timestamp"),
    )


def _event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.household_days(cleaning.clean_readings(events(spark, sf_dir)))


def _lineitem_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.household_days(cleaning.clean_readings(lineitem(spark, sf_dir)))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.daily_rollup(_event_days(spark, sf_dir))


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.hourly_rollup(cleaning.clean_readings(events(spark, sf_dir)))


def _lineitem_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.hourly_rollup(cleaning.clean_readings(lineitem(spark, sf_dir)))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.household_stats(_lineitem_days(spark, sf_dir))


# --- queries ----------------------------------------------------------------


def household_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = cleaning.clean_readings(events(spark, sf_dir), WIDE_LIMIT)
    baseline = anomalies.household_baseline(rollups.household_days(clean))
    return baseline.select(
        "lclid",
        F.col("reading_count"),
        F.col("avg_consumption").alias("mean_consumption"),
        F.col("stddev_consumption").cast(ENERGY).alias("stddev_consumption"),
    )


def find_anomalies(spark: SparkSession, sf_dir: str, **join_options) -> DataFrame:
    clean = cleaning.clean_readings(events(spark, sf_dir), WIDE_LIMIT)
    baseline = anomalies.household_baseline(rollups.household_days(clean))
    stored = materialize(baseline, "household_baseline")
    return anomalies.detect_anomalies(clean, stored, **join_options)


def find_anomalies_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way for more households than may be broadcast, forced."""
    return find_anomalies(spark, sf_dir, max_broadcast_bytes=0, hot_share=0.001)


def _write_csv(readings: DataFrame, path: str) -> None:
    writer = readings.write.option("header", "true")
    writer.option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)


def write_reading_csv(readings: DataFrame, path: str) -> None:
    names = dict(zip(("lclid", "day", "energy_kwh", "timestamp"), READING_HEADER))
    _write_csv(readings.select(*[F.col(old).alias(new) for old, new in names.items()]), path)


def write_half_hour_csv(readings: DataFrame, path: str) -> None:
    names = dict(zip(("lclid", "timestamp", "energy_kwh"), HALF_HOUR_HEADER))
    text = readings.withColumn("energy_kwh", F.coalesce(F.col("energy_kwh").cast("string"), F.lit("Null")))
    _write_csv(text.select(*[F.col(old).alias(new) for old, new in names.items()]), path)


def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "csv")
    write_reading_csv(events(spark, sf_dir), folder)
    return cleaning.deduplicate(cleaning.identified(read_csv_readings(spark, folder)))


def csv_ingest_half_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "csv")
    write_half_hour_csv(dirty(spark, sf_dir), folder)
    return cleaning.deduplicate(cleaning.identified(read_csv_readings(spark, folder)))


def csv_mixed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder with files of both layouts and of two orders of columns."""
    folder, readings = new_folder(spark, "csv"), events(spark, sf_dir)
    day = F.dayofmonth("day")
    write_reading_csv(readings.where(day <= 10), f"{folder}/plain")
    swapped = dict(zip(("timestamp", "energy_kwh", "day", "lclid"), reversed(READING_HEADER)))
    later = readings.where(day.between(11, 20))
    _write_csv(later.select(*[F.col(old).alias(new) for old, new in swapped.items()]), f"{folder}/swapped")
    write_half_hour_csv(readings.where(day > 20), f"{folder}/half_hour")
    return cleaning.deduplicate(cleaning.identified(read_csv_readings(spark, f"{folder}/*")))


def rejected_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of the rows that an ingest leaves out, after reading the files twice."""
    folder, warehouse = new_folder(spark, "csv"), new_folder(spark, "warehouse")
    write_reading_csv(dirty(spark, sf_dir), folder)
    ingest(spark, folder, warehouse)
    ingest(spark, folder, warehouse)
    text = F.from_json("fields", ", ".join(f"`{name}` string" for name in READING_HEADER))
    fields = [
        text[name].cast(kind).alias(column)
        for name, column, kind in zip(READING_HEADER, READING.names, ("string", "date", ENERGY, "timestamp"))
    ]
    rows = tables.read_rejected(spark, warehouse).select("reason", *fields, "copies")
    return rows.groupBy("reason", *READING.names).agg(F.sum("copies").alias("copies"))


def pipeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ingest reports of files with gaps, negative values and repeated keys."""
    folder, warehouse = new_folder(spark, "csv"), new_folder(spark, "warehouse")
    write_reading_csv(dirty(spark, sf_dir), folder)
    counts = ingest(spark, folder, warehouse)
    return spark.range(1).select(*[F.lit(n).cast("long").alias(f"{k}_count") for k, n in counts.items()])


def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batch twice, then one that overlaps it; every key is stored once."""
    warehouse = new_folder(spark, "warehouse")
    batch = cleaning.deduplicate(cleaning.identified(dirty(spark, sf_dir)))
    tables.append_readings(batch, warehouse)
    tables.append_readings(batch, warehouse)
    hours = events(spark, sf_dir).withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    tables.append_readings(cleaning.deduplicate(hours), warehouse)
    return tables.read_raw(spark, warehouse)


def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries of files, each followed by an ingest of what is new."""
    folder, warehouse = new_folder(spark, "deliveries"), new_folder(spark, "warehouse")
    readings = events(spark, sf_dir)
    write_reading_csv(readings.where(F.col("day") <= F.lit(dt.date(2024, 1, 15))), f"{folder}/first")
    ingest_new_files(spark, f"{folder}/*", warehouse)
    write_reading_csv(readings.where(F.col("day") > F.lit(dt.date(2024, 1, 10))), f"{folder}/second")
    ingest_new_files(spark, f"{folder}/*", warehouse)
    return tables.read_raw(spark, warehouse)


def parquet_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each load replaces the table, so loading twice leaves one copy."""
    processed, warehouse = new_folder(spark, "processed"), new_folder(spark, "warehouse")
    tables.write_dataset(_daily(spark, sf_dir), processed, "daily")
    tables.load_dataset(spark, processed, "daily", warehouse)
    tables.load_dataset(spark, processed, "daily", warehouse)
    return tables.read_table(spark, warehouse, "daily")


def _warehouse(spark: SparkSession, readings: DataFrame, max_kwh: float = 100.0) -> str:
    source, warehouse = new_folder(spark, "csv"), new_folder(spark, "warehouse")
    write_reading_csv(readings, source)
    run_pipeline(spark, source, warehouse, max_kwh=max_kwh)
    return warehouse


def pipeline_table(
    name: str,
    max_kwh: float = 100.0,
    readings: Callable[[SparkSession, str], DataFrame] = events,
) -> Callable[[SparkSession, str], DataFrame]:
    """A warehouse table after a full run from CSV files of the readings."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.read_table(spark, _warehouse(spark, readings(spark, sf_dir), max_kwh), name)

    return query


def _deliveries(spark: SparkSession, readings: DataFrame, until: dt.date, max_kwh: float) -> tuple[str, list[dict]]:
    """A warehouse after two deliveries, the second with all readings, and what each run counted."""
    warehouse, counts = new_folder(spark, "warehouse"), []
    for number, part in enumerate((readings.where(F.col("day") <= F.lit(until)), readings)):
        source = new_folder(spark, "csv")
        write_reading_csv(part, source)
        added = ingest(spark, source, warehouse, max_kwh=max_kwh)["added"]
        counts.append({"run": number + 1, "added": added, **transform_stored(spark, warehouse, max_kwh)})
        load(spark, processed_folder(warehouse), warehouse)
    return warehouse, counts


def incremental_table(
    name: str,
    until: dt.date,
    max_kwh: float = 100.0,
    readings: Callable[[SparkSession, str], DataFrame] = events,
) -> Callable[[SparkSession, str], DataFrame]:
    """A warehouse table after two deliveries; the second run reads only what changed."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.read_table(spark, _deliveries(spark, readings(spark, sf_dir), until, max_kwh)[0], name)

    return query


def incremental_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two runs counted, the second after a delivery of the last years."""
    _, counts = _deliveries(spark, lineitem(spark, sf_dir), YEARS_UNTIL, 100.0)
    names = ("run", "added", "clean", "households", "anomalies", "months_read")
    rows = [spark.range(1).select(*[F.lit(run[n]).cast("long").alias(n) for n in names]) for run in counts]
    return rows[0].unionByName(rows[1])


def adhoc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over raw and warehouse tables by name."""
    tables.register_tables(spark, _warehouse(spark, lineitem(spark, sf_dir)))
    return spark.sql(
        """
        SELECT lclid, total_consumption, days_count,
               (SELECT COUNT(*) FROM raw.energy_consumption) AS raw_rows
        FROM analytics.household_stats ORDER BY total_consumption DESC, lclid LIMIT 10
        """
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    clean = cleaning.clean_readings
    return {
        "ingest_profile": lambda s, d: cleaning.run_profile(events(s, d)),
        "households": lambda s, d: cleaning.households(events(s, d)),
        "clean_readings": lambda s, d: conform(cleaning.deduplicate(clean(dirty(s, d))), READING),
        "ingested_readings": lambda s, d: cleaning.deduplicate(cleaning.identified(dirty(s, d))),
        "deduplicated_readings": lambda s, d: cleaning.deduplicate(lineitem(s, d)),
        "hourly_rollup": _hourly,
        "daily_rollup": _daily,
        "weekly_rollup": lambda s, d: rollups.weekly_rollup(_lineitem_days(s, d)),
        "monthly_rollup": lambda s, d: rollups.monthly_rollup(_lineitem_days(s, d)),
        "household_stats": _stats,
        "household_true_daily": lambda s, d: rollups.household_true_daily(_event_days(s, d)),
        "household_baseline": household_baseline,
        "anomalies": find_anomalies,
        "anomalies_shuffled": find_anomalies_shuffled,
        "anomaly_series": lambda s, d: reports.anomaly_series(find_anomalies(s, d), START, END),
        "anomaly_top_households": lambda s, d: anomalies.anomaly_top_households(find_anomalies(s, d)),
        "overview": lambda s, d: reports.overview(_daily(s, d), START, END),
        "daily_series": lambda s, d: reports.daily_series(_daily(s, d), START, END),
        "hourly_series": lambda s, d: reports.hourly_series(_hourly(s, d), START, END),
        "hour_of_day_profile": lambda s, d: reports.hour_of_day_profile(_hourly(s, d), START, END),
        "day_hour_heatmap": lambda s, d: reports.day_hour_heatmap(_hourly(s, d), START, END),
        "weekday_profile": lambda s, d: reports.weekday_profile(_daily(s, d), START, END),
        "latest_days": lambda s, d: reports.latest_days(_daily(s, d)),
        "top_households": lambda s, d: reports.top_households(_stats(s, d)),
        "top10_households": lambda s, d: reports.top_households(_stats(s, d), 10),
        "household_histogram": lambda s, d: reports.household_histogram(_stats(s, d)),
        "household_histogram_all": lambda s, d: reports.household_histogram(_stats(s, d), top_n=None),
        "household_histogram_top50": lambda s, d: reports.household_histogram(_stats(s, d), top_n=50),
        "overview_period": lambda s, d: reports.overview(_daily(s, d), *TEN_DAYS),
        "overview_empty_range": lambda s, d: reports.overview(_daily(s, d), *NO_DAYS),
        "weekday_profile_period": lambda s, d: reports.weekday_profile(_daily(s, d), *THREE_DAYS),
        "hourly_series_period": lambda s, d: reports.hourly_series(_hourly(s, d), *TEN_DAYS),
        "hourly_series_first_100": lambda s, d: reports.hourly_series(_hourly(s, d), START, END, 100),
        "hourly_series_years": lambda s, d: reports.hourly_series(_lineitem_hourly(s, d)),
        "hour_of_day_profile_years": lambda s, d: reports.hour_of_day_profile(_lineitem_hourly(s, d)),
        "day_hour_heatmap_years": lambda s, d: reports.day_hour_heatmap(_lineitem_hourly(s, d)),
        "csv_ingest": csv_ingest,
        "csv_ingest_half_hour": csv_ingest_half_hour,
        "csv_mixed_folder": csv_mixed_folder,
        "rejected_readings": rejected_readings,
        "pipeline_counts": pipeline_counts,
        "idempotent_append": idempotent_append,
        "incremental_ingest": incremental_ingest,
        "parquet_reload": parquet_reload,
        "pipeline_daily": pipeline_table("daily"),
        "pipeline_hourly": pipeline_table("hourly"),
        "pipeline_household_stats": pipeline_table("household_stats"),
        "pipeline_weekly": pipeline_table("weekly", readings=lineitem),
        "pipeline_monthly": pipeline_table("monthly", readings=lineitem),
        "pipeline_anomalies": pipeline_table("anomalies", WIDE_LIMIT),
        "incremental_hourly": incremental_table("hourly", TEN_DAYS[1]),
        "incremental_weekly": incremental_table("weekly", YEARS_UNTIL, readings=lineitem),
        "incremental_household_stats": incremental_table("household_stats", YEARS_UNTIL, readings=lineitem),
        "incremental_anomalies": incremental_table("anomalies", TEN_DAYS[1], WIDE_LIMIT),
        "incremental_counts": incremental_counts,
        "adhoc_sql": adhoc_sql,
    }
