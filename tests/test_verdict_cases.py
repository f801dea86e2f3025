"""Malformed times, foreign tables, undated rows, complete reports, one rounding."""

import datetime as dt
import inspect

import pytest
from pyspark.sql import functions as F

from gridtally.operators import anomalies, reports
from gridtally.plans.pipeline import ingest
from gridtally.schema import READING
from gridtally.sources import snapshots, tables
from gridtally.sources.csv_readings import read_csv_readings, typed_readings
from helpers import D, plan_of, readings, write_file


def test_reports_cut_only_when_asked():
    for report in (reports.hourly_series, reports.hour_of_day_profile, reports.day_hour_heatmap):
        assert inspect.signature(report).parameters["max_hours"].default is None
    assert inspect.signature(reports.household_histogram).parameters["top_n"].default is None


@pytest.mark.parametrize(
    "text", ["00:30:00", "2024", "2024-01", "2024-01-01 00:00:00+05:00", "2024-13-01 00:00:00", "2024-01-01", "x"]
)
def test_malformed_times_are_null(spark, tmp_path, text):
    path = write_file(tmp_path / "in", "a.csv", "LCLid,day,energy_kwh,timestamp", f"A,{text},1,{text}")
    row = read_csv_readings(spark, path).first()
    assert row["timestamp"] is None
    assert row["day"] == (dt.date(2024, 1, 1) if text == "2024-01-01" else None)
    half = spark.createDataFrame([("A", text, "1")], "LCLid string, tstp string, `energy(kWh/hh)` string")
    row = typed_readings(half).first()
    assert row["timestamp"] is None and row["day"] is None


def test_foreign_tables_survive(spark, tmp_path):
    warehouse = str(tmp_path / "warehouse")
    tables.append_readings(readings(spark, ("A", "2024-01-01 00:00", "1")), warehouse)
    spark.sql("CREATE DATABASE IF NOT EXISTS raw")
    spark.sql("DROP TABLE IF EXISTS raw.energy_consumption")
    spark.sql(f"CREATE TABLE raw.energy_consumption (x INT) USING parquet LOCATION '{tmp_path}/theirs'")
    try:
        spark.sql("INSERT INTO raw.energy_consumption VALUES (7)")
        with pytest.raises(ValueError, match="raw.energy_consumption"):
            tables.register_tables(spark, warehouse)
        assert spark.table("raw.energy_consumption").collect() == [(7,)]
    finally:
        spark.sql("DROP TABLE raw.energy_consumption")
    for _ in range(2):
        tables.register_tables(spark, warehouse)
        assert spark.table("raw.energy_consumption").count() == 1


def test_rows_without_a_day_are_appended_once(spark, tmp_path):
    rows = [("A", None, D("1.0000"), dt.datetime(2024, 1, 1)), ("B", dt.date(2024, 1, 1), D("1.0000"), None)]
    for _ in range(2):
        tables.append_readings(spark.createDataFrame(rows, READING), str(tmp_path))
    assert tables.read_raw(spark, str(tmp_path)).count() == 2


def test_reported_mean_is_rounded_once(spark):
    days = spark.sql(
        "SELECT 'A' AS lclid, 25000L AS reading_count, CAST(3086.2499 AS DECIMAL(18,4)) AS total_kwh, "
        "CAST(400 AS DECIMAL(24,8)) AS total_kwh_squared, CAST(1 AS DECIMAL(8,4)) AS max_kwh, "
        "CAST(0 AS DECIMAL(8,4)) AS min_kwh"
    )
    assert anomalies.household_baseline(days).first()["avg_consumption"] == D("0.1234")


def test_forced_join_shuffles(spark):
    from gridtally.operators.household_join import join_households
    from pyspark.sql import functions as F

    rows = readings(spark, *[("A", f"2024-01-01 {h:02d}:00", "1") for h in range(24)], ("B", "2024-01-01 00:00", "1"))
    stats = spark.createDataFrame([("A", 24, 1.0), ("B", 1, 1.0)], "lclid string, reading_count long, m double")
    joined = join_households(rows, stats, F.lit(True), ["m"], max_broadcast_bytes=0, hot_share=0.2)
    assert joined.count() == 25
    assert "SortMergeJoin" in plan_of(joined)


def test_a_failing_write_leaves_the_table(spark, tmp_path):
    path = f"{tmp_path}/table"
    tables.replace_table(spark.range(5), path)
    failing = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("id"))
    with pytest.raises(Exception, match="no"):
        tables.replace_table(failing, path)
    assert snapshots.read(spark, path, spark.range(1).schema).count() == 5
    tables.replace_table(spark.range(3), path)
    assert snapshots.read(spark, path, spark.range(1).schema).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_other_zones_are_refused(spark, tmp_path):
    folder = write_file(tmp_path / "in", "a.csv", "LCLid,Date,KWH/hh,timestamp", "A,2024-01-01,1.0,2024-01-01 00:30:00")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        with pytest.raises(ValueError, match="Asia/Kolkata"):
            ingest(spark, folder, str(tmp_path / "warehouse"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert not (tmp_path / "warehouse").exists()


def test_appends_remove_their_staged_batch(spark, tmp_path):
    batch = readings(spark, ("A", "2024-01-01 00:30", 1), ("B", "2024-01-01 00:30", 2))
    assert tables.append_readings(batch, str(tmp_path)) == 2
    assert tables.append_readings(batch, str(tmp_path)) == 0
    assert not list((tmp_path / "staging").iterdir())
