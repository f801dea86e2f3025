"""Stored household days are not summed, shuffled and held again for each dataset."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridtally.operators.cleaning import clean_readings
from gridtally.operators.rollups import household_day_state, one_row_a_day
from gridtally.plans import pipeline
from gridtally.schema import READING
from gridtally.session import SPLIT_BYTES, bounded_scans, stored_size
from helpers import plan_of, rows_of

DIRECT = ("daily", "weekly", "monthly", "household_stats")


def days(spark, late):
    """Readings of three households; with ``late`` some times are of the day after."""
    rows = spark.range(600).select(
        F.concat(F.lit("H"), F.col("id") % 3).alias("lclid"),
        F.date_add(F.lit(dt.date(2024, 1, 30)), (F.col("id") % 5).cast("int")).alias("day"),
        (F.col("id") % 17).cast("decimal(10,4)").alias("energy_kwh"),
        F.col("id"),
    )
    time = F.unix_seconds(F.col("day").cast("timestamp")) + F.col("id") * 60
    if late:
        time = F.when(F.col("id") % 7 == 0, time + 86400).otherwise(time)
    return rows.withColumn("timestamp", F.timestamp_seconds(time)).select(*READING.names)


@pytest.mark.parametrize("late", [False, True])
def test_datasets_read_household_days_without_summing_them(spark, late):
    readings = days(spark, late)
    assert one_row_a_day(household_day_state(clean_readings(readings))) is not late
    datasets = pipeline.transform(readings)
    for name in DIRECT:
        keys = [line.split("hashpartitioning(")[1] for line in plan_of(datasets[name]).splitlines() if "Exchange hashpartitioning(" in line]
        assert keys and not any("lclid#" in key and "day#" in key and "date_trunc" not in key for key in keys), name
    hourly = plan_of(datasets["hourly"])
    assert ("hashpartitioning(lclid#" in hourly) is late
    # The households of an hour and the days of a household, counted from the readings.
    seen = readings.groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(F.countDistinct("lclid").cast("int").alias("n"))
    assert rows_of(datasets["hourly"].select("hour", "household_count")) == rows_of(seen)
    stats = readings.groupBy("lclid").agg(F.countDistinct("day").cast("int").alias("n"), F.sum("energy_kwh").cast("decimal(20,4)"))
    assert rows_of(datasets["household_stats"].select("lclid", "days_count", "total_consumption")) == rows_of(stats)


def test_a_task_sums_a_bounded_number_of_stored_rows(spark, tmp_path, monkeypatch):
    """Before, a task took 128 MB of files, whatever the rows in them."""
    monkeypatch.setattr("gridtally.session.ROWS_PER_TASK", 100)
    stored = spark.range(0, 1000, 1, 10)
    stored.write.parquet(str(tmp_path / "rows"))
    usual = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "0"}
    for name, value in usual.items():
        spark.conf.set(name, value)
    try:
        def tasks():
            return spark.read.schema("id long").parquet(str(tmp_path / "rows")).rdd.getNumPartitions()

        table = spark.read.schema("id long").parquet(str(tmp_path / "rows"))
        before = spark.conf.get(SPLIT_BYTES)
        assert tasks() == 1 and stored_size(table)[0] == 1000
        with bounded_scans(spark, *stored_size(table)):
            assert tasks() >= 10
        assert spark.conf.get(SPLIT_BYTES) == before and tasks() == 1
    finally:
        for name in usual:
            spark.conf.unset(name)
