"""Stored tables: appends, replacements, names in SQL, the whole pipeline."""

from functools import partial

import pytest

from gridtally.operators import rollups
from gridtally.operators.cleaning import clean_readings, deduplicate, identified
from gridtally.plans.pipeline import ingest, load, run_pipeline, table_counts
from gridtally.schema import DATASETS, RAW_TABLE, READING
from gridtally.session import materialize
from gridtally.sources import tables
from gridtally.streaming.incremental import ingest_new_files
from helpers import D, date, plan_of, readings, rows_of, time, write_file

DAY = date("2024-01-01")
HEADER = "LCLid,day,energy_kwh,timestamp"


def test_append_skips_known_keys_also_without_timestamp(spark, tmp_path):
    warehouse = str(tmp_path)
    batch = spark.createDataFrame(
        [("A", DAY, D(1), time("2024-01-01 00:00")), ("A", DAY, D(2), None), ("B", DAY, D(3), None)], READING
    )
    tables.append_readings(batch, warehouse)
    tables.append_readings(batch, warehouse)
    assert tables.read_raw(spark, warehouse).count() == 3
    more = spark.createDataFrame([("A", DAY, D(9), None), ("C", date("2024-02-01"), D(4), None)], READING)
    tables.append_readings(more, warehouse)
    assert {(r["lclid"], r["energy_kwh"]) for r in tables.read_raw(spark, warehouse).collect()} == {
        ("A", D(1)), ("A", D(2)), ("B", D(3)), ("C", D(4))}


def test_append_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], READING)
    tables.append_readings(empty, str(tmp_path))
    tables.append_readings(empty, str(tmp_path))
    assert tables.read_raw(spark, str(tmp_path)).count() == 0


def test_period_prunes_month_folders(spark, tmp_path):
    rows = readings(spark, ("A", "2024-01-31 10:00", 1), ("A", "2024-02-01 10:00", 2), ("A", "2024-03-01 10:00", 3))
    tables.append_readings(rows, str(tmp_path))
    kept = tables.read_raw(spark, str(tmp_path), date("2024-02-01"), date("2024-02-29"))
    assert rows_of(kept) == [("A", date("2024-02-01"), D(2), time("2024-02-01 10:00"))]
    assert "PartitionFilters: [isnotnull(month" in plan_of(kept)


def test_hot_month_and_household_make_even_files(spark, tmp_path):
    rows = spark.range(200_000).selectExpr(
        "IF(id % 3 = 0, 'HOT', CAST(id % 500 AS STRING)) AS lclid",
        "date '2024-01-01' AS day",
        "CAST(id % 90 AS DECIMAL(10,4)) AS energy_kwh",
        "timestamp_seconds(1704067200 + id) AS timestamp",
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.append_readings(rows, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    raw = spark.read.parquet(tables.table_path(str(tmp_path), RAW_TABLE))
    sizes = [row["count"] for row in raw.selectExpr("_metadata.file_path AS f").groupBy("f").count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 200_000
    assert max(sizes) < 1.5 * min(sizes)


def test_overwrite_with_an_empty_dataset(spark, tmp_path):
    folder, warehouse = f"{tmp_path}/processed", str(tmp_path)
    full = rollups.daily_rollup(rollups.household_days(readings(spark, ("A", "2024-01-01 00:00", 1))))
    for frame, rows in ((full, 1), (full.where("false"), 0)):
        tables.write_dataset(frame, folder, "daily")
        tables.load_dataset(spark, folder, "daily", warehouse)
        assert tables.read_table(spark, warehouse, "daily").count() == rows
    assert tables.read_table(spark, warehouse, "daily").schema == DATASETS["daily"]


def test_loaded_files_hold_separate_ranges(spark, tmp_path):
    rows = spark.range(1000).selectExpr(
        "CAST(id AS STRING) AS lclid", "timestamp_seconds(1704067200 + id * 60) AS timestamp",
        "CAST(1 AS DECIMAL(10,4)) AS energy_kwh", "CAST(4 AS DECIMAL(10,4)) AS z_score", "'outlier' AS anomaly_type",
    )
    tables.write_dataset(rows, f"{tmp_path}/processed", "anomalies")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.load_dataset(spark, f"{tmp_path}/processed", "anomalies", str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    table = tables.read_table(spark, str(tmp_path), "anomalies")
    ranges = (
        table.selectExpr("_metadata.file_path AS file", "timestamp")
        .groupBy("file").agg({"timestamp": "min"}).orderBy("min(timestamp)").collect()
    )
    ends = (
        table.selectExpr("_metadata.file_path AS file", "timestamp")
        .groupBy("file").agg({"timestamp": "max"}).orderBy("max(timestamp)").collect()
    )
    assert len(ranges) == 8 and table.count() == 1000
    for this_end, next_start in zip(ends, ranges[1:]):
        assert this_end[1] < next_start[1]


def test_run_together_raises_the_first_failure(spark):
    def fail():
        raise RuntimeError("disk full")

    with pytest.raises(RuntimeError, match="disk full"):
        tables.run_together(spark, [lambda: None, fail])


def source(tmp_path):
    lines = [f"A,2024-01-01,{1 + (i == 11) * 60},2024-01-01 {i:02d}:00:00" for i in range(12)]
    return write_file(
        tmp_path / "in", "a.csv", HEADER, *lines, lines[0], "B,2024-01-02,500,2024-01-02 00:00:00",
        "B,2024-01-02,5,2024-01-02 01:00:00", "B,2024-01-02,-5,2024-01-02 02:00:00", ",2024-01-02,1,2024-01-02 00:00:00",
    )


def test_pipeline_from_files_to_sql(spark, tmp_path):
    warehouse = f"{tmp_path}/warehouse"
    folder = source(tmp_path)
    first = rows_of(run_pipeline(spark, folder, warehouse))
    assert first == sorted(
        [("raw", 15), ("hourly", 13), ("daily", 2), ("weekly", 1), ("monthly", 1),
         ("household_stats", 2), ("anomalies", 1)], key=repr)
    # A second run adds nothing.
    assert rows_of(run_pipeline(spark, folder, warehouse)) == first
    tables.register_tables(spark, warehouse)
    tables.register_tables(spark, warehouse)
    assert spark.sql("SELECT COUNT(*) FROM raw.energy_consumption").first()[0] == 15
    latest = spark.sql("SELECT * FROM analytics.daily_consumption ORDER BY day DESC LIMIT 1").first()
    assert (latest["day"], latest["total_consumption"]) == (date("2024-01-02"), D(5))
    assert latest["created_at"] is not None
    top = spark.sql("SELECT * FROM analytics.household_stats ORDER BY total_consumption DESC LIMIT 10").collect()
    assert [row["lclid"] for row in top] == ["A", "B"]
    assert spark.sql("SELECT z_score FROM analytics.anomalies").first()[0] == D("3.1754")


def test_datasets_equal_direct_rollups(spark, tmp_path):
    warehouse = f"{tmp_path}/warehouse"
    run_pipeline(spark, source(tmp_path), warehouse)
    clean = clean_readings(tables.read_raw(spark, warehouse))
    days = rollups.household_days(clean)
    direct = {
        "hourly": rollups.hourly_rollup(clean),
        "daily": rollups.daily_rollup(days),
        "weekly": rollups.weekly_rollup(days),
        "monthly": rollups.monthly_rollup(days),
        "household_stats": rollups.household_stats(days),
    }
    for name, frame in direct.items():
        assert rows_of(tables.read_table(spark, warehouse, name)) == rows_of(frame)


def test_incremental_ingest_reads_each_file_once(spark, tmp_path):
    import os

    warehouse, folder = f"{tmp_path}/warehouse", tmp_path / "in"
    write_file(folder, "a.csv", HEADER, "A,2024-01-01,1,2024-01-01 00:00:00")
    assert ingest_new_files(spark, str(folder), warehouse) == dict(read=1, identified=1, plausible=1, added=1)
    # A late file that is months older than the first, and overlaps it.
    write_file(folder, "b.csv", HEADER, "A,2024-01-01,7,2024-01-01 00:00:00", "B,2024-01-01,2,2024-01-01 00:00:00", ",2024-01-01,2,", "C,2024-01-01,-2,")
    os.utime(folder / "b.csv", (1_600_000_000, 1_600_000_000))
    assert ingest_new_files(spark, str(folder), warehouse) == dict(read=4, identified=3, plausible=2, added=2)
    assert set(ingest_new_files(spark, str(folder), warehouse).values()) == {0}
    found = [(r[0], r[2]) for r in rows_of(tables.read_raw(spark, warehouse))]
    assert found == [("A", D(1)), ("B", D(2)), ("C", D(-2))]


def test_ingest_of_the_same_files_twice(spark, tmp_path):
    warehouse, folder = f"{tmp_path}/warehouse", source(tmp_path)
    ingest(spark, folder, warehouse)
    once = rows_of(tables.read_raw(spark, warehouse))
    ingest(spark, folder, warehouse)
    assert rows_of(tables.read_raw(spark, warehouse)) == once and len(once) == 15


def test_ranges_follow_the_bytes_of_the_files(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(200_000).selectExpr("id", "uuid() AS name").write.parquet(path)
    rows = spark.read.parquet(path)
    size = sum(file.stat().st_size for file in (tmp_path / "rows").glob("*.parquet"))
    many = tables.by_ranges(rows, "id", range_bytes=size // 40)
    assert many.rdd.getNumPartitions() >= 40
    assert many.count() == 200_000
    assert tables.by_ranges(rows, "id").rdd.getNumPartitions() <= 8
    # A source without a size goes by the session.
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(1,), (2,)]), "id long")
    assert tables.by_ranges(unknown, "id").rdd.getNumPartitions() <= 8


def test_an_append_has_as_many_ranges_as_its_bytes_ask_for(spark, tmp_path, monkeypatch):
    rows = readings(spark, *[("A", f"2024-01-{d:02d} {h:02d}:00", 1) for d in range(1, 29) for h in range(24)])
    stored = materialize(rows, "readings")
    assert tables.append_readings(stored, f"{tmp_path}/usual") == 28 * 24
    monkeypatch.setattr(tables, "RANGE_BYTES", 100)
    assert tables.append_readings(stored, f"{tmp_path}/small") == 28 * 24
    count = lambda name: len(list((tmp_path / name).rglob("*.parquet")))
    assert count("small") > 8 >= count("usual")
    assert rows_of(tables.read_raw(spark, f"{tmp_path}/small")) == rows_of(tables.read_raw(spark, f"{tmp_path}/usual"))
