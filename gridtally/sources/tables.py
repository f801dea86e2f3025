"""Stored tables: the raw readings, the derived datasets and the warehouse."""

from __future__ import annotations

import datetime as dt
import math
import uuid

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from gridtally.functions.periods import day_in, month_of
from gridtally.schema import (
    ANALYTICS_TABLES,
    DATASETS,
    LOOKUP_KEYS,
    RAW,
    RAW_TABLE,
    READING,
    READING_KEY,
    REJECTED,
    REJECTED_TABLE,
    conform,
)
from gridtally.session import ROWS_PER_TASK, materialize
from gridtally.sources import snapshots

# Bytes of what is stored, by the planner's estimate, that go to one range of a table.
RANGE_BYTES = 256 * 1024 * 1024
# The estimate of rows whose source has no size, such as those of a micro-batch.
_UNKNOWN_BYTES = 1 << 62

CREATED_AT = T.StructField("created_at", T.TimestampType())


def table_path(warehouse: str, table: str) -> str:
    """``schema.table`` as a folder of the warehouse."""
    return f"{warehouse.rstrip('/')}/{table.replace('.', '/')}"


def stored_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The table at ``path``, or None where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def run_together(spark: SparkSession, writes: list[Callable[[], None]]) -> None:
    """Start independent writes at once, so that small jobs fill idle executors."""
    with ThreadPoolExecutor(max_workers=len(writes)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(write)) for write in writes]
    for write in started:
        write.result()


def by_ranges(df: DataFrame, *keys: str, range_bytes: int | None = None) -> DataFrame:
    """Rows dealt by ranges of ``keys``.

    There are as many ranges as the session says, of which adaptive execution merges
    small ones; more if one of them would take over ``range_bytes`` bytes, because a
    range is not split later. Bytes are those of the files that are scanned.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = math.ceil(size / (range_bytes or RANGE_BYTES))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if usual < ranges and size < _UNKNOWN_BYTES:
        return df.repartitionByRange(ranges, *keys)
    return df.repartitionByRange(*keys)


# --- raw readings ----------------------------------------------------------


def raw_months(spark: SparkSession, warehouse: str) -> dict[dt.date, list[int]]:
    """The months of the raw table, with the number and bytes of their files.

    Appends only add files, so a month whose files are as before is as before.
    """
    folder = snapshots.Folder(spark, table_path(warehouse, RAW_TABLE))
    months = {}
    for name in folder.names():
        if name.startswith("month=") and name != "month=__HIVE_DEFAULT_PARTITION__":
            months[dt.date.fromisoformat(name.removeprefix("month="))] = folder.size(name)
    return months


def read_raw(
    spark: SparkSession,
    warehouse: str,
    start: dt.date | None = None,
    end: dt.date | None = None,
    months: list[dt.date] | None = None,
) -> DataFrame:
    """Readings of the raw table. A period of days, or a list of months, prunes the folders."""
    first_month = None if start is None else start.replace(day=1)
    raw = spark.read.schema(RAW).parquet(table_path(warehouse, RAW_TABLE))
    if months is not None:
        raw = raw.where(F.col("month").isin(months))
    kept = raw.where(day_in(F.col("month"), first_month, end) & day_in(F.col("day"), start, end))
    return kept.select(*READING.names)


def append_readings(batch: DataFrame, warehouse: str) -> int:
    """Add the readings of ``batch`` whose key the raw table does not hold yet.

    ``batch`` must hold each key once. Appending the same batch again adds nothing,
    also after a run that died half-way. Returns how many were added.
    """
    spark = batch.sparkSession
    path = table_path(warehouse, RAW_TABLE)
    stored = stored_table(spark, path, RAW)
    if stored is None:
        return _add_readings(batch, path)
    # A folder of its own, so that two appends at once do not meet.
    staging = f"{warehouse.rstrip('/')}/staging/{uuid.uuid4().hex}"
    try:
        return _add_readings(new_readings(materialize(batch, "batch", staging), stored), path)
    finally:
        _remove(spark, staging)


def _add_readings(batch: DataFrame, path: str) -> int:
    stamped = conform(batch, READING).select(
        "*", F.current_timestamp().alias("created_at"), month_of(F.col("day")).alias("month")
    )
    # One folder per month. Ranges of the unique key are even however large a month or
    # a household is, and a task meets few months, so few files. The readings of a
    # household and day stay side by side: later sums shrink them before any shuffle.
    order = ("month", *READING_KEY)
    added = Observation()
    arranged = by_ranges(stamped, *order).observe(added, F.count("*").alias("rows"))
    writer = arranged.sortWithinPartitions(*order).write.mode("append").partitionBy("month")
    # A task cannot take less than a group of rows within a file.
    writer.option("maxRecordsPerFile", ROWS_PER_TASK).parquet(path)
    return added.get["rows"]


def new_readings(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Readings of ``batch`` whose key is not in ``existing``.

    Missing timestamps are equal. Only the days that the batch spans are read from
    ``existing``, and of a table in month folders only the months it touches; months
    are few, so their list goes to the driver.
    """
    span = batch.agg(
        F.min("day").alias("first"),
        F.max("day").alias("last"),
        F.collect_set(month_of(F.col("day"))).alias("months"),
        F.count_if(F.col("day").isNull()).alias("undated"),
    ).first()
    if not span["months"] and not span["undated"]:
        return batch
    if "month" in existing.columns:
        existing = existing.where(F.col("month").isin(span["months"]) | F.col("month").isNull())
    dated = day_in(F.col("day"), span["first"], span["last"]) if span["months"] else F.lit(False)
    nearby = existing.where(dated | F.col("day").isNull())
    seen = nearby.select(*[F.col(name).alias(f"seen_{name}") for name in READING_KEY])
    same = [F.col(name).eqNullSafe(F.col(f"seen_{name}")) for name in READING_KEY]
    return batch.join(seen, same, "left_anti")


def append_rejected(rejected: DataFrame, warehouse: str) -> int:
    """Add the rejected lines of files that are not stored yet; returns how many.

    A line is known by its file and its fields, so reading a file again adds nothing.
    """
    path = table_path(warehouse, REJECTED_TABLE)
    stored = stored_table(rejected.sparkSession, path, REJECTED)
    if stored is not None:
        rejected = rejected.join(stored, ["source_file", "fields"], "left_anti")
    added = Observation()
    counted = conform(rejected, REJECTED).observe(added, F.count("*").alias("rows"))
    counted.write.mode("append").parquet(path)
    return added.get["rows"]


def read_rejected(spark: SparkSession, warehouse: str) -> DataFrame:
    """The rejected lines of all files; none before the first."""
    stored = stored_table(spark, table_path(warehouse, REJECTED_TABLE), REJECTED)
    return spark.createDataFrame([], REJECTED) if stored is None else stored


# --- derived datasets ------------------------------------------------------


def _remove(spark: SparkSession, path: str) -> None:
    snapshots.Folder(spark, path).remove()


def replace_table(df: DataFrame, path: str) -> None:
    """Make the rows of ``df`` the table at ``path``; readers see the old or the new one."""
    snapshots.replace(df, path)


def write_dataset(df: DataFrame, folder: str, name: str) -> None:
    """Replace the stored dataset ``name``, also by an empty one.

    The rebalance packs a small dataset into one file and a large one into several.
    """
    replace_table(df.hint("rebalance"), f"{folder}/{name}")


def read_dataset(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return snapshots.read(spark, f"{folder}/{name}", DATASETS[name])


def load_dataset(spark: SparkSession, folder: str, name: str, warehouse: str) -> None:
    """Replace the warehouse table of a stored dataset, stamped with the load time.

    Rows are ordered by the lookup keys across all files, so that a period or a
    household is found by the value ranges in the file footers.
    """
    schema = T.StructType([*DATASETS[name].fields, CREATED_AT])
    rows = read_dataset(spark, folder, name).withColumn("created_at", F.current_timestamp())
    keys = LOOKUP_KEYS[name]
    ordered = by_ranges(conform(rows, schema), *keys).sortWithinPartitions(*keys)
    replace_table(ordered, table_path(warehouse, ANALYTICS_TABLES[name]))
    _follow(spark, warehouse, ANALYTICS_TABLES[name])


def read_table(spark: SparkSession, warehouse: str, name: str) -> DataFrame:
    """The warehouse table of a dataset, without its load time."""
    return snapshots.read(spark, table_path(warehouse, ANALYTICS_TABLES[name]), DATASETS[name])


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _is_own(spark: SparkSession, table: str) -> tuple[bool, str]:
    """Whether the library made the external table ``table``, and where it lies."""
    facts = spark.sql(f"DESCRIBE TABLE EXTENDED {table}")
    kind = facts.where("col_name = 'Type'").first()
    location = facts.where("col_name = 'Location'").first()
    folder = location["data_type"].rstrip("/") if location else ""
    below = "/" + table.replace(".", "/")
    made = folder.endswith(below) or f"{below}/{snapshots.DATA}/" in folder
    return bool(kind and kind["data_type"] == "EXTERNAL" and made), folder


def _forget_own(spark: SparkSession, table: str) -> None:
    """Drop the name of an external table that this library made; its files stay.

    Raises for any other table: its files would go with a managed one.
    """
    if not _is_own(spark, table)[0]:
        raise ValueError(f"{table} is a table that this library did not make; it is left as it is")
    spark.sql(f"DROP TABLE {table}")


def _follow(spark: SparkSession, warehouse: str, table: str) -> None:
    """Let the name of a table that was registered for this warehouse mean its new version."""
    if not spark.catalog.tableExists(table):
        return
    path = table_path(warehouse, table)
    own, folder = _is_own(spark, table)
    if own and f"{path}/" in f"{folder}/":
        spark.sql(f"ALTER TABLE {table} SET LOCATION {_quoted(snapshots.folders(spark, path)[0])}")
        spark.catalog.refreshTable(table)


def register_tables(spark: SparkSession, warehouse: str) -> None:
    """Make the stored tables known to ``spark.sql`` under their schema and name.

    A name means the version that is current now; loads of this session, and of others
    that share its catalog, move it on. A table of that name that the library did not
    make is never dropped: an error names it.
    """
    tables = {RAW_TABLE: RAW}
    for name, table in ANALYTICS_TABLES.items():
        tables[table] = T.StructType([*DATASETS[name].fields, CREATED_AT])
    for table, schema in tables.items():
        path = table_path(warehouse, table)
        if table == RAW_TABLE:
            found = [path] if stored_table(spark, path, schema) is not None else []
        else:
            found = snapshots.folders(spark, path)
        if not found:
            continue
        database = table.split(".")[0]
        folder = table_path(warehouse, database)
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION {_quoted(folder)}")
        partitions = "PARTITIONED BY (month)" if table == RAW_TABLE else ""
        if spark.catalog.tableExists(table):
            _forget_own(spark, table)
        spark.sql(
            f"CREATE TABLE {table} ({schema.toDDL()}) USING parquet {partitions} LOCATION {_quoted(found[0])}"
        )
        if partitions:
            spark.catalog.recoverPartitions(table)
