"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

UTC_ZONES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"
# Rows of a stored table that one task sums: some 230 bytes of memory each, where each is a group.
ROWS_PER_TASK = 2_000_000


def build_session(app_name: str = "gridtally", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; ``conf`` overrides them.

    Hours and days are cut in UTC, so results do not depend on the machine. Shuffle
    partition counts are left to the cluster: adaptive execution coalesces them.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "static",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local master, where driver and executors are one process, may fall back
    to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "gridtally")


def require_utc(spark: SparkSession) -> None:
    """ValueError unless the session cuts hours and days in UTC.

    Stored times are instants: written in one zone and read in another, a reading
    would fall into another hour than its day says.
    """
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_ZONES:
        raise ValueError(f"set spark.sql.session.timeZone to UTC, not {zone}")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of what is run inside as soon as it has ended.

    Nothing reads them once a table is written; else they stay until the driver
    collects its garbage, and fill the executors' disks in a chain of tables.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


@contextmanager
def bounded_scans(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Scans that start inside take about ROWS_PER_TASK rows a task at most.

    ``rows`` and ``size``, in bytes, are those of the table. A split is cut by bytes, and
    well-packed sums take a few bytes a row, so that a usual split holds tens of millions.
    """
    before = spark.conf.get(SPLIT_BYTES, None)
    usual = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    spark.conf.set(SPLIT_BYTES, str(max(min(usual, size * ROWS_PER_TASK // max(rows, 1)), 1)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SPLIT_BYTES)
        else:
            spark.conf.set(SPLIT_BYTES, before)


def stored_size(stored: DataFrame) -> tuple[int, int]:
    """Rows, from the footers of its files, and bytes of a stored table."""
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return stored.count(), size


def materialize(df: DataFrame, name: str, folder: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` once and read it back.

    It goes to ``folder``, replacing what is there under ``name``, or to a new place
    in the shared folder. What follows survives the loss of executors without
    recomputing ``df``, and the planner knows the true size of the table. The shuffle
    files of the write are removed. ``options`` go to the writer.
    """
    path = new_folder(df.sparkSession, name) if folder is None else f"{folder}/{name}"
    with shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
