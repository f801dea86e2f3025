"""Ingest only the files that arrived since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from gridtally.operators.cleaning import deduplicate, identified, intake_counts
from gridtally.schema import MAX_PLAUSIBLE_KWH, RAW_TABLE
from gridtally.session import require_utc
from gridtally.sources.csv_readings import (
    CSV_OPTIONS,
    csv_header,
    file_of,
    rejected_rows,
    text_schema,
    typed_readings,
    validate_header,
)
from gridtally.sources.tables import append_readings, append_rejected, table_path


def ingest_new_files(
    spark: SparkSession,
    source: str,
    warehouse: str,
    glob: str = "*.csv",
    max_kwh: float = MAX_PLAUSIBLE_KWH,
    stream_name: str = "readings",
) -> dict[str, int]:
    """Add the readings of files that no earlier run has seen, then stop.

    The daily run over a growing folder then costs what is new, not the whole
    history. The stream's checkpoint, kept beside the raw table, remembers the files;
    use one ``stream_name`` per source and glob. A batch that is repeated after a
    failure adds nothing twice. Returns the counts of ``ingest``, over all batches of
    this run.
    """
    require_utc(spark)
    header = csv_header(spark, source, glob)
    validate_header(header)
    files = spark.readStream.schema(text_schema(header)).options(
        **CSV_OPTIONS,
        pathGlobFilter=glob,
        enforceSchema="false",
        # By default a file a week older than the newest one would be skipped.
        maxFileAge="36500d",
    )

    counts = dict.fromkeys(("read", "identified", "plausible", "added"), 0)

    def add(rows: DataFrame, _batch_id: int) -> None:
        seen = Observation()
        readings = typed_readings(rows).observe(seen, *intake_counts(max_kwh))
        added = append_readings(deduplicate(identified(readings), max_kwh), warehouse)
        if seen.get["read"] > seen.get["identified"]:
            append_rejected(rejected_rows(rows, header, F.col(file)), warehouse)
        for name, count in {**seen.get, "added": added}.items():
            counts[name] += count

    # A micro-batch no longer knows the files of its rows.
    rows = files.csv(source)
    file = "source_file"
    while file in {name.lower() for name in header}:
        file += "_"
    stream = (
        rows.select("*", file_of(rows).alias(file))
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", f"{table_path(warehouse, RAW_TABLE)}_files/{stream_name}")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return counts
