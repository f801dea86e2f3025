"""Reading files in CSV with a header, in either of two layouts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from gridtally.operators.cleaning import is_identified
from gridtally.schema import (
    ENERGY,
    HALF_HOUR_HEADER,
    READING_HEADER,
    REQUIRED_COLUMNS,
)

CSV_OPTIONS = {
    "header": "true",
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
}


def csv_header(spark: SparkSession, path: str, glob: str = "*.csv") -> list[str]:
    """Column names in the first line of the files that match; reads one line."""
    try:
        return _reader(spark, glob).csv(path).columns
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(f"no files match {glob} in {path}") from error
        raise


def available_files(spark: SparkSession, path: str, glob: str = "*.csv") -> list[str]:
    """The files that match; FileNotFoundError if there are none."""
    header = csv_header(spark, path, glob)
    return _scan(spark, path, glob, header).inputFiles()


def validate_header(header: list[str]) -> None:
    """ValueError naming the missing columns, unless the header is of a known layout."""
    present = {name.lower() for name in header}
    if present.issuperset(name.lower() for name in HALF_HOUR_HEADER):
        return
    missing = [name for name in REQUIRED_COLUMNS if name.lower() not in present]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def read_csv_readings(spark: SparkSession, path: str, *globs: str) -> DataFrame:
    """Typed readings from the files of one folder.

    Columns are bound by the names in the header, in whatever order they stand.
    Values that do not parse become NULL. Without globs the first line of every
    ``*.csv`` file is read beforehand, so layouts and orders of columns may be mixed.
    With globs the files under each must share their header, which saves that job:
    Spark then compares the headers while scanning and stops if one differs.
    """
    return readings_of(scan_layouts(spark, path, *globs))


def readings_of(scans: list[DataFrame]) -> DataFrame:
    """Typed readings of tables of strings, each in either layout."""
    return _union([typed_readings(rows) for rows in scans])


def rejected_of(scans: list[DataFrame]) -> DataFrame:
    """The rows of scanned files that have no household, day or value.

    One row per different line of a file: ``source_file``; ``reason``, the names of what
    is missing or does not parse, comma-joined; ``fields``, the texts of the line as a JSON
    object without empty ones; ``copies``, how many lines are equal.
    """
    return _union([rejected_rows(rows, rows.columns, file_of(rows)) for rows in scans])


def rejected_rows(rows: DataFrame, header: list[str], file: Column) -> DataFrame:
    """The same of one table of strings, with the column that tells a row's file."""
    text = F.struct(*[F.col(f"`{name}`") for name in header])
    lines = rows.select(file.alias("source_file"), F.to_json(text).alias("fields"), *_typed(rows))
    missing = [F.when(F.col(name).isNull(), F.lit(name)) for name in ("lclid", "day", "energy_kwh")]
    rejected = lines.where(~is_identified()).withColumn("reason", F.concat_ws(",", *missing))
    return rejected.groupBy("source_file", "reason", "fields").agg(F.count("*").alias("copies"))


def scan_layouts(spark: SparkSession, path: str, *globs: str) -> list[DataFrame]:
    """The rows of the files as strings, one table per header."""
    if not globs:
        return _scan_by_header(spark, path, "*.csv")
    scans = []
    for glob in globs:
        header = csv_header(spark, path, glob)
        validate_header(header)
        scans.append(_scan(spark, path, glob, header))
    return scans


def first_lines(spark: SparkSession, path: str, glob: str) -> list[tuple[str, str]]:
    """File and first line that is not blank, of every file that has one.

    A file is one task, which stops after its first lines. The driver gets a line per
    file; Spark's listing of the folder holds as many entries there.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    listed = files.where("length > 0").select(file_of(files).alias("file"), "length").collect()
    if not listed:
        return []
    # Files as long as a whole split, and as costly to open, are not cut or packed. The
    # session is a new one, so that others keep their settings.
    largest = str(max(row["length"] for row in listed))
    probe = spark.newSession()
    probe.conf.set("spark.sql.files.maxPartitionBytes", largest)
    probe.conf.set("spark.sql.files.openCostInBytes", largest)
    probe.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    lines = probe.read.option("pathGlobFilter", glob).text(path)
    found = _headers_in(lines, _first_line)
    # A cluster that packs files all the same hides some behind others: these are read whole.
    hidden = [row["file"] for row in listed if row["file"] not in found]
    if hidden:
        found |= _headers_in(lines.where(file_of(lines).isin(hidden)), _first_line_of_each)
    return list(found.items())


def _headers_in(lines: DataFrame, pick: Callable) -> dict[str, str]:
    """The first lines that ``pick`` finds; where a file was cut, only its beginning counts."""
    start = lines.metadataColumn("_metadata")["file_block_start"]
    rows = lines.select(file_of(lines).alias("file"), start.alias("start"), "value")
    found = rows.mapInArrow(pick, "file string, start long, value string").where("start = 0")
    return {row["file"]: row["value"] for row in found.collect()}


def _first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from islice(_first_line_of_each(batches), 1)


def _first_line_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()
    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("file", "start", "value"))
        for place, (file, start, line) in enumerate(zip(*columns)):
            if line.strip() and (file, start) not in seen:
                seen.add((file, start))
                yield batch.slice(place, 1)


def _scan_by_header(spark: SparkSession, path: str, glob: str) -> list[DataFrame]:
    header = csv_header(spark, path, glob)
    files: dict[str, list[str]] = {}
    for file, line in first_lines(spark, path, glob):
        files.setdefault(line, []).append(file)
    if len(files) < 2:
        validate_header(header)
        return [_scan(spark, path, glob, header)]
    scans = []
    by_count = sorted(files.items(), key=lambda item: (-len(item[1]), item[0]))
    others = [file for _, listed in by_count[1:] for file in listed]
    for place, (line, listed) in enumerate(by_count):
        names = _names(spark, line)
        validate_header(names)
        # The most frequent header is that of all files but the others', so no list is
        # longer than it has to be. The condition leaves files out before any is opened.
        rows = _scan(spark, path, glob, names)
        rows = rows.where(file_of(rows).isin(listed) if place else ~file_of(rows).isin(others))
        scans.append(rows)
    return scans


def _names(spark: SparkSession, line: str) -> list[str]:
    """The column names of a header line, split as the scan splits it."""
    return spark.read.options(**CSV_OPTIONS).csv(spark.sparkContext.parallelize([line], 1)).columns


def file_of(rows: DataFrame) -> Column:
    """The file that a scanned row stands in, also if a header has a column of such a name."""
    return rows.metadataColumn("_metadata")["file_path"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def text_schema(header: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in header])


def typed_readings(rows: DataFrame) -> DataFrame:
    """Readings from rows of strings in either layout."""
    return rows.select(*_typed(rows))


def _typed(rows: DataFrame) -> list[Column]:
    present = {name.lower() for name in rows.columns}
    if present.issuperset(name.lower() for name in HALF_HOUR_HEADER):
        household, time, energy = HALF_HOUR_HEADER
        timestamp = _time(time)
        day = F.to_date(timestamp)
    else:
        household, date, energy, time = READING_HEADER
        day = F.when(_field(date).rlike(f"^{_DATE}$"), _field(date)).try_cast("date")
        timestamp = F.lit(None).cast("timestamp")
        if time in present:
            timestamp = _time(time)
    return [
        F.col(household).alias("lclid"),
        day.alias("day"),
        _field(energy).try_cast(ENERGY).alias("energy_kwh"),
        timestamp.alias("timestamp"),
    ]


# A cast alone takes a time for one of today, a year for its first day, and a zone.
_DATE = r"\d{4}-\d{2}-\d{2}"
_TIME = rf"{_DATE}[ T]\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?"


def _time(name: str) -> Column:
    """The instant of a complete date and time without zone; NULL for anything else."""
    return F.when(_field(name).rlike(f"^{_TIME}$"), _field(name)).try_cast("timestamp")


def _field(name: str) -> Column:
    return F.trim(F.col(f"`{name}`"))


def _reader(spark: SparkSession, glob: str):
    return spark.read.options(**CSV_OPTIONS, pathGlobFilter=glob)


def _scan(spark: SparkSession, path: str, glob: str, header: list[str]) -> DataFrame:
    reader = _reader(spark, glob).schema(text_schema(header))
    return reader.option("enforceSchema", "false").csv(path)
