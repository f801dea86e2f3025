"""JDBC options. No database is started, so reads and writes are not run."""

from gridtally.sources.jdbc import read_options, write_options
from helpers import time


def test_scan_is_split_by_timestamp():
    options = read_options("jdbc:x", time("2011-01-01"), time("2014-12-31"), 64)
    assert options["partitionColumn"] == "timestamp"
    assert (options["lowerBound"], options["upperBound"]) == ("2011-01-01 00:00:00", "2014-12-31 00:00:00")
    assert options["numPartitions"] == "64" and options["dbtable"] == "raw.energy_consumption"


def test_overwrite_truncates():
    options = write_options("jdbc:x", "analytics.daily_consumption")
    assert options["truncate"] == "true" and options["dbtable"] == "analytics.daily_consumption"
