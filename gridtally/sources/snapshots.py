"""Tables that are replaced in one step, also on object stores.

A table is a folder with the data of its versions in ``_data`` and a numbered file per
commit in ``_commits``. A commit is a few lines of JSON that name the folders of the
version; the one with the highest number is the table. Data are written first, to a
folder of their own, and never moved: the commit file alone makes them visible. A
reader therefore sees the old or the new version, whatever step a load is at or died in,
and a version stays for readers that have begun until two more were committed.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

COMMITS, DATA = "_commits", "_data"
# Versions that stay readable.
KEPT = 2
_COMMIT = re.compile(r"(\d{12})\.json")


class CommitConflict(RuntimeError):
    """Another run committed first."""


class Folder:
    """The files below a path, in whatever store it lies."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._read = spark._jvm.org.apache.commons.io.IOUtils
        self.path = path.rstrip("/")
        self._store = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def at(self, name: str = ""):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder; nothing if it does not exist."""
        if not self._store.exists(self.at(name)):
            return []
        return sorted(status.getPath().getName() for status in self._store.listStatus(self.at(name)))

    def size(self, name: str) -> list[int]:
        """How many files a folder holds, and their bytes."""
        summary = self._store.getContentSummary(self.at(name))
        return [summary.getFileCount(), summary.getLength()]

    def text(self, name: str) -> str:
        stream = self._store.open(self.at(name))
        try:
            return self._read.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a small file that appears whole or not at all; CommitConflict if it exists.

        Only this file is renamed, which a file system does in one step; an object
        store copies it and shows the copy when it is complete.
        """
        folder, _, own = name.rpartition("/")
        draft = f"{folder}/.{own}-{uuid.uuid4().hex}"
        stream = self._store.create(self.at(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._store.exists(self.at(name)) or not self._store.rename(self.at(draft), self.at(name)):
            self.remove(draft)
            raise CommitConflict(f"{name} of {self.path} exists")

    def remove(self, name: str = "") -> None:
        self._store.delete(self.at(name), True)


def latest(spark: SparkSession, table: str) -> tuple[int, dict]:
    """Number and content of the last commit; 0 and nothing before the first."""
    folder = Folder(spark, table)
    for attempt in range(5):
        numbers = [int(m[1]) for name in folder.names(COMMITS) if (m := _COMMIT.fullmatch(name))]
        if not numbers:
            return 0, {}
        try:
            return max(numbers), json.loads(folder.text(f"{COMMITS}/{max(numbers):012d}.json"))
        except Py4JJavaError:
            # Two more versions were committed since the listing.
            if attempt == 4:
                raise
    raise AssertionError


def commit(spark: SparkSession, table: str, after: int, content: dict) -> int:
    """Make ``content`` the table, if ``after`` is still its last commit.

    ``content["folders"]`` names the folders of the version, relative to the table.
    Folders that no kept version names are removed.
    """
    folder, number = Folder(spark, table), after + 1
    folder.put(f"{COMMITS}/{number:012d}.json", json.dumps(content, indent=1, sort_keys=True))
    _expire(folder, number)
    return number


def _expire(folder: Folder, number: int) -> None:
    versions = {int(m[1]): name for name in folder.names(COMMITS) if (m := _COMMIT.fullmatch(name))}
    named: dict[int, set[str]] = {}
    for n, name in versions.items():
        named[n] = set(json.loads(folder.text(f"{COMMITS}/{name}"))["folders"])
    kept = set().union(*[own for n, own in named.items() if n > number - KEPT])
    for n in sorted(n for n in versions if n <= number - KEPT):
        folder.remove(f"{COMMITS}/{versions[n]}")
        for own in named[n] - kept:
            folder.remove(own)


def new_data(name: str = "") -> str:
    """A folder below a table that no other write uses."""
    return f"{DATA}/{name}{'-' if name else ''}{uuid.uuid4().hex}"


def replace(df: DataFrame, table: str) -> None:
    """Make the rows of ``df`` the table. A write that fails leaves the table as it is."""
    spark, table = df.sparkSession, table.rstrip("/")
    own = new_data()
    try:
        df.write.parquet(f"{table}/{own}")
        while True:
            number, _ = latest(spark, table)
            try:
                commit(spark, table, number, {"folders": [own]})
                break
            except CommitConflict:
                continue  # the last of two loads at once is the table
    except BaseException:
        Folder(spark, table).remove(own)
        raise
    if not number:
        # Files of a table that was written before it had versions.
        folder = Folder(spark, table)
        for name in folder.names():
            if name not in (COMMITS, DATA):
                folder.remove(name)
    spark.catalog.refreshByPath(table)


def folders(spark: SparkSession, table: str) -> list[str]:
    """Where the current version lies; empty if there is no table."""
    number, content = latest(spark, table)
    if number:
        return [f"{table.rstrip('/')}/{name}" for name in content["folders"]]
    plain = [name for name in Folder(spark, table).names() if name[0] not in "._"]
    return [table] if plain else []


def read(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The current version; FileNotFoundError if there is no table."""
    found = folders(spark, table)
    if not found:
        raise FileNotFoundError(f"no table at {table}")
    return spark.read.schema(schema).parquet(*found)
