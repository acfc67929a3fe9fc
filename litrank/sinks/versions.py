"""Tables that change by whole versions (K2, K4, K5): a pointer to the current one, and counters
kept by the deltas of ingest batches (A1, K4, J3).

A version is a new Parquet folder below the table. Its number is claimed by creating the pointer
file of that number, which a file system lets only one writer do (object stores need conditional
puts for it). Readers take the highest pointer; a version without one, of a writer that died, is
never read. A writer names the version it started from, so that of two writers the later one is
told that it lost, and can start again from the version that won.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litrank.operators.aggregates import item_counters


class LostWriter(RuntimeError):
    """Another writer has committed since the version this one started from."""


class StaleCounters(RuntimeError):
    """The counters are not those of the link version that was asked for."""


class VersionedTable:
    """Versions of a table below ``path``; every reader resolves the current one by itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, number: int):
        return self._path(f"{self.path}/_versions/{number:012d}")

    def current(self) -> tuple[int, dict]:
        """Number and note of the current version; (0, {}) before the first commit. A pointer that
        its writer has not finished is not current yet."""
        folder = self._path(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            return 0, {}
        names = sorted((int(f.getPath().getName()) for f in self._fs.listStatus(folder)
                        if f.getPath().getName().isdigit()), reverse=True)
        for number in names:
            stream = self._fs.open(self._pointer(number))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if text.endswith("\n"):
                return number, json.loads(text)
        return 0, {}

    def read(self) -> DataFrame | None:
        """The current version, or None before the first commit."""
        number, note = self.current()
        return self.spark.read.parquet(note["folder"]) if number else None

    def commit(self, df: DataFrame, started_from: int, **note) -> int:
        """Write ``df`` as the version after ``started_from`` and make it current. The data is
        whole before its pointer exists. Raises ``LostWriter`` if that number is taken."""
        number = started_from + 1
        folder = f"{self.path}/version={number}-{uuid.uuid4().hex[:12]}"
        df.write.mode("errorifexists").parquet(folder)
        text = json.dumps({**note, "folder": folder}) + "\n"
        try:
            stream = self._fs.create(self._pointer(number), False)
        except Exception as error:
            if self._fs.exists(self._pointer(number)):
                self._fs.delete(self._path(folder), True)
                raise LostWriter(f"version {number} of {self.path} is taken") from error
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return number

    def drop_before(self, number: int) -> None:
        """Delete the data and pointers of versions older than ``number`` (at most the current one)."""
        number = min(number, self.current()[0])
        for status in self._fs.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith("version=") and int(name[8:].split("-")[0]) < number:
                self._fs.delete(status.getPath(), True)
        for status in self._fs.listStatus(self._path(f"{self.path}/_versions")):
            name = status.getPath().getName()
            if name.isdigit() and int(name) < number:
                self._fs.delete(status.getPath(), False)


class CounterTable(VersionedTable):
    """Item counters (A1) that follow the link table batch by batch.

    Each version notes the link version it counts. The links of the next batch add to it, so that
    only they are scanned; a batch that was counted already changes nothing, and one that would
    leave a gap is an error.
    """

    def rebuild(self, links: DataFrame, links_version: int) -> int:
        """Count the whole link table."""
        return self.commit(item_counters(links), self.current()[0], links_version=links_version)

    def add_batch(self, new_links: DataFrame, links_version: int) -> int:
        """Fold the links that made ``links_version`` out of the version before it."""
        number, note = self.current()
        counted = note.get("links_version", 0)
        if counted >= links_version:
            return number
        if counted != links_version - 1:
            raise StaleCounters(f"counters are at link version {counted}, the batch makes {links_version}")
        delta = item_counters(new_links)
        if number:
            delta = self.read().unionByName(delta).groupBy("item_id") \
                .agg(F.min("item_type").alias("item_type"), F.sum("counter").alias("counter"))
        return self.commit(delta, number, links_version=links_version)

    def at(self, links_version: int) -> DataFrame:
        """The counters of this link version, for J3."""
        counted = self.current()[1].get("links_version", 0)
        if counted != links_version:
            raise StaleCounters(f"counters are at link version {counted}, not {links_version}")
        return self.read()
