"""Append-only logs in a folder of any Hadoop file system: numbered entries, and results that a repeated job adds once.

An entry is written aside and renamed to the next number without overwriting, so it appears whole or not at all, and of two
writers that take one number the second one looks again. A result is a folder of Parquet files that counts from the moment
the manifest names it: what a torn or repeated write leaves behind is never read. A local file system has no such rename,
so there the writers must be threads of one process.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


_RENAMING = threading.Lock()


class EntryLog:
    """Numbered JSON entries. They are read whole by the driver: a log of runs or rounds, not of rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = ""):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        path, files = self._at()
        return sorted(s.getPath().getName() for s in files.listStatus(path) if s.getPath().getName().endswith(".json")) if files.exists(path) else []

    def _context(self, path):
        return self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict:
        path, files = self._at(name)
        path = files.makeQualified(path)
        context = self._context(path)
        context.setVerifyChecksum(False, path)  # a local checksum file is renamed after its file
        stream = context.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self) -> list[dict]:
        return [self._read(name) for name in self._names()]

    def append(self, decide: Callable[[list[dict]], dict | None]) -> bool:
        """Add decide(all entries so far), if that is an entry; it is asked again whenever another writer came first."""
        while True:
            names = self._names()
            entry = decide([self._read(name) for name in names])
            if entry is None:
                return False
            number = int(names[-1].split(".")[0]) + 1 if names else 0
            if self._put(f"{number:012d}.json", json.dumps(entry)):
                return True

    def _put(self, name: str, text: str) -> bool:
        """Whether the file was new; it is then there as a whole."""
        aside, files = self._at(f"_{uuid.uuid4().hex}")
        out = files.create(aside, False)
        out.write(text.encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        source, target = files.makeQualified(aside), files.makeQualified(self._at(name)[0])
        try:
            with _RENAMING:
                self._context(source).rename(source, target, options)
            return True
        except Exception as problem:
            files.delete(aside, False)
            if "FileAlreadyExists" in str(problem):
                return False
            raise


def append_once(df: DataFrame, path: str, job: str) -> bool:
    """Add the rows of a job to a result log unless it is there already; whether they were added.

    Two copies of a job that run at once both write, and one of them is named; a job that dies leaves nothing that counts.
    """
    spark, log = df.sparkSession, EntryLog(df.sparkSession, f"{path}/_jobs")
    if any(e["job"] == job for e in log.read()):
        return False
    part = f"part-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{part}")
    added = log.append(lambda entries: None if any(e["job"] == job for e in entries) else {"job": job, "part": part})
    if not added:
        _remove(spark, f"{path.rstrip('/')}/{part}")
    return added


def read_once(spark: SparkSession, path: str) -> DataFrame | None:
    """All results that the manifest names, columns merged by name; None before the first."""
    parts = [f"{path.rstrip('/')}/{e['part']}" for e in EntryLog(spark, f"{path}/_jobs").read()]
    return spark.read.option("mergeSchema", "true").parquet(*parts) if parts else None


def sweep(spark: SparkSession, path: str) -> int:
    """Remove the parts that no entry names, when no job is writing; their number."""
    log = EntryLog(spark, path)
    root, files = log._at()
    known = {e["part"] for e in EntryLog(spark, f"{path}/_jobs").read()}
    stale = [s.getPath().getName() for s in files.listStatus(root) if s.getPath().getName().startswith("part-") and s.getPath().getName() not in known]
    for name in stale:
        _remove(spark, f"{log.path}/{name}")
    return len(stale)


def _remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
