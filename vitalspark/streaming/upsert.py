"""Event counts by (arm, time) that a stream keeps in a table: update mode, a merge for each micro-batch, exactly once.

A micro-batch gives the new totals of the groups that it changed. They go to a folder of their own (a delta) that a log
names together with the batch's number: a batch that comes again after a restart finds its number there and adds nothing, and
a torn write is never named. The table is the newest row of each group over all named deltas. Once there are more than
`keep` of them they are compacted into one, which replaces them in one entry. No group is held by the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cohort import CohortSpec
from ..sources.log import EntryLog
from .incremental import streaming_counts


class UpsertTable:
    """A table of newest rows by key, in a folder of any Hadoop file system. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], keep: int = 20):
        self.spark, self.path, self.keys, self.keep = spark, path.rstrip("/"), list(keys), keep
        self.log = EntryLog(spark, f"{self.path}/_batches")

    def _live(self, entries: list[dict]) -> list[tuple[int, str]]:
        """(batch, part) of what counts: the last compaction, and the batches after it."""
        out: list[tuple[int, str]] = []
        for e in entries:
            out = [(e["batch"], e["part"])] if e["compacted"] else [*out, (e["batch"], e["part"])]
        return out

    def last_batch(self) -> int:
        return max((e["batch"] for e in self.log.read()), default=-1)

    def merge(self, rows: DataFrame, batch: int) -> bool:
        """Take over the rows of a batch, a row a key; whether they were new."""
        if batch <= self.last_batch():
            return False
        part = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{part}")
        added = self.log.append(lambda entries: None if any(e["batch"] >= batch for e in entries) else {"batch": batch, "part": part, "compacted": False})
        if added and len(self._live(self.log.read())) > self.keep:
            self.compact()
        return added

    def read(self) -> DataFrame | None:
        """The newest row of each key; None before the first batch."""
        live = self._live(self.log.read())
        if not live:
            return None
        first = self.spark.read.parquet(f"{self.path}/{live[0][1]}")
        rows = None
        for batch, part in live:
            own = self.spark.read.schema(first.schema).parquet(f"{self.path}/{part}").withColumn("__batch", F.lit(batch).cast("long"))
            rows = own if rows is None else rows.unionByName(own)
        rest = [c for c in first.columns if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max(F.struct("__batch", *rest)).alias("__row"))  # partial aggregation, no sort
        return newest.select(*self.keys, *[F.col(f"__row.{c}").alias(c) for c in rest])

    def compact(self) -> None:
        """Write the newest rows as one part that replaces all before it."""
        last, part = self.last_batch(), f"part-{uuid.uuid4().hex}"
        rows = self.read()
        if rows is not None:
            rows.write.parquet(f"{self.path}/{part}")
            self.log.append(lambda entries: {"batch": last, "part": part, "compacted": True} if entries and max(e["batch"] for e in entries) == last else None)


def keep_counts(stream: DataFrame, spec: CohortSpec, table: UpsertTable, checkpoint: str, by: Sequence[str] = (), **trigger):
    """Start the query that keeps a cohort's counts by (by..., time) in a table with these keys."""
    changed = streaming_counts(stream, spec, by)
    writer = changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: table.merge(rows, batch))
    return (writer.trigger(**trigger) if trigger else writer).start()
