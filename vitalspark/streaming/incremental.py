"""Extension: a cohort's event table kept up to date from a stream of finished follow-ups.

Counts by (arm, time) are mergeable sums, so a streaming groupBy in update mode holds one row of state for each; every
trigger the changed rows are merged into a table and the curves are read from it like any batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cohort import CohortSpec
from ..operators.km import survival_curve
from ..operators.scan import running


def streaming_counts(stream: DataFrame, spec: CohortSpec, by: Sequence[str] = ()) -> DataFrame:
    """(by..., time, leaving, events), to be written in update or complete mode."""
    w = spec.w
    return stream.groupBy(*by, F.col(spec.duration).alias("time")).agg(F.sum(w).alias("leaving"), F.sum(w * F.col(spec.event)).alias("events"))


def curve_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    at_risk = running(counts, list(by), "time", {"at_risk": F.col("leaving")}, descending=True)
    return survival_curve(at_risk.select(*by, "time", "at_risk", "events"), by)


def start_counts(stream: DataFrame, spec: CohortSpec, name: str, by: Sequence[str] = (), checkpoint: str | None = None):
    """Write the counts to an in-memory table in complete mode; for tests and small numbers of distinct times."""
    writer = streaming_counts(stream, spec, by).writeStream.outputMode("complete").format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
