"""Cohort ETL: nearest records, imputation, recoding, time-to-event from event streams."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..sources import scratch
from ..sources.scratch import settle
from . import forest


def micros(at: str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone; one with a zone is taken in the session's."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(`{at}` AS TIMESTAMP_NTZ))")


def nearest_record(index: DataFrame, records: DataFrame, key: str, at: str, seen: str, low: Column, high: Column) -> DataFrame:
    """For each index row the record of the same key within [at + low, at + high] that is closest, then earliest.

    An equi-join with a range condition and a least struct by index row: no sort of a key's records, and partial aggregation
    keeps one candidate a task. Index rows without a record stay, with nulls.
    """
    columns = [c for c in records.columns if c != key]
    near = index.join(records, key).where((F.col(seen) >= F.col(at) + low) & (F.col(seen) <= F.col(at) + high))
    gap = F.abs(micros(seen) - micros(at))
    best = near.groupBy(*index.columns).agg(F.min(F.struct(gap.alias("__gap"), F.col(seen).alias("__seen"), *[F.col(c).alias(f"__{c}") for c in columns if c != seen])).alias("__best"))
    best = best.select(*[F.col(c).alias(f"__of_{c}") for c in index.columns], "__best")
    rest = [F.col(f"__best.__{c}").alias(c) for c in columns if c != seen]
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in index.columns]  # a key may have several index rows
    return index.join(best, same, "left").select(*index.columns, F.col("__best.__seen").alias(seen), *rest)


def exclude_ids(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def fill_mean_mode(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """Nulls replaced by the column's mean or, for categories, its most frequent value (the smallest of ties)."""
    stats = df.agg(*[F.avg(c).alias(f"__{c}") for c in numeric])
    for c in categorical:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        mode = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(c).alias("v"))).alias("m")).select(F.col("m.v").alias(f"__{c}"))
        stats = stats.join(mode)
    filled = df.join(F.broadcast(stats)).withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in (*numeric, *categorical)})
    return filled.drop(*[f"__{c}" for c in (*numeric, *categorical)])


def impute_once(df: DataFrame, key: str, numeric: Sequence[str] = (), categorical: Sequence[str] = (), impute: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df, which may repeat a key (one row a visit or endpoint), with columns imputed from one row a key and joined back.

    A key's value is its first known one in order of value; impute(rows of key and columns) fills what no row of the key
    has, by default with means and modes.
    """
    columns = [*numeric, *categorical]
    once = df.groupBy(key).agg(*[F.min(c).alias(c) for c in columns])
    filled = impute(once) if impute else fill_mean_mode(once, numeric, categorical)
    filled = filled.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = df.join(filled, F.col(key) == F.col("__key"), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__new_{c}")) for c in columns}).select(*df.columns)


def overwrite_where(condition: Column, **values) -> dict[str, Column]:
    """Columns for withColumns: each takes its value where the condition holds and stays where it does not or is null."""
    return {name: F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(name)) for name, value in values.items()}


def recode(name: str, mapping: dict, default: Column | None = None) -> Column:
    """Values replaced by a fixed mapping; others become the default, or null."""
    out = default if default is not None else F.lit(None)
    for value, label in reversed(mapping.items()):
        out = F.when(F.col(name) == value, F.lit(label)).otherwise(out)
    return out


def null_if(name: str, value) -> Column:
    return F.nullif(F.col(name), F.lit(value))


def body_mass_index(weight_kg: Column, height_cm: Column) -> Column:
    return F.try_divide(weight_kg, F.pow(height_cm / 100, F.lit(2)))


def months_between_days(later: Column, earlier: Column) -> Column:
    """Days between two dates as months of 365 / 12 days."""
    return F.datediff(later, earlier) * 12 / 365


def select_matching(df: DataFrame, pattern: str) -> DataFrame:
    """The columns whose names match a regular expression."""
    import re

    return df.select([F.col(f"`{c}`") for c in df.columns if re.search(pattern, c)])


def time_to_event(events: DataFrame, key: str, at: str, kind: str, target: str) -> DataFrame:
    """(key, start, time, event): seconds from the first row to the first later row of the target kind, or to the last row."""
    first = Window.partitionBy(key)
    rows = events.select(key, at, kind).withColumn("start", F.min(at).over(first))
    hit = F.when((F.col(kind) == target) & (F.col(at) > F.col("start")), F.col(at))
    out = rows.groupBy(key).agg(F.min("start").alias("start"), F.min(hit).alias("hit"), F.max(at).alias("last"))
    out = out.withColumn("end", F.coalesce("hit", "last"))
    seconds = (micros("end") - micros("start")) / 1e6
    return out.select(key, "start", seconds.alias("time"), F.col("hit").isNotNull().cast("int").alias("event"))


def missing_order(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns by number of nulls, fewest first, ties in the given order."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return sorted(columns, key=lambda c: row[c])


def miss_forest(df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str] = (), max_iter: int = 10, trees: int = 100, depth: int = 10, least: float = 1.0, seed: int = 5) -> DataFrame:
    """Random-forest imputation: start from means and modes, then refit each incomplete column on the others, fewest nulls
    first, until the change grows or max_iter; the matrix before the change grew is returned. Categories are integer codes
    from 0. A column without a known value stays null, and one without others keeps its mean or mode.

    Features are binned once, at quantiles of what is known. A forest is trees x depth arrays that grow in one job or a level a
    job (`forest`), whatever the rows, and each column's imputed values are written to the shared folder, so plans stay short.
    They stand there beside those of the pass before, so passes are compared without a join. A row's sample weights follow
    from its key, so results do not depend on partitions.
    """
    columns, spark = [*numeric, *categorical], df.sparkSession
    begun = scratch.written()
    original = settle(df.select(key, *columns).withColumns({f"__na_{c}": F.col(c).isNull() for c in columns}), "known")
    missing = original.agg(*[F.count_if(F.col(f"__na_{c}")).alias(c) for c in columns], *[F.max(c).alias(f"__most_{c}") for c in columns], *[F.min(c).alias(f"__least_{c}") for c in columns]).first()
    todo = sorted((c for c in columns if missing[c] and missing[f"__most_{c}"] is not None), key=lambda c: missing[c]) if len(columns) > 1 else []
    classes = {c: int(missing[f"__most_{c}"] or 0) + 1 for c in categorical}
    spans = {c: (float(missing[f"__least_{c}"] or 0), float(missing[f"__most_{c}"] or 0)) for c in columns}
    now = settle(fill_mean_mode(original, numeric, categorical).withColumns({c: F.col(c).cast("double") for c in columns}), "imputed")
    cuts = dict(zip(columns, forest.edges(original, columns))) if todo else {}
    scratch.remove_written(spark, begun, but=1)
    last = None
    for _ in range(max_iter if todo else 0):
        new = now.withColumns({f"__o_{c}": F.col(c) for c in todo})
        for c in todo:
            others = [o for o in columns if o != c]
            sizes = [len(cuts[o]) + 1 for o in others]
            rows = _binned_rows(new, key, c, others, cuts)
            if not forest.reads_once(sizes, classes.get(c, 0), trees):
                rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                fit = forest.fit_forest(rows, len(others), classes.get(c, 0), spans[c], trees, depth, least, seed=seed, sizes=sizes)
            finally:
                rows.unpersist()
            new = settle(_with_predicted(new, c, others, cuts, fit), "imputed")
        change = [F.sum(F.pow(F.col(c) - F.col(f"__o_{c}"), F.lit(2))) for c in todo if c in numeric] or [F.lit(0.0)]
        size = [F.sum(F.pow(F.col(c), F.lit(2))) for c in todo if c in numeric] or [F.lit(1.0)]
        flips = [F.avg((F.col(c) != F.col(f"__o_{c}")).cast("double")) for c in todo if c in categorical] or [F.lit(0.0)]
        row = new.agg(F.try_divide(sum(change[1:], change[0]), sum(size[1:], size[0])).alias("a"), sum(flips[1:], flips[0]).alias("b")).first()
        if last is not None and (row["a"] or 0) + (row["b"] or 0) >= last:
            break
        last, now = (row["a"] or 0) + (row["b"] or 0), new
        scratch.remove_written(spark, begun, but=1)
    return now.select(key, *columns)


def _bins_of(batch: pa.RecordBatch, others: Sequence[str], cuts: dict[str, np.ndarray]) -> np.ndarray:
    return forest.binned([batch.column(o).to_numpy(zero_copy_only=False) for o in others], [cuts[o] for o in others])


def _binned_rows(df: DataFrame, key: str, column: str, others: Sequence[str], cuts: dict[str, np.ndarray]) -> DataFrame:
    """(id, bins, y) of the rows where a column is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _bins_of(batch, others, cuts)
            offsets = pa.py_buffer((np.arange(len(bins) + 1) * len(others)).astype("<i4").tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(bins), [None, offsets, pa.py_buffer(bins.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("__id"), packed, batch.column(column)], names=["id", "bins", "y"])

    known = df.where(~F.col(f"__na_{column}")).select(F.xxhash64(key).alias("__id"), column, *others)
    return known.mapInArrow(run, "id bigint, bins binary, y double")


def _with_predicted(df: DataFrame, column: str, others: Sequence[str], cuts: dict[str, np.ndarray], fit: forest.Forest) -> DataFrame:
    """df with a column's missing values as the forest predicts them; with few combinations of bins these are looked up."""
    sizes = [len(cuts[o]) + 1 for o in others]
    known = fit.predict(forest.combinations(sizes)) if math.prod(sizes) <= forest.LOOKUP else None

    def predicted(bins: np.ndarray) -> np.ndarray:
        return fit.predict(bins) if known is None else known[np.ravel_multi_index(tuple(bins.T), sizes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost = np.flatnonzero(batch.column(f"__na_{column}").to_numpy(zero_copy_only=False))
            values = np.array(batch.column(column).to_numpy(zero_copy_only=False))
            if len(lost):
                values[lost] = predicted(_bins_of(batch.take(pa.array(lost)), others, cuts))
            at = batch.schema.get_field_index(column)
            yield batch.set_column(at, batch.schema.field(at), pa.array(values, pa.float64()))

    return df.mapInArrow(run, df.schema)
