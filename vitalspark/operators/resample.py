"""Bootstrap replicates: multiplicities of rows for each replicate, replicate 0 being the data as it is.

Two forms: a column `replicate`, with a row for each replicate that has it, for estimators of any kind; and packed, one row
with the multiplicities of all replicates as bytes, for statistics that are sums by time. Those are added up as arrays where
the rows are (`packed_time_sums`), so that what is shuffled is a row for each time and task, whatever the replicates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..cohort import CohortSpec, bucket_rank
from ..sources.scratch import settle

#: Draws that may be needed until every centre has its rows; beyond, a centre is too small for the bootstrap.
MAX_ATTEMPTS = 50
#: Picks that are counted in one part, and rows that are ranked in one.
PICKS, RANKED = 2_400_000, 500_000


def hash52(*parts: Column) -> Column:
    """52 bits of a digest of the parts: the same draw in any engine that has MD5, and for tables of any size."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def draw_multiplicities(df: DataFrame, spec: CohortSpec, replicates: int | Sequence[int], by: Sequence[str] = (), buckets: int = 32, seed: int = 1, attempt: int = 0) -> DataFrame:
    """(replicate, id, multiplicity): n draws with replacement from all rows, or within each group of `by`.

    Rows are ranked by id inside their group, and draws join rows by (group, rank). Draw j of a replicate takes the row of
    rank hash(seed, replicate, attempt, group, j) mod n. replicates: a number, or the numbers to be drawn.
    """
    names = F.sequence(F.lit(1), F.lit(replicates)) if isinstance(replicates, int) else F.array(*[F.lit(int(r)) for r in replicates])
    ids = df.select(*by, spec.id)
    ranked = bucket_rank(ids, spec.id, buckets, "rank", by)
    sizes = ids.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    draws = ranked.join(F.broadcast(sizes) if not by else sizes, list(by)) if by else ranked.join(F.broadcast(sizes))
    draws = draws.withColumn("replicate", F.explode(names))
    pick = F.pmod(hash52(F.lit(seed), "replicate", F.lit(attempt), *by, "rank"), F.col("n"))
    picks = draws.select(*by, "replicate", pick.alias("rank")).groupBy(*by, "replicate", "rank").agg(F.count(F.lit(1)).alias("multiplicity"))
    return picks.join(ranked, [*by, "rank"]).select("replicate", spec.id, "multiplicity")


def draw_valid(df: DataFrame, spec: CohortSpec, replicates: int, least: int = 2, seed: int = 1) -> DataFrame:
    """As draw_multiplicities over all rows, but a replicate in which a centre has fewer than `least` draws is drawn anew."""
    centers = df.select(spec.id, spec.center)
    n_centers = df.select(spec.center).distinct().count()
    out, todo = None, list(range(1, replicates + 1))
    for attempt in range(MAX_ATTEMPTS):
        drawn = settle(draw_multiplicities(df, spec, todo, seed=seed, attempt=attempt), "drawn")  # for the check and for use
        per = drawn.join(centers, spec.id).groupBy("replicate", spec.center).agg(F.sum("multiplicity").alias("n"))
        good = [r[0] for r in per.where(F.col("n") >= least).groupBy("replicate").count().where(F.col("count") == n_centers).collect()]  # replicates
        kept = drawn.where(F.col("replicate").isin(good)) if len(good) < len(todo) else drawn
        out = kept if out is None else out.unionByName(kept)
        todo = sorted(set(todo) - set(good))
        if not todo:
            return out
    raise ValueError(f"no draw in {MAX_ATTEMPTS} gives every centre {least} rows")


def poisson_multiplicities(df: DataFrame, spec: CohortSpec, replicates: int, seed: int = 1) -> DataFrame:
    """(replicate, id, multiplicity) with independent Poisson(1) multiplicities from a hash of row and replicate: no
    ranking. To be joined with the rows by `replicate`; `poisson_packed` is the form without a join, for very large cohorts."""
    bounds = _poisson_bounds()
    u = (hash52(F.lit(seed), "replicate", spec.id).cast("double") + 0.5) / float(1 << 52)
    m = sum((F.when(F.col("__u") >= b, 1).otherwise(0) for b in bounds[1:]), F.when(F.col("__u") >= bounds[0], 1).otherwise(0))
    rows = df.select(spec.id, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).withColumn("__u", u)
    return rows.where(F.col("__u") >= bounds[0]).select("replicate", spec.id, m.alias("multiplicity"))


def _poisson_bounds() -> list[float]:
    """Cumulative shares of 0, 1, ...; up to 20 exhaust the hash's 52 bits."""
    return np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)]).tolist()


def poisson_packed(df: DataFrame, spec: CohortSpec, replicates: int, seed: int = 1, name: str = "multiplicities") -> DataFrame:
    """df with the multiplicities of replicates 1.. as bytes, those of `poisson_multiplicities`: a map over the rows."""
    bounds = np.array(_poisson_bounds())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [b"".join(hashlib.md5(f"{seed}:{r}:{i}".encode()).digest()[:7] for r in range(1, replicates + 1)) for i in batch.column("__name").to_pylist()]
            whole = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 7).astype(np.int64)  # 13 hexadecimal digits are 52 bits
            u = ((whole @ (1 << np.arange(48, -1, -8))) >> 4) + 0.5
            m = np.searchsorted(bounds, (u / float(1 << 52)).reshape(-1, replicates), side="right").astype(np.uint8)
            columns = [batch.column(c) for c in batch.schema.names if c != "__name"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in m], pa.binary())], names=[*(c for c in batch.schema.names if c != "__name"), name])

    schema = StructType([*df.schema.fields, StructField(name, BinaryType())])
    return df.withColumn("__name", F.col(spec.id).cast("string")).mapInArrow(run, schema)


def draws_packed(df: DataFrame, spec: CohortSpec, replicates: int, by: Sequence[str] = (), buckets: int = 32, seed: int = 1, name: str = "multiplicities") -> DataFrame:
    """df with the multiplicities of `draw_multiplicities` as bytes: picks go to the rank that they pick, as numbers, and rows
    are joined once.

    df is written once, as ranks and rows are read from it; picks are counted by 7 bytes a number, where they land, in parts of
    about `PICKS` picks, and the ranked rows come to the same parts.
    """
    spark = df.sparkSession
    df = settle(df, "rows")
    n = df.count()
    parts = max(1, -(-n * replicates // PICKS))
    ranked = bucket_rank(df, spec.id, max(buckets, -(-n // RANKED)), "__rank", by)
    if by:
        ids = df.select(*by, spec.id)
        places = bucket_rank(ids, spec.id, max(buckets, -(-n // RANKED)), "__rank", by).join(ids.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), list(by))
    else:
        places = spark.range(0, n, 1, parts).select(F.col("id").alias("__rank"), F.lit(n).cast("long").alias("__n"))
    draws = places.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    picks = draws.select(*by, F.pmod(hash52(F.lit(seed), "replicate", F.lit(0), *by, "__rank"), F.col("__n")).alias("__rank"), "replicate")
    bank, one = F.floor((F.col("replicate") - 1) / 7), F.expr("shiftleft(1L, cast(8 * ((replicate - 1) % 7) AS int))")
    own, banks = df.columns, [f"__bank{k}" for k in range(-(-replicates // 7))]
    packed = picks.repartition(parts, *by, "__rank").groupBy(*by, "__rank").agg(*[F.sum(F.when(bank == k, one).otherwise(F.lit(0).cast("long"))).alias(c) for k, c in enumerate(banks)])
    joined = ranked.repartition(parts, *by, "__rank").join(packed, [*by, "__rank"], "left").select(*own, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in banks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in banks], 1)
            counts = numbers.astype("<i8").view(np.uint8).reshape(len(numbers), len(banks), 8)[:, :, :7].reshape(len(numbers), 7 * len(banks))[:, :replicates]  # 256 picks of a row have a probability below 1e-500
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array([x.tobytes() for x in counts], pa.binary())], names=[*own, name])

    return joined.mapInArrow(run, StructType([*df.schema.fields, StructField(name, BinaryType())]))


def packed_time_sums(df: DataFrame, spec: CohortSpec, sums: dict[str, Column], replicates: int, name: str = "multiplicities", flush: int = 4 << 20) -> DataFrame:
    """(replicate, time, sums...): sums of columns times multiplicity by replicate and time, of df with packed multiplicities.

    A task adds up arrays of all replicates by time and hands on one row a time (or several, once `flush` numbers are held);
    a shuffle by time adds these up. Times that a replicate has no row of are left out.
    """
    names = list(sums)
    rows = df.select(F.col(spec.duration).cast("double").alias("time"), F.col(name).alias("m"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"s{k}") for k, c in enumerate(sums.values())]).where("time is not null")
    width = len(names) + 1  # the last counts rows

    def add(total: dict, time: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(time, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(time[order]) != 0])
        for t, v in zip(time[order][starts].tolist(), np.add.reduceat(values[order], starts)):
            total[t] = total[t] + v if t in total else v

    def give(total: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.float64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["time", "v"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[float, np.ndarray] = {}
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                m = np.frombuffer(b"".join(part.column("m").to_pylist()), np.uint8).reshape(-1, replicates).astype(float)
                own = np.stack([*(part.column(f"s{k}").to_numpy(zero_copy_only=False) for k in range(len(names))), np.ones(len(m))], 1)
                add(total, part.column("time").to_numpy(zero_copy_only=False), (own[:, :, None] * m[:, None, :]).reshape(len(m), -1))
                if len(total) * width * replicates > flush:
                    yield give(total)
                    total = {}
        yield give(total)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0)

        def spread(time: float, v: np.ndarray) -> pa.RecordBatch:
            table = v.reshape(width, replicates)
            some = np.flatnonzero(table[-1])
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32) + 1), pa.array(np.full(len(some), time)), *(pa.array(x[some]) for x in table[:-1])], names=["replicate", "time", *names])

        for batch in batches:
            for time, raw in zip(batch.column("time").to_pylist(), batch.column("v").to_pylist()):
                if time == last:
                    own = own + np.frombuffer(raw)
                else:
                    if last is not None:
                        yield spread(last, own)
                    last, own = time, np.frombuffer(raw)
        if last is not None:
            yield spread(last, own)

    parts = rows.mapInArrow(local, "time double, v binary").repartition("time").sortWithinPartitions("time")
    return parts.mapInArrow(merged, "replicate int, time double, " + ", ".join(f"`{n}` double" for n in names))


def fold_multiplicities(df: DataFrame, spec: CohortSpec, folds: int, repeats: int = 1, seed: int = 1) -> DataFrame:
    """Cross-validation as replicates: replicate r * folds + k + 1 has every row but fold k's of repetition r, once."""
    fold = F.pmod(hash52(F.lit(seed), "repeat", spec.id), F.lit(folds))
    rows = df.select(spec.id, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")).withColumn("fold", fold)
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("k <> fold")
    return rows.select((F.col("repeat") * folds + F.col("k") + 1).cast("int").alias("replicate"), spec.id, F.lit(1).cast("long").alias("multiplicity"))


def replicate(df: DataFrame, spec: CohortSpec, multiplicities: DataFrame, keep_all: str | None = None, weight: str = "boot_weight") -> DataFrame:
    """df repeated for each replicate that has a row, with its multiplicity and `weight`, that times the row's weight;
    replicate 0 is df.

    With keep_all, a boolean expression, rows that meet it are in every replicate once (treated-only resampling).
    """
    once = {"multiplicity": F.lit(1).cast("long"), weight: spec.w}
    drawn = df.join(multiplicities.withColumn("multiplicity", F.col("multiplicity").cast("long")), spec.id).withColumn(weight, spec.w * F.col("multiplicity"))
    out = df.withColumns({"replicate": F.lit(0)} | once).unionByName(drawn)
    if keep_all:
        names = multiplicities.select("replicate").distinct()
        out = out.where(f"replicate = 0 or not ({keep_all})").unionByName(df.where(keep_all).crossJoin(F.broadcast(names)).withColumns(once))  # a name a replicate
    return out


def valid_replicates(boot: DataFrame, spec: CohortSpec, least: int = 2) -> DataFrame:
    """Replicates in which every centre has at least `least` rows."""
    by = boot.groupBy("replicate", spec.center).agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("replicate").agg(F.min("n").alias("least")).where(F.col("least") >= least).select("replicate")


def bootstrap_variance(estimates: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population deviations over the replicates but 0, and population covariances of every two columns."""
    drawn = estimates.where("replicate > 0")
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    return drawn.agg(*[F.stddev_pop(c).alias(f"std_{c}") for c in columns], *[F.covar_pop(a, b).alias(f"cov_{a}_{b}") for a, b in pairs])


def bootstrap_metric(boot: DataFrame, metric: Callable[[DataFrame, Sequence[str]], DataFrame], name: str) -> DataFrame:
    """Mean over the replicates but 0 of a metric that is computed by replicate."""
    return metric(boot.where("replicate > 0"), ["replicate"]).agg(F.avg(name).alias(name))
