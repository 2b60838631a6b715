"""Federated averaging with local training: logistic regression by mini-batch steps inside centres.

A round deals each centre's rows to shards of bounded size. A shard takes its rows in the order of a digest of (seed, pass,
row key), a mini-batch at a time, and moves the shared parameters by a gradient step for each; only its number of rows and
how far its parameters moved leave the task, and are averaged by rows in Spark. The batches of a round go on where the round
before ended, through as many passes as it takes. Nothing depends on how rows are split into partitions, and a fit that
stops after a round goes on as if it had not.

A small centre is one shard, so its training is that of a centre on its own; a large one is many, so no task holds it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .logit import LogitModel
from .resample import hash52

#: Rows of a shard on average.
SHARD_ROWS = 500_000


@dataclass(frozen=True)
class FedState:
    """What a fit needs to go on: the rounds done and the shared parameters."""

    round: int
    coef: tuple[float, ...]


@dataclass(frozen=True)
class FedFit:
    model: LogitModel
    rounds: tuple[tuple[int, tuple[float, ...], float], ...]  # round, parameters after it, mean loss of its batches

    @property
    def state(self) -> FedState:
        return FedState(self.rounds[-1][0], self.rounds[-1][1])


def _shards(rows: DataFrame, center: str, shard_rows: int) -> DataFrame:
    """rows with their shard within the centre and the shard's number of rows."""
    per = rows.groupBy(center).agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("__shards"))
    dealt = rows.join(per, center).withColumn("__shard", F.pmod(F.xxhash64("__key"), F.col("__shards")).cast("int"))
    sizes = dealt.groupBy(center, "__shard").agg(F.count(F.lit(1)).alias("__n"))
    return dealt.join(sizes, [center, "__shard"]).drop("__shards")


def _train(start: np.ndarray, batch: int, rate: float, l2: float, first: int, last: int):
    """A function over rows of shards, each sorted by (shard, pass, draw): steps first..last - 1 of every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, w, n, steps, loss, at, epoch = None, start, 0, 0, 0.0, 0, -1
        xs: list[np.ndarray] = []
        done: list[tuple] = []

        def step() -> None:
            nonlocal w, steps, loss, xs
            own = np.concatenate(xs)
            x, y = own[:, :-1], own[:, -1]
            p = 1 / (1 + np.exp(-x @ w))
            loss += float(-np.mean(y * np.log(np.maximum(p, 1e-300)) + (1 - y) * np.log(np.maximum(1 - p, 1e-300))))
            w = w - rate * (x.T @ (p - y) / len(y) + l2 * np.r_[0.0, w[1:]])
            steps, xs = steps + 1, []

        def close() -> None:
            if now is not None:
                if xs:
                    step()
                done.append((n, (w - start).tolist(), steps, loss))

        for part in batches:
            shard, passes, size = (part.column(c).to_numpy(zero_copy_only=False) for c in ("__group", "__pass", "__n"))
            values = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in part.schema.names if c.startswith("__x") or c == "__y"], 1)
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (passes[1:] != passes[:-1])]) if len(shard) else []
            for s, e in zip(cuts, [*cuts[1:], len(shard)]):
                if shard[s] != now:
                    close()
                    now, w, n, steps, loss, at, epoch, xs = shard[s], start, int(size[s]), 0, 0.0, 0, passes[s], []
                elif passes[s] != epoch:
                    if xs:
                        step()
                    at, epoch = 0, passes[s]
                per = -(-n // batch)
                while s < e:
                    room = batch - at % batch
                    take = min(room, e - s)
                    if first <= epoch * per + at // batch < last:
                        xs.append(values[s : s + take])
                        if take == room:
                            step()
                    s, at = s + take, at + take
        close()
        counts, moves, made, losses = zip(*done) if done else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64()), pa.array(moves, pa.list_(pa.float64())), pa.array(made, pa.int64()), pa.array(losses, pa.float64())], names=["n", "move", "steps", "loss"])

    return run


def fit_fed_avg(df: DataFrame, features: Sequence[str], label: str, key: str, center: str, rounds: int, updates: int, batch: int = 32, rate: float = 0.1, l2: float = 0.0, seed: int = 3, shard_rows: int = SHARD_ROWS, state: FedState | None = None, until: int | None = None) -> FedFit:
    """`rounds` rounds of `updates` mini-batches of `batch` rows in each shard; rows with a null feature or label are left out.

    state: go on from it; until: stop after so many rounds. A shard's last batch of a pass has what is left. One job a round.
    """
    x = [f"__x{k}" for k in range(len(features) + 1)]
    rows = df.select(F.col(key).cast("string").alias("__key"), F.col(center).cast("string").alias(center), F.lit(1.0).alias("__x0"), *[F.col(c).cast("double").alias(n) for c, n in zip(features, x[1:])], F.col(label).cast("double").alias("__y"))
    rows = _shards(rows.na.drop(), center, shard_rows).withColumn("__group", F.concat_ws("|", center, "__shard")).persist(StorageLevel.MEMORY_AND_DISK)
    shared = np.array(state.coef) if state else np.zeros(len(x))
    begun, trace = state.round if state else 0, []
    per: Column = F.ceil(F.col("__n") / batch)
    try:
        for r in range(begun, rounds if until is None else min(until, rounds)):
            first, last = r * updates, (r + 1) * updates
            passes = F.explode(F.sequence(F.floor(F.lit(first) / per), F.floor(F.lit(last - 1) / per)))
            drawn = rows.withColumn("__pass", passes).withColumn("__draw", hash52(F.lit(seed), "__pass", "__key"))
            order = ["__group", "__pass", "__draw", "__key"]
            sorted_ = drawn.repartition("__group").sortWithinPartitions(*order).select("__group", "__pass", "__n", *x, "__y")
            moves = sorted_.mapInArrow(_train(shared, batch, rate, l2, first, last), "n bigint, move array<double>, steps bigint, loss double")
            aggs = [F.sum(F.col("n") * F.col("move")[k]) / F.sum("n") for k in range(len(x))]
            got = moves.agg(*[a.alias(f"m{k}") for k, a in enumerate(aggs)], (F.sum("loss") / F.sum("steps")).alias("loss")).first()
            shared = shared + np.array([got[f"m{k}"] or 0.0 for k in range(len(x))])
            trace.append((r + 1, tuple(map(float, shared)), float(got["loss"] or 0.0)))
        done = trace[-1][0] if trace else begun
        coef = tuple(map(float, shared))
        return FedFit(LogitModel(tuple(features), coef, done * updates, done == rounds), tuple(trace) or ((begun, coef, 0.0),))
    finally:
        rows.unpersist()
